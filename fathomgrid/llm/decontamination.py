"""Benchmark decontamination: BM25 retrieval of test items for every training passage.

Test items (long ones in parts of at most 48 words) form an inverted index with BM25 weights, divided by the
score an item has for itself, so that one threshold serves all. Items are ordered by that score, and
postings carry the largest weight of every block. Every training document is cut into overlapping
passages of 64 words, each a query:

* A part's commonest words, up to LIGHT of its score, are light and count as LIGHT. The largest weights of
  the heavy ones per term and group of items, added over the words of all passages of many documents at
  once, bound every score with it; passages and groups that cannot reach the threshold stop here.
* Block-max WAND retrieves all items above the threshold for the rest.
* A retrieved item is a leak if the passage's surroundings contain enough of the word triples of its
  question and of its answer. Without columns of their own, these are the two halves of its text.

An item of under four words has no passage to be told by: it is a leak where it is a whole line, or the
whole text, of a document. In scripts without spaces every character is a word.

Arrow kernels look up the words of many documents at once. Words are read one by one only where a piece
between spaces may be other than one word, and in documents with a retrieved item.

The index travels with the tasks. Items are indexed in blocks of bounded size, with the document frequencies,
count and mean length of all items, so that scores do not depend on the blocks. All documents are
read once per block, one block after another, so nothing that is sent grows with the benchmark. Documents are
never shuffled.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.durable import durable

from .common import documents, rows_in, small_table, stage, text_hash, to_arrow
from .words import slices

K1, B = 1.2, 0.75
PART, STEP, PASSAGE = 48, 16, 4      # words of an item part and of a step, steps of a passage
LEAST_WORDS = 4                      # an item with fewer must be a whole line
THRESHOLD = 0.6                      # of an item's score for itself
LIGHT = THRESHOLD / 2                # of an item's score, most of its commonest words
OVERLAP = 0.5                        # of the triples of question and of answer
GROUPS, POSTING_BLOCK = 128, 8       # fewer groups for a large vocabulary: the table has BOUNDS numbers at most
BOUNDS = 1 << 22
INDEX_BYTES = 2 << 20                # text of the items in one index
TEXT_BYTES = 2 << 20                 # texts searched at once
STEPS = 512                          # steps whose bounds are computed at once
# Blocks of scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han).
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|(?=\w)[{_UNSPACED}]")
_SIGNS = string.punctuation.replace("_", "")
# Beside digits, letters that Python's lower() leaves alone: without others, a piece is one word.
_OTHER = "[^0-9_a-zß-öø-ÿα-ωа-я]"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def triples(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    """Distinct runs of three words; all words if there are fewer."""
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def share_in(grams: set[tuple[str, ...]], words: list[str]) -> float:
    """Share of an item's word runs that stand among the words; 1 if it has none."""
    return len(grams & triples(words, len(next(iter(grams))))) / len(grams) if grams else 1.0


def part_ends(n: int) -> list[tuple[int, int]]:
    """Parts of an item of n words, of at most PART words and nearly equal."""
    ends = np.linspace(0, n, -(-n // PART) + 1).astype(int).tolist()
    return list(zip(ends, ends[1:]))


HEAVY = pa.list_(pa.struct([("group", pa.int64()), ("weight", pa.float64())]))


class Vocabulary(dict):
    def __missing__(self, word: str) -> int:
        return 0


class Index:
    """Inverted index of items: (item id, question words, answer words).

    statistics: document frequencies, number and mean length of the parts of all items, if these
    are only some of them.
    """

    def __init__(self, items: list[tuple[int, list[str], list[str]]], statistics: tuple[dict[str, int], int, float] | None = None):
        parts = []
        self.short: dict[tuple[str, ...], list[int]] = {}
        for item_id, question, answer in items:
            words, split = question + answer, len(question)
            if len(words) < LEAST_WORDS:
                if words:
                    self.short.setdefault(tuple(words), []).append(item_id)
                continue
            for at, end in part_ends(len(words)):
                parts.append((item_id, words[at:end], triples(words[at:min(end, split)]), triples(words[max(at, split):end])))
        if statistics is None:
            df = Counter(w for _, cut, _, _ in parts for w in set(cut))
            n, mean = len(parts), sum(len(p[1]) for p in parts) / max(len(parts), 1)
        else:
            df, n, mean = statistics
        idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
        weighted = []
        for part in parts:
            cut, tf = part[1], {}
            for w in cut:
                tf[w] = tf.get(w, 0) + 1
            weight = {w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(cut) / mean)) for w, c in tf.items()}
            weighted.append((sum(weight.values()), part, weight))
        weighted.sort(key=lambda x: (x[0], x[1][0], x[1][1]))
        self.items = [part for _, part, _ in weighted]
        self.vocabulary = Vocabulary((w, i + 1) for i, w in enumerate(sorted(df)))
        self.words = pa.array(self.vocabulary, pa.string())
        n = len(parts)
        self.group = max(1, -(-n // max(8, min(GROUPS, BOUNDS // (len(df) + 1)))))
        self.most = np.zeros((len(df) + 1, max(1, -(-n // self.group))), np.float32)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(len(df) + 1)]
        heavy: list[dict[int, float]] = [{} for _ in range(len(df) + 1)]
        for d, (own, _, weight) in enumerate(weighted):
            light, group = 0.0, d // self.group
            for w in sorted(weight, key=lambda w: (-df[w], w)):
                t, x = self.vocabulary[w], weight[w] / own
                postings[t].append((d, x))
                self.most[t, group] = max(self.most[t, group], x)
                if light + x <= LIGHT:
                    light += x
                else:
                    heavy[t][group] = max(heavy[t].get(group, 0.0), x)
        self.is_heavy = np.array([bool(h) for h in heavy])
        self.heavy = pa.array([[{"group": g, "weight": x} for g, x in h.items()] for h in heavy], HEAVY)
        self.postings = [([d for d, _ in p], [x for _, x in p],
                          [max(x for _, x in p[i:i + POSTING_BLOCK]) for i in range(0, len(p), POSTING_BLOCK)]) for p in postings]

    def retrieve(self, terms: list[int], lo: int, hi: int, threshold: float) -> list[tuple[int, float]]:
        """Items in [lo, hi) whose score for the terms reaches the threshold, by block-max WAND."""
        cursors, group = [], lo // self.group
        for t in terms:
            docs = self.postings[t][0]
            at = bisect_left(docs, lo)
            if at < len(docs) and docs[at] < hi:
                cursors.append([docs[at], at, t, float(self.most[t, group])])
        found = []

        def advance(c, target):
            docs = self.postings[c[2]][0]
            c[1] = bisect_left(docs, target, c[1])
            c[0] = docs[c[1]] if c[1] < len(docs) else hi

        while True:
            cursors = sorted(c for c in cursors if c[0] < hi)
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[3]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return found
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            front = cursors[:pivot + 1]
            best, skip = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else hi
            for c in front:
                docs, _, most = self.postings[c[2]]
                at = bisect_left(docs, doc, c[1])
                if at < len(docs):
                    block = at // POSTING_BLOCK
                    best += most[block]
                    end = (block + 1) * POSTING_BLOCK
                    skip = min(skip, docs[end - 1] + 1 if end <= len(docs) else hi)
            if best < threshold:
                for c in front:
                    if c[0] < max(skip, doc + 1):
                        advance(c, max(skip, doc + 1))
                continue
            if cursors[0][0] == doc:
                score = sum(self.postings[c[2]][1][c[1]] for c in front)
                if score >= threshold:
                    found.append((doc, score))
                for c in front:
                    advance(c, doc + 1)
            else:
                for c in front:
                    if c[0] < doc:
                        advance(c, doc)

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary numbers of all words of the texts, one text after another, and where each text ends."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        pieces = pc.ascii_trim(pc.list_flatten(split), _SIGNS)
        number = pc.fill_null(pc.index_in(pieces, value_set=self.words.cast(pieces.type)), -1).to_numpy() + 1
        n_words = (pc.binary_length(pieces).to_numpy() > 0).astype(np.int64)
        unknown = np.flatnonzero(number == 0)
        read = np.zeros(len(pieces), bool)
        read[unknown] = pc.match_substring_regex(pieces.take(pa.array(unknown)), _OTHER).to_numpy(zero_copy_only=False)
        words = [words_of(p) for p in pieces.filter(pa.array(read)).to_pylist()]
        n_words[read] = [len(w) for w in words]
        ids = np.repeat(number, n_words)
        ids[np.repeat(read, n_words)] = [self.vocabulary[w] for ws in words for w in ws]
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        return ids, np.append(0, np.cumsum(n_words))[ends]

    def passages(self, ids: np.ndarray, ends: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
        """Text, step and group of the passages that may reach the threshold, by the weights of heavy words."""
        sizes = np.diff(ends, prepend=0)
        steps = -(-sizes // STEP)
        step_ends = np.cumsum(steps)
        first_word, first_step = ends - sizes, step_ends - steps
        heavy = np.flatnonzero(self.is_heavy[ids])
        text = np.searchsorted(ends, heavy, side="right")
        step = first_step[text] + (heavy - first_word[text]) // STEP
        groups, total = self.most.shape[1], int(steps.sum())
        for first in range(0, total, STEPS):
            n = min(STEPS, total - first)
            lo, hi = np.searchsorted(step, [first, first + n + PASSAGE - 1])
            postings = self.heavy.take(pa.array(ids[heavy[lo:hi]]))
            row = step[lo:hi][pc.list_parent_indices(postings).to_numpy()] - first
            group, weight = (x.to_numpy() for x in pc.list_flatten(postings).flatten())
            sums = np.bincount(row * groups + group, weight, (n + PASSAGE - 1) * groups).reshape(-1, groups)
            # behind the end of a text stand words of the next one, which only raise the bound
            bound = sum(sums[i:i + n] for i in range(PASSAGE))
            row, group = np.divmod(np.flatnonzero(bound >= threshold - LIGHT - 1e-4), groups)
            text = np.searchsorted(step_ends, row + first, side="right")
            at = row + first - first_step[text]
            real = at <= np.maximum(steps - PASSAGE, 0)[text]
            yield from zip(text[real].tolist(), at[real].tolist(), group[real].tolist())

    def leaks(self, text: str, threshold: float = THRESHOLD, overlap: float = OVERLAP):
        """Leaked items of a text: item id -> (best score, first word of the passage, question and answer overlap)."""
        return dict(self.leaks_in(pa.array([text], pa.string()), threshold, overlap)).get(0, {})

    def leaks_in(self, texts: pa.Array, threshold: float = THRESHOLD, overlap: float = OVERLAP):
        """Row number and leaks, as of one text, of all texts that have any; null is an empty text."""
        texts = pc.fill_null(texts, "")
        ids, ends = self.numbers(texts)
        starts = np.append(0, ends[:-1])
        out: dict[int, dict[int, tuple[float, int, float, float]]] = {}
        if self.short:
            for row, (text, n) in enumerate(zip(texts.to_pylist(), (ends - starts).tolist())):
                if n and (found := self.short_leaks(text, n)):
                    out[row] = found
        last, last_row, terms, words = None, None, [], []
        for row, at, group in self.passages(ids, ends, threshold):
            if (row, at) != last:
                lo = starts[row] + at * STEP
                terms, last = sorted(set(ids[lo:min(lo + PASSAGE * STEP, ends[row])].tolist()) - {0}), (row, at)
            # the distinct terms bound the score more tightly than the heavy words did
            if self.most[terms, group].sum() < threshold - 1e-4:
                continue
            lo = group * self.group
            for d, score in self.retrieve(terms, lo, min(lo + self.group, len(self.items)), threshold):
                item_id, cut, q, a = self.items[d]
                found = out.get(row, {})
                if item_id in found and found[item_id][0] >= score:
                    continue
                if row != last_row:
                    words, last_row = words_of(texts[row].as_py()), row
                near = words[max(0, at * STEP - len(cut)):(at + PASSAGE) * STEP + len(cut)]
                share = [share_in(q, near), share_in(a, near)]
                if min(share) >= overlap:
                    out.setdefault(row, {})[item_id] = (score, at * STEP, *share)
        return sorted(out.items())

    def short_leaks(self, text: str, n_words: int) -> dict[int, tuple[float, int, float, float]]:
        """The items of under LEAST_WORDS words that are a line, or all, of a text of n_words words."""
        out, at = {}, 0
        lines = [words_of(line) for line in text.splitlines()]
        for line in [*lines, words_of(text)] if n_words < LEAST_WORDS else lines:
            for item_id in self.short.get(tuple(line), ()):
                out.setdefault(item_id, (1.0, min(at, n_words - len(line)), 1.0, 1.0))
            at += len(line)
        return out


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", question_col: str | None = None,
            answer_col: str | None = None, index_bytes: int = INDEX_BYTES):
    """Indexes over the items, each of bounded size; null, empty and wordless items are left out.

    A question and an answer column, if given, replace the halves of the text.
    """
    q = F.coalesce(F.col(question_col or text_col), F.lit(""))
    a = F.coalesce(F.col(answer_col), F.lit("")) if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("i"), q.alias("q"), a.alias("a")).where(
        F.col("i").isNotNull() & (F.length("q") + F.coalesce(F.length("a"), F.lit(0)) > 0)).distinct()
    total = rows.agg(F.sum(F.octet_length("q") + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    blocks = -(-total // index_bytes)
    if blocks > 1:
        rows = durable(rows, "benchmark")
        parts = durable(_parts(rows), "benchmark-parts")
        n, mean = parts.agg(F.count(F.lit(1)), F.avg("n_words")).first()
        counts = durable(parts.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")), "benchmark-words")
    for b in range(blocks):
        items = []
        for r in rows.where(F.pmod(F.xxhash64("i", "q"), F.lit(blocks)) == b).collect():
            words = words_of(r.q)
            half = (len(words) + 1) // 2
            items.append((r.i, words, words_of(r.a)) if r.a is not None else (r.i, words[:half], words[half:]))
        statistics = None
        if blocks > 1:
            used = small_table(benchmark.sparkSession, w=pa.array(sorted({w for _, x, y in items for w in (*x, *y)}), pa.string()))
            df = {r.w: r.df for r in counts.join(F.broadcast(used), "w").collect()}
            statistics = df, n, mean
        yield Index(sorted(items), statistics)


def _parts(rows: DataFrame) -> DataFrame:
    """n_words and distinct words of every part of every item."""
    schema = pa.schema([("n_words", pa.int64()), ("words", pa.list_(pa.string()))])

    def run(batches):
        for q, a in rows_in(batches, "q", "a"):
            words = words_of(q) + words_of(a or "")
            if len(words) >= LEAST_WORDS:
                cuts = [words[at:end] for at, end in part_ends(len(words))]
                yield to_arrow(schema, [[len(c) for c in cuts], [sorted(set(c)) for c in cuts]])

    return rows.mapInArrow(run, "n_words bigint, words array<string>")


def is_leaked(text: Column, index: Index) -> Column:
    """Whether a text holds an item of the index; false for null and empty texts."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        leaked = np.zeros(len(texts), bool)
        at = 0
        for part in slices(pa.record_batch([texts], ["text"]), limit=TEXT_BYTES):
            leaked[[at + row for row, _ in index.leaks_in(part.column("text"))]] = True
            at += part.num_rows
        return pa.array(leaked)

    return run(text)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **columns) -> DataFrame:
    """The rows of docs without a leaked item, in one pass per index and without a shuffle.

    Null and empty texts and repeated rows stay or go like any others; long texts are read whole. With an
    empty benchmark all rows stay. What one index leaves is written before the next is made.
    """
    for i, index in enumerate(indexes(benchmark, **columns)):
        docs = (stage(docs, "unleaked") if i else docs).where(~is_leaked(F.col(text_col), index))
    return docs


HITS = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("word", pa.int32()),
                  ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
HITS_SQL = "d bigint, h bigint, item_id bigint, score double, word int, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """One row per document and leaked item: doc_id, h, item_id, score, word, question_overlap, answer_overlap.

    h is the hash of the text. Repeated rows give repeated results; null ids are kept. An empty
    table on either side gives no rows.
    """
    rows = documents(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("d"), text_hash(F.col("text")).alias("h"), "text")

    def search(index):
        def run(batches):
            for part in (part for batch in batches for part in slices(batch, limit=TEXT_BYTES)):
                hits = [(part["d"][row].as_py(), part["h"][row].as_py(), item_id, *leak)
                        for row, found in index.leaks_in(part["text"]) for item_id, leak in found.items()]
                if hits:
                    yield to_arrow(HITS, list(zip(*hits)))

        return run

    found = []
    for index in indexes(benchmark, **columns):
        if found:     # one index in a plan
            found[-1] = stage(found[-1], "leaks")
        found.append(rows.mapInArrow(search(index), HITS_SQL))
    found = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], HITS_SQL)
    return found.withColumnRenamed("d", "doc_id")
