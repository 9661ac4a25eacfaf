"""SentencePiece encoding and decoding: best segmentation by a max-plus scan over chunks.

The segmentation of a text is the path of pieces with the largest sum of scores. The scores come
from the vocabulary file's ranks by Zipf's law, as integers, so that sums are exact in any order.
Characters without a piece fall back to byte pieces, so that decoding gives every text back.

No piece spans a cut: a boundary before a space or beside a line break. A short text is therefore a row
of words; those of many texts that were not met before are solved together, and recurring ones are
looked up. A giant text is cut into chunks. A path crosses a chunk boundary in one of L states, the
number of characters between its last node and the boundary, L being the longest piece. Each chunk
yields an L x L matrix: the best score from each state at its start to each at its end. Max-plus
products of matrices are associative, so a parallel scan over the chunks of a text gives the scores
of all states at every boundary. From these each chunk finds, on its own, from which state at its
start each state at its end is reached; following these small maps back from the end of the text
gives the state at every boundary, and each chunk is traced back independently. All paths through a
chunk meet at its cuts, so only what lies before the first and after the last one depends on states;
between them words are looked up, for their scores and later for their ids. Chunks are rows, so
one giant text is spread over many tasks; only its small matrices and maps meet. Among paths of equal
score the longest last piece wins, in chunks as in whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, mix, rows_in, stage, text_hash, to_arrow

GIANT, CHUNK = 32_768, 8_192       # characters
NEVER = -(1 << 62)
KNOWN_BYTES = 48 << 20             # of looked-up words, in a worker
SOLVED, TOGETHER = 64, 4096        # longest word that is solved together with others, and how many are
LOT = 1 << 18                      # characters of texts handled at once


class Pieces:
    """Vocabulary of a SentencePiece model file, with integer scores."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.n = sp.get_piece_size()
        scale = 1 << 32
        salt = (mix(np.arange(self.n, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.int64).tolist()  # breaks ties
        rank = lambda i: min(-sp.get_score(i), self.n)
        self.table: dict[str, tuple[int, int] | None] = {}
        self.byte = [0] * 256
        self.out: list[bytes] = [b""] * self.n
        for i in range(self.n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte[value], self.out[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                self.table[text] = (int(-math.log(2 + rank(i)) * scale) - salt[i], i)
                self.out[i] = text.encode()
        for text in list(self.table):
            for k in range(1, len(text)):
                self.table.setdefault(text[:k], None)
        self.byte_score = int(-(math.log(2 + self.n) + 10) * scale)
        self.longest = max(map(len, self.table))
        joined = {c for t in self.table if len(t) > 1 for c in t}
        # a cut before a space that follows another character, and on both sides of a line break, crosses no piece
        self.cuts = all(" " not in t.lstrip(" ") for t in self.table) and "\n" not in joined
        self.known: dict[str, tuple[bytes, int]] = {}
        self.held = 0
        # the table as a trie of sorted (node, character) keys
        number = {"": 0}
        for text in self.table:
            number[text] = len(number)
        keys = np.array([number[t[:-1]] << 32 | ord(t[-1]) for t in self.table], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], 1 + order
        self.node_score = np.array([NEVER] + [f[0] if f else NEVER for f in self.table.values()], np.int64)
        self.node_piece = np.array([-1] + [f[1] if f else -1 for f in self.table.values()], np.int64)

    def edges(self, text: str, at: int, end: int):
        """Pieces that start at a position and end by `end`: (next position, score, id or -1 for bytes)."""
        table, any_one = self.table, False
        for j in range(at + 1, min(end, at + self.longest) + 1):
            found = table.get(text[at:j], 0)
            if found == 0:
                break
            if found:
                any_one |= j == at + 1
                yield j, found[0], found[1]
        if not any_one and at < end:
            yield at + 1, self.byte_score * len(text[at].encode()), -1

    def forward(self, text: str, start: int, entry: list[int]) -> dict[int, tuple[int, int]]:
        """Best last piece (its start, its id) of every node beyond `start`; entry[i]: score of node start - i."""
        end, best, back = len(text), {}, {}

        def relax(at, base, beyond):
            for j, score, piece in self.edges(text, at, end):
                if j > beyond and base + score > best.get(j, NEVER):
                    best[j] = base + score
                    back[j] = (at, piece)

        for i in reversed(range(len(entry))):
            if entry[i] > NEVER // 2:
                relax(start - i, entry[i], start)
        for at in range(start + 1, end):
            base = best.pop(at, None)
            if base is not None:
                relax(at, base, at)
        return back

    def walk(self, text: str, back: dict, start: int, node: int) -> tuple[int, list[int]]:
        """Node at or before `start` from which the best path to a node comes, and the ids on the way."""
        ids: list[int] = []
        while node > start:
            node, piece = back[node]
            ids.extend([piece] if piece >= 0 else [self.byte[b] for b in reversed(text[node].encode())])
        return node, ids[::-1]

    def trace(self, text: str) -> tuple[list[int], int]:
        """ids and score of the best path through a whole text; the same as forward and walk from its start."""
        get, longest, n = self.table.get, self.longest, len(text)
        best, back, last = [NEVER] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0
        for at in range(n):
            base, any_one = best[at], False
            for j in range(at + 1, min(n, at + longest) + 1):
                found = get(text[at:j], 0)
                if found:
                    score = base + found[0]
                    if score > best[j]:
                        best[j], back[j], last[j] = score, at, found[1]
                    if j == at + 1:
                        any_one = True
                elif found == 0:
                    break
            if not any_one:
                score = base + self.byte_score * len(text[at].encode())
                if score > best[at + 1]:
                    best[at + 1], back[at + 1], last[at + 1] = score, at, -1
        ids: list[int] = []
        while n:
            at, piece = back[n], last[n]
            ids.extend([piece] if piece >= 0 else [self.byte[b] for b in reversed(text[at].encode())])
            n = at
        return ids[::-1], best[-1]

    def solve(self, words: list[str]) -> list[tuple[bytes, int]]:
        """`trace` of many words at once: all edges of all words, then a step for each position in a word."""
        n = len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, n)
        owner = np.repeat(np.arange(n), sizes)
        first = np.cumsum(sizes) - sizes
        depth = np.arange(len(chars)) - first[owner]
        left = sizes[owner] - depth
        wide = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)

        at, state, edges = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        bytewise = np.ones(len(chars), bool)
        for k in range(1, self.longest + 1):
            inside = left[at] >= k
            at, state = at[inside], state[inside]
            key = state << 32 | chars[at + k - 1]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[slot] == key
            at, state = at[met], self.child[slot[met]]
            piece = self.node_score[state] > NEVER
            edges.append((at[piece], np.full(piece.sum(), k), self.node_score[state[piece]], self.node_piece[state[piece]]))
            if k == 1:
                bytewise[at[piece]] = False
        at = np.flatnonzero(bytewise)
        edges.append((at, np.ones(len(at), np.int64), self.byte_score * wide[at], np.full(len(at), -1)))
        at, length, score, piece = map(np.concatenate, zip(*edges))
        order = np.argsort(depth[at].astype(np.uint16), kind="stable")
        at, length, score, piece = at[order], length[order], score[order], piece[order]

        # a word of m characters has m + 1 nodes; edges of one depth end at different nodes
        source = at + owner[at]
        target = source + length
        best = np.full(len(chars) + n, NEVER, np.int64)
        via = np.zeros(len(chars) + n, np.int64)
        root = first + np.arange(n)
        best[root] = 0
        bounds = np.searchsorted(depth[at], np.arange(int(sizes.max(initial=0)) + 1))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            reached = best[source[lo:hi]] + score[lo:hi]
            better = np.flatnonzero(reached > best[target[lo:hi]])
            best[target[lo + better]] = reached[better]
            via[target[lo + better]] = lo + better

        worth, used, alive = best[root + sizes], [], np.flatnonzero(sizes)
        node = (root + sizes)[alive]
        while len(alive):
            edge = via[node]
            used.append(edge)
            going = source[edge] > root[alive]
            node, alive = source[edge][going], alive[going]
        used = np.concatenate(used) if used else np.zeros(0, np.int64)
        used = used[np.argsort(at[used])]
        piece, at = piece[used], at[used]
        count = np.where(piece < 0, wide[at], 1)
        ids = np.repeat(piece, count)
        raw = "".join(map(chr, chars[at[piece < 0]])).encode()
        ids[ids < 0] = np.array(self.byte)[np.frombuffer(raw, np.uint8)]
        ends = 4 * np.cumsum(np.bincount(owner[at], count, n).astype(np.int64))
        data, ends = ids.astype("<u4").tobytes(), ends.tolist()
        return [(data[a:b], w) for a, b, w in zip([0, *ends], ends, worth.tolist())]

    def learn(self, texts: list[list[str]]) -> dict[str, tuple[bytes, int]]:
        """ids and score of every word of some texts, and of earlier ones."""
        if self.held > KNOWN_BYTES:
            self.forget()
        new = set().union(*texts).difference(self.known)
        short = [w for w in new if len(w) <= SOLVED]
        for at in range(0, len(short), TOGETHER):
            some = short[at:at + TOGETHER]
            self.known.update(zip(some, self.solve(some)))
        for w in new:
            if len(w) > SOLVED:
                ids, score = self.trace(w)
                self.known[w] = np.array(ids, "<u4").tobytes(), score
        self.held += 300 * len(new) + 8 * sum(map(len, new))
        return self.known

    def forget(self) -> None:
        """Free the words; a worker lives on after its task."""
        self.known, self.held = {}, 0

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """ids of texts as little-endian 32-bit numbers; a space is put in front, as the model was made."""
        if not self.cuts:
            return [np.array(self.trace(" " + t)[0] if t else [], "<u4").tobytes() for t in texts]
        split = [_WORDS.findall(" " + t) if t else [] for t in texts]
        known = self.learn(split)
        return [b"".join([known[w][0] for w in words]) for words in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", "replace")[1:]

    def is_cut(self, text: str, at: int) -> bool:
        """Whether no piece can cross this position."""
        return self.cuts and (text[at] == " " != text[at - 1] or text[at] == "\n" or text[at - 1] == "\n")

    def ends(self, text: str, start: int) -> tuple[int, int] | None:
        """First and last cut inside a chunk; every path has a node at both."""
        inside = range(start + 1, len(text))
        first = next((k for k in inside if self.is_cut(text, k)), None)
        return None if first is None else (first, next(k for k in reversed(inside) if self.is_cut(text, k)))

    def middle(self, text: str, start: int) -> list[str]:
        """Words between the first and the last cut."""
        cut = self.ends(text, start)
        return _WORDS.findall(text[cut[0]:cut[1]]) if cut else []

    def scores(self, text: str) -> list[tuple[int, int]]:
        """Characters from a node to the end, and best score, of the nodes less than a piece before the end."""
        get, longest, n = self.table.get, self.longest, len(text)
        best = [NEVER] * (n + 1)
        best[0] = 0
        for at in range(n):
            base, any_one = best[at], False
            for j in range(at + 1, min(n, at + longest) + 1):
                found = get(text[at:j], 0)
                if found:
                    best[j] = max(best[j], base + found[0])
                    any_one |= j == at + 1
                elif found == 0:
                    break
            if not any_one:
                best[at + 1] = max(best[at + 1], base + self.byte_score * len(text[at].encode()))
        return [(n - at, best[at]) for at in range(max(0, n - longest + 1), n + 1)]

    def transfer(self, text: str, start: int, known: dict) -> np.ndarray:
        """Matrix of a chunk that begins at `start` of `text`; what stands before is the end of the last chunk.

        Entry [i, j]: best score from node start - i, leaving it beyond the start, to node end - j. Beyond the
        first cut all states move alike; no path leaves from a node before the last one.
        """
        size, whole, best, cut = self.longest, len(text), {}, self.ends(text, start)
        end = cut[0] if cut else whole
        for i in range(min(size, start + 1)):
            for j, score, _ in self.edges(text, start - i, end):
                if j > start or i == 0:
                    row = best.setdefault(j, np.full(size, NEVER, np.int64))
                    row[i] = max(row[i], score)
        out = np.full((size, size), NEVER, np.int64)
        if start == end:
            out[0, 0] = 0
        for at in range(start + 1, end + 1):
            row = best.pop(at, None)
            if row is None:
                continue
            if cut and at == end:
                between = sum(known[w][1] for w in self.middle(text, start))
                for state, score in self.scores(text[cut[1]:]):
                    out[:, state] = np.where(row > NEVER, row + (between + score), NEVER)
                return out
            if end == whole and end - at < size:
                out[:, end - at] = row
            for j, score, _ in self.edges(text, at, end):
                to = best.get(j)
                more = np.where(row > NEVER, row + score, NEVER)
                best[j] = more if to is None else np.maximum(to, more)
        if end - start < size:
            out[0, end - start] = 0
        return out


_WORDS = re.compile(r" *[^ \n]+|\n| +")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices."""
    out = np.maximum(a[..., :, 0, None] + b[..., None, 0, :], NEVER)
    for k in range(1, a.shape[-1]):
        np.maximum(out, a[..., :, k, None] + b[..., None, k, :], out=out)
    return np.maximum(out, NEVER)


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of all prefixes, by doubling: entry c is the product of matrices 0 to c."""
    out, step = np.maximum(matrices, NEVER // 2), 1
    while step < len(out):
        out = np.concatenate([out[:step], np.maximum(product(out[:-step], out[step:]), NEVER // 2)])
        step *= 2
    return out


def entry_scores(matrices: np.ndarray) -> np.ndarray:
    """Scores of all states at the start of every chunk; the first begins at a node."""
    first = np.full((1, matrices.shape[1]), NEVER, np.int64)
    first[0, 0] = 0
    return np.concatenate([first, scan(matrices)[:-1, 0, :]])


def _chunks(size: int, overlap: int):
    """Chunk rows of giant texts: c, start (of the chunk in its piece of text), text."""
    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("c", pa.int32()), ("start", pa.int32()), ("text", pa.string())])

    def run(batches):
        for d, h, text in rows_in(batches, "d", "h", "text"):
            text = " " + text
            for c, at in enumerate(range(0, len(text), size)):
                first = max(0, at - overlap)
                yield to_arrow(schema, [[d], [h], [c], [at - first], [text[first:at + size]]])

    return run


def _lots(rows, text: int):
    """Rows in lists of about LOT characters; `text` is the place of the text in a row."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[text])
        if size > LOT:
            yield out
            out, size = [], 0
    if out:
        yield out


def _matrices(pieces):
    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("c", pa.int32()), ("matrix", pa.binary())])

    def run(batches):
        for lot in _lots(rows_in(batches, "d", "h", "c", "start", "text"), 4):
            known = pieces.learn([pieces.middle(text, start) for *_, start, text in lot])
            for d, h, c, start, text in lot:
                yield to_arrow(schema, [[d], [h], [c], [pieces.transfer(text, start, known).tobytes()]])
        pieces.forget()

    return run


def _entries(batches):
    """Scores of all states at the start of every chunk, from matrices ordered by document and chunk."""
    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("c", pa.int32()), ("entry", pa.list_(pa.int64()))])
    for (d, h), group in groupby(rows_in(batches, "d", "h", "c", "matrix"), key=lambda r: r[:2]):
        stack = np.array([np.frombuffer(r[3], np.int64) for r in group])
        size = math.isqrt(stack.shape[1])
        scores = entry_scores(stack.reshape(-1, size, size)).tolist()
        yield to_arrow(schema, [[d] * len(scores), [h] * len(scores), range(len(scores)), scores])


def _maps(pieces):
    """For every chunk and state at its end, the state at its start."""
    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("c", pa.int32()), ("origin", pa.list_(pa.int32()))])

    def run(batches):
        for d, h, c, start, text, entry in rows_in(batches, "d", "h", "c", "start", "text", "entry"):
            cut = pieces.ends(text, start)
            if cut:  # all states beyond the last cut come through the first
                back = pieces.forward(text[:cut[0]], start, entry[:start + 1])
                state = start - pieces.walk(text, back, start, cut[0])[0]
                origin = [state if len(text) - j >= cut[1] else -1 for j in range(pieces.longest)]
            else:
                back, origin = pieces.forward(text, start, entry[:start + 1]), []
                for state in range(pieces.longest):
                    node = len(text) - state
                    known = 0 <= node <= start or node in back
                    origin.append(start - pieces.walk(text, back, start, node)[0] if known else -1)
            yield to_arrow(schema, [[d], [h], [c], [origin]])

    return run


def _states(batches):
    """State at the end of every chunk, from maps ordered by document and chunk."""
    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("c", pa.int32()), ("exit", pa.int32())])
    for (d, h), group in groupby(rows_in(batches, "d", "h", "c", "origin"), key=lambda r: r[:2]):
        maps, state, states = [r[3] for r in group], 0, []
        for origin in reversed(maps):
            states.append(state)
            state = origin[state]
        n = len(states)
        yield to_arrow(schema, [[d] * n, [h] * n, range(n), states[::-1]])


def _traced(pieces):
    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("c", pa.int32()), ("ids", pa.binary())])

    def run(batches):
        for lot in _lots(rows_in(batches, "d", "h", "c", "start", "text", "entry", "exit"), 4):
            known = pieces.learn([pieces.middle(text, start) for _, _, _, start, text, _, _ in lot])
            for d, h, c, start, text, entry, leave in lot:
                cut = pieces.ends(text, start)
                head = text[:cut[0]] if cut else text
                back = pieces.forward(head, start, entry[:start + 1])
                ids = pieces.walk(head, back, start, cut[0] if cut else len(text) - leave)[1]
                parts = [np.array(ids, "<u4").tobytes()]
                if cut:
                    parts += [known[w][0] for w in pieces.middle(text, start)]
                    parts.append(np.array(pieces.trace(text[cut[1]:len(text) - leave])[0], "<u4").tobytes())
                yield to_arrow(schema, [[d], [h], [c], [b"".join(parts)]])
        pieces.forget()

    return run


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                     giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, ids (little-endian 32-bit numbers) of every row; a null or empty text has no ids.

    Texts of more than `giant` characters take the way through chunks; the result is the same.
    """
    pieces = Pieces(model_file)  # read once, and sent along with the tasks
    rows = documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.binary())])

    def direct(batches):
        for lot in _lots(rows_in(batches, "doc_id", "text"), 1):
            doc_ids, texts = map(list, zip(*lot))
            yield to_arrow(schema, [doc_ids, texts, pieces.encode_all(texts)])
        pieces.forget()

    short = rows.where(F.char_length("text") <= giant).mapInArrow(direct, "doc_id bigint, text string, ids binary")
    long = rows.where(F.char_length("text") > giant).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), text_hash(F.col("text")).alias("h"), "text")
    parts = stage(long.dropDuplicates(["d", "h"]).mapInArrow(_chunks(chunk, pieces.longest), "d bigint, h bigint, c int, start int, text string")
                  .repartition("d", "h", "c"), "chunks")
    matrices = parts.mapInArrow(_matrices(pieces), "d bigint, h bigint, c int, matrix binary")
    entries = (matrices.repartition("d", "h").sortWithinPartitions("d", "h", "c")
               .mapInArrow(_entries, "d bigint, h bigint, c int, entry array<bigint>"))
    parts = stage(parts.join(entries, ["d", "h", "c"]), "scored-chunks")
    states = (parts.mapInArrow(_maps(pieces), "d bigint, h bigint, c int, origin array<int>")
              .repartition("d", "h").sortWithinPartitions("d", "h", "c").mapInArrow(_states, "d bigint, h bigint, c int, exit int"))
    traced = parts.join(states, ["d", "h", "c"]).mapInArrow(_traced(pieces), "d bigint, h bigint, c int, ids binary")
    whole = traced.groupBy("d", "h").agg(F.expr("listagg(ids) within group (order by c)").alias("ids"))
    return short.unionByName(long.join(whole, ["d", "h"]).select("doc_id", "text", "ids"))


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()),
                     ("ids", pa.list_(pa.int32()))])
ENCODED_SQL = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, round_trip boolean, ids array<int>"


def decode_documents(encoded: DataFrame, model_file: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, whether the decoded ids are the text, and the ids."""

    pieces = Pieces(model_file)

    def run(batches):
        out, size = [], 0
        for doc_id, text, ids in rows_in(batches, "doc_id", "text", "ids"):
            numbers = np.frombuffer(ids, "<u4").astype(np.int32) if with_ids else None
            out.append((doc_id, len(ids) // 4, zlib.crc32(ids), pieces.decode(ids) == text, numbers))
            size += len(ids)
            if size > 1 << 20:
                yield to_arrow(ENCODED, [list(c) for c in zip(*out)])
                out, size = [], 0
        if out:
            yield to_arrow(ENCODED, [list(c) for c in zip(*out)])

    out = encoded.mapInArrow(run, ENCODED_SQL)
    return out if with_ids else out.drop("ids")
