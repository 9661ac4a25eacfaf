"""Near-duplicates by MinHash, banding, verification on full shingle sets, and components.

1. One pass turns a text into its set of shingles (as 64-bit hashes) and the minima of universal
   hash functions over that set.
2. Documents with equal sets are one class; only its least id goes on, so exact copies cost nothing
   more and are never expanded into pairs.
3. Bands of minima are buckets. Up to four documents of each bucket, drawn by hash, are its centres; every
   other document is paired with them, so a bucket of any size makes a number of pairs in
   proportion to it. Pairs are verified on the full sets, and linked ones give first components.
4. Buckets of any size that still hold several components may hide links between documents that
   were not centres. There, every document outside the bucket's commonest component is compared with all
   others of the bucket on 8-bit sketches of the minima, in blocks of bounded size inside tasks. Likely pairs
   of different components are verified there too, each in the first bucket that both share, so that only links
   leave a task, fewer than it holds documents.
5. Components over all verified links, by alternating stars.

With the default bands a link at the threshold is missed with a probability below one in a million.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free_names, mix, rows_in, stage, text_hash, to_arrow
from .components import components

CENTRES = 4
MEMBERS, OTHERS = 512, 4096       # block sizes of the comparison inside buckets, in documents of ordinary length
ORDINARY = 4096                   # bytes of such a document; a longer one counts as several


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, least similarity in percent, bands and minima of a band."""

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5      # a link at 0.8 is missed with a probability of 1e-7

    @property
    def minima(self) -> int:
        return self.bands * self.rows


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle; no words, none.

    Of bytes, lower() changes A to Z only, and split() cuts at the six ASCII white spaces only.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def hash_family(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], \
        rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]


def minima(found: np.ndarray, family) -> np.ndarray:
    """Least value a * x + b mod 2**32 of every hash function over a set of scrambled numbers."""
    a, b = family
    out, x = np.full(len(a), 0xFFFFFFFF, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 128):
        part = a * x[at:at + 128]
        part += b
        np.minimum(out, part.min(1), out=out)
    return out


CLASSES = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])
SETS = pa.schema([("c", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64())), ("text", pa.string())])


def _batched(rows, schema, size=500):
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield to_arrow(schema, [list(c) for c in zip(*out)])
            out = []
    if out:
        yield to_arrow(schema, [list(c) for c in zip(*out)])


def _classes(rule: Rule):
    """Size of every set and 128 bits that equal sets share."""

    def rows(batches):
        known = WordHashes()
        for d, h, text in rows_in(batches, "d", "h", "text"):
            found = shingles(text, rule.words, known)
            yield d, h, len(found), int(mix(found).sum().view(np.int64)), int(mix(found + np.uint64(77)).sum().view(np.int64))

    return lambda batches: _batched(rows(batches), CLASSES)


def _sets(rule: Rule):
    """Sketch and band keys of every class; the text goes along for the verification."""

    def rows(batches):
        known, family = WordHashes(), hash_family(rule.minima)
        salt = np.arange(1, rule.bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        for c, text in rows_in(batches, "c", "text"):
            least = minima(shingles(text, rule.words, known), family)
            bands = salt.copy()
            for i in range(rule.rows):
                bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + least.reshape(rule.bands, rule.rows)[:, i])
            yield c, mix(least.astype(np.uint64)).astype(np.uint8).tobytes(), bands.view(np.int64), text

    return lambda batches: _batched(rows(batches), SETS)


def _linked(rule: Rule):
    """Verified pairs, from rows with both texts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches):
        known, recent = WordHashes(), {}

        def of(c, text):
            if c not in recent:
                if len(recent) > 200:
                    recent.clear()
                recent[c] = shingles(text, rule.words, known)
            return recent[c]

        for a, b, x, y in rows_in(batches, "a", "b", "x", "y"):
            x, y = of(a, x), of(b, y)
            if 100 * min(len(x), len(y)) >= rule.percent * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= rule.percent * (len(x) + len(y) - both):
                    yield a, b

    return lambda batches: _batched(rows(batches), schema)


def _hidden(rule: Rule, floor: float):
    """Verified links between components, from rows ordered by block; no more than join what a block holds."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = int(rule.minima * (floor + (1 - floor) / 256))

    def linked(x: np.ndarray, ys: list) -> np.ndarray:
        """Which of the sets ys are similar enough to the set x."""
        sizes = np.array([len(y) for y in ys])
        flat = np.concatenate(ys)
        found = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
        both = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
        return 100 * both >= rule.percent * (len(x) + sizes - both)

    def run(batches):
        known = WordHashes()
        rows = rows_in(batches, "band", "block", "other", "side", "c", "component", "sketch", "bands", "text")
        for (band, _, _), group in groupby(rows, key=lambda r: r[:3]):
            members, others = [], []
            for r in group:
                (members if r[3] == MEMBER else others).append(r)
            if not members or not others:
                continue
            table = np.frombuffer(b"".join(r[6] for r in others), np.uint8).reshape(len(others), -1)
            bands = np.array([r[7] for r in others], np.int64)
            ids, comps = np.array([r[4] for r in others]), np.array([r[5] for r in others])
            rare = np.array([r[3] == RARE for r in others])
            few = len(others) <= CENTRES + 1  # few are all verified
            roots, sets, a, b = {}, {}, [], []

            def root(c):
                while c in roots:
                    c = roots[c]
                return c

            for r in members:
                near = comps != r[5]
                near &= ~rare | (ids > r[4])  # two rare documents meet twice
                if not few:
                    near &= (table == np.frombuffer(r[6], np.uint8)).sum(1) >= least
                at = np.flatnonzero(near)
                if len(at) and not few:
                    before = r[7].index(band)
                    at = at[~(bands[at, :before] == np.array(r[7][:before], np.int64)).any(1)]
                own = None
                for k in range(0, len(at), 64):
                    mine = root(r[5])
                    part = [j for j in at[k:k + 64].tolist() if root(int(comps[j])) != mine]
                    for j in part:
                        if j not in sets:
                            sets[j] = shingles(others[j][8], rule.words, known)
                    if part:
                        own = shingles(r[8], rule.words, known) if own is None else own
                        for j in np.array(part)[linked(own, [sets[j] for j in part])].tolist():
                            mine, its = root(r[5]), root(int(comps[j]))
                            if mine != its:
                                roots[max(mine, its)] = min(mine, its)
                                a.append(min(r[4], int(ids[j])))
                                b.append(max(r[4], int(ids[j])))
            if a:
                yield to_arrow(schema, [a, b])

    return run


MEMBER, COMMON, RARE = 0, 1, 2  # sides of a block: rows of no common component, and all rows of the two kinds


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d, h, n_shingles, component_id of every distinct (id, text).

    d is the id; null ids count as the least long and so are the least of their component. A text
    without words has no shingles and is linked with nothing.
    """
    rows = documents(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("d"), text_hash(F.col("text")).alias("h"), "text")
    members = stage(rows.mapInArrow(_classes(rule), "d bigint, h bigint, n bigint, c1 bigint, c2 bigint"), "classes")
    # one class per set; its id c is a hash that two equal sets share
    cls = F.xxhash64("c1", "c2", "n")
    least = members.where("n > 0").groupBy(cls.alias("c")).agg(F.min(F.struct("d", "h")).alias("first"))
    first = least.select("c", F.col("first.d").alias("d"), F.col("first.h").alias("h"))
    reps = stage(rows.join(first, ["d", "h"]).dropDuplicates(["d", "h"]).select("c", "text")
                 .mapInArrow(_sets(rule), "c bigint, sketch binary, bands array<bigint>, text string"), "sets")
    weight = F.ceil((F.octet_length("text") + 1) / ORDINARY).alias("weight")
    buckets = reps.select("c", weight, F.explode("bands").alias("band"))
    several = buckets.groupBy("band").agg(
        F.count(F.lit(1)).alias("size"), *(F.min_by("c", F.xxhash64("c", F.lit(i))).alias(f"z{i}") for i in range(CENTRES))
    ).where("size > 1").select("band", "size", F.array_distinct(F.array(*(f"z{i}" for i in range(CENTRES)))).alias("centres"))
    buckets = stage(buckets.join(several, "band"), "buckets")
    pairs = (buckets.select("c", F.explode("centres").alias("z")).where("c != z")
             .select(F.least("c", "z").alias("a"), F.greatest("c", "z").alias("b")).distinct())

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = (pairs.join(reps.select(F.col("c").alias("a"), F.col("text").alias("x")), "a")
                .join(reps.select(F.col("c").alias("b"), F.col("text").alias("y")), "b"))
        return stage(both.select("a", "b", "x", "y").mapInArrow(_linked(rule), "a bigint, b bigint"), name)

    links = verified(pairs, "links")
    found = stage(components(links), "components")
    # the minima of several hashes may be one document, also in a small bucket
    rest = (buckets.where(F.col("size") > F.size("centres") + 1).where(~F.array_contains("centres", F.col("c")))
            .join(found.select(F.col("node").alias("c"), "component"), "c", "left")
            .select("band", "c", "weight", F.coalesce("component", "c").alias("component")))
    sizes = rest.groupBy("band", "component").agg(F.sum("weight").alias("k"))
    mixed = stage(sizes.groupBy("band").agg(F.count(F.lit(1)).alias("comps"), F.sum("k").alias("total"),
                                            F.max_by("component", F.struct("k", "component")).alias("common"), F.max("k").alias("most"))
                  .where("comps > 1").select("band", "common", (F.col("total") - F.col("most")).alias("rare"), "total"), "mixed")
    if mixed.limit(1).count():
        slot = lambda n, size: F.pmod(F.xxhash64("c", F.lit(3)), F.ceil(n / size).cast("bigint")).cast("int")
        rows = rest.join(mixed, "band").join(reps.select("c", "sketch", "bands", "text"), "c")
        blocks, spans = F.ceil(F.col("rare") / MEMBERS).cast("int"), F.ceil(F.col("total") / OTHERS).cast("int")
        is_rare, whole = F.col("component") != F.col("common"), ("c", "component", "sketch", "bands", "text")
        # one pass over the rows: as a member, for every span of others, and as one of the others, for every block of members
        as_member = F.when(is_rare, F.transform(F.sequence(F.lit(0), spans - 1), lambda i: F.struct(
            slot(F.col("rare"), MEMBERS).alias("block"), i.alias("other"), F.lit(MEMBER).alias("side")))).otherwise(F.array())
        as_other = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(
            i.alias("block"), slot(F.col("total"), OTHERS).alias("other"), F.when(is_rare, RARE).otherwise(COMMON).alias("side")))
        placed = rows.select("band", F.explode(F.concat(as_member, as_other)).alias("place"), *whole).select("band", "place.*", *whole)
        more = stage(placed.repartition("band", "block", "other").sortWithinPartitions("band", "block", "other", "side")
                     .mapInArrow(_hidden(rule, rule.percent / 100 - 0.13), "a bigint, b bigint"), "more-links")
        found = stage(components(links.unionByName(more)), "components")
    root = found.toDF("c", "root")
    whole = members.withColumn("c", F.when(F.col("n") > 0, cls)).join(root, "c", "left")
    group = F.coalesce("root", "c")
    ids = whole.where("n > 0").groupBy(group.alias("g")).agg(F.min("d").alias("component_id"))
    return (whole.withColumn("g", group).join(ids, "g", "left")
            .select("d", "h", F.col("n").alias("n_shingles"), F.coalesce("component_id", "d").alias("component_id")))


NO_ID = -(1 << 63)


def mark_near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text",
                         names=("_d", "_h", "_n_shingles", "_component")) -> DataFrame:
    """All columns of docs, with the identity (id and text hash), set size and component under names docs does not have."""
    d, h, *_ = names
    found = near_duplicates(docs, rule, id_col, text_col).dropDuplicates(["d", "h"]).toDF(*names)
    me = {d: F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)), h: text_hash(F.coalesce(F.col(text_col), F.lit("")))}
    return docs.withColumns(me).join(found, [d, h], "left")


def drop_near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the least id of their group; of rows equal in id and text one stays."""
    names = free_names(docs, "_d", "_h", "_n_shingles", "_component")
    d, h, _, component = names
    marked = mark_near_duplicates(docs, rule, id_col, text_col, names).where(F.col(d) == F.col(component))
    return marked.dropDuplicates([d, h]).select(*docs.columns)
