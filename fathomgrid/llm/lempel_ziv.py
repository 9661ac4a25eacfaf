"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each is the longest phrase seen before plus one byte.
The set of phrases stands for what a compressor learns from the text; texts that share much of it
would compress well together. A fingerprint is the signature of minimum hashes over the phrase
set, and the likeness of two fingerprints, the share of equal minima, estimates the overlap of the
sets.

Phrases are numbered in a trie, so parsing costs one lookup per byte and can go on from the middle
of a text with another ending; a phrase's hash is made from its parent's when it is entered.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, mix, rows_in, text_hash, to_arrow
from .near_duplicates import hash_family, minima

MINIMA = 64
RANGE_CHARS = 16 << 20     # characters in a range of documents
RANGES = 10_000            # at most; a range is read row by row, so it may be long
EXACT = 1 << 53            # ids below are exact as doubles
_MASK = (1 << 61) - 1
_GROW = 0x1E3779B97F4A7C15 & _MASK


class Phrases:
    """Phrases of the bytes fed so far: a trie of numbered phrases, and the hash of each."""

    __slots__ = ("child", "hashes", "state")

    def __init__(self, child=(), hashes=(0,), state: int = 0):
        self.child, self.hashes, self.state = dict(child), list(hashes), state

    def copy(self) -> Phrases:
        return Phrases(self.child, self.hashes, self.state)

    def feed(self, data: bytes) -> Phrases:
        child, hashes, at = self.child, self.hashes, self.state
        find = child.get
        for b in data:
            key = at << 8 | b
            now = find(key)
            if now:
                at = now
            else:
                child[key] = len(hashes)
                hashes.append((hashes[at] + b + 1) * _GROW & _MASK)
                at = 0
        self.state = at
        return self

    def signature(self, family) -> np.ndarray:
        """Minimum hashes; a last phrase that was seen before adds nothing. No phrases: all ones."""
        return minima(mix(np.array(self.hashes[1:], np.uint64)), family).astype(">u4")


def phrase_signature(text: str) -> np.ndarray:
    return Phrases().feed(text.encode()).signature(hash_family(MINIMA))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (hex of the minima) of every row; null texts are empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        family = hash_family(MINIMA)
        for doc_id, text in rows_in(batches, "doc_id", "text"):
            yield to_arrow(schema, [[doc_id], [Phrases().feed(text.encode()).signature(family).tobytes().hex()]])

    rows = documents(docs, id_col, text_col).select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, "doc_id bigint, fingerprint string")


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                 ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT_SQL = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _compare(batches):
    """Rows come by part, in descending order; the last of a part is only the next of the one before."""
    family, last, out = hash_family(MINIMA), None, []
    for part, extra, doc_id, text in rows_in(batches, "part", "extra", "doc_id", "text"):
        half = len(text) - len(text) // 2
        head = Phrases().feed(text[:half].encode())
        whole = head.copy().feed(text[half:].encode())
        now = (part, doc_id, text, text[:half], head, whole.signature(family))
        if last is not None and last[0] == part:
            _, before_id, before, kept, state, own = last
            tail = text[:len(before) // 2]
            edited = state.feed(tail.encode()).signature(family)
            out.append((before_id, len(before), hashlib.sha256((kept + tail).encode()).hexdigest(), own.tobytes().hex(),
                        edited.tobytes().hex(), likeness(own, edited), likeness(own, now[5])))
        last = None if extra else now
        if len(out) == 500:
            yield to_arrow(OUT, [list(c) for c in zip(*out)])
            out = []
    if out:
        yield to_arrow(OUT, [list(c) for c in zip(*out)])


def compare_neighbours(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's.

    The order is by descending id (null ids last), then hash of the text; the next of the last
    document is the first. Documents are cut into ranges of the order at approximate quantiles of
    the id, as many as their characters ask for; an id that fills several ranges (null, say) is cut
    on by the hash. One row per range, its first, is also sent to the range before, so that neighbours
    meet without a window over the whole table; nothing but range bounds passes through the driver.
    Rows with equal id and text form one place in the order each, and stay in one range.
    An id beyond 2**53 in size that fills several ranges is not cut on.
    """
    spark = docs.sparkSession
    doc_id = F.col("doc_id")
    # a double gives the ranges; inside, ids are ordered by their complement, which no id overflows
    rows = documents(docs, id_col, text_col).withColumn("doc_id", doc_id.cast("bigint")).select(
        "doc_id", "text", F.coalesce(-doc_id.cast("double"), F.lit(2.0 ** 64)).alias("near"), doc_id.isNull().alias("none"),
        F.coalesce(F.bitwise_not(doc_id), F.lit(0)).alias("o"), text_hash(F.col("text")).alias("h"))
    if parts is None:
        chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
        parts = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS)))
    cuts = rows.agg(F.percentile_approx("near", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    if cuts is None:
        return spark.createDataFrame([], OUT_SQL)
    times = Counter(cuts)
    part = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(times))), lambda c: c < F.col("near")))
    # a cut that stands k times holds k ranges of one id: it gets slices by the hash
    widest = max(times.values())
    slice_of = F.lit(0)
    for cut, k in times.items():
        if k > 1 and (abs(cut) < EXACT or cut == 2.0 ** 64):
            slice_of = F.when(F.col("near") == cut, F.floor((F.col("h") / 2.0 ** 64 + 0.5) * k).cast("int") + 1).otherwise(slice_of)
    rows = rows.withColumn("place", part * (widest + 2) + slice_of)
    heads = rows.groupBy("place").agg(F.min(F.struct("none", "o", "h")).alias("m")).toPandas().sort_values("place")
    used, heads = heads.place.tolist(), [tuple(m) for m in heads.m]
    firsts = spark.createDataFrame([(p, i, *m) for i, (p, m) in enumerate(zip(used, heads))], "place int, part int, none boolean, o bigint, h bigint")
    rows = rows.join(F.broadcast(firsts.select("place", "part")), "place")
    also = rows.join(F.broadcast(firsts.drop("place")), ["part", "none", "o", "h"]).dropDuplicates(["part", "none", "o", "h"])
    columns = ["doc_id", "none", "o", "h", "text"]
    both = rows.select("part", F.lit(False).alias("extra"), *columns).unionByName(
        also.select(F.pmod(F.col("part") - 1, F.lit(len(used))).alias("part"), F.lit(True).alias("extra"), *columns))
    return (both.repartitionById(len(used), F.col("part")).sortWithinPartitions("part", "extra", "none", "o", "h")
            .select("part", "extra", "doc_id", "text").mapInArrow(_compare, OUT_SQL))
