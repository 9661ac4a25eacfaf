"""Importance resampling of documents towards a target distribution.

Words are dictionary indices (`words`); shifted indices form n-grams, each distinct n-gram of a batch
gets its CRC once, extended word by word, and the CRC picks one of a fixed number of buckets. Bucket counts
of all documents and of the target texts give every bucket a gain; a document's weight is the sum
of the gains of its features. Gumbel noise from a hash of the id turns weights into a
draw without replacement: the documents with the highest noisy weights.

Bucket counts leave a task as one row per bucket. Ranks come from ranges of the score cut by Spark: each
range is sorted in its own task and starts at the number of rows above it.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, to_arrow
from .words import Words, slices, words_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
RANGE_ROWS = 200_000

BUCKET_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def features(words: Words, longest: int, buckets: int):
    """For n = 1 to longest: the row and the bucket of every run of n words."""
    code, doc = words.code, words.doc
    used, code = np.unique(code, return_inverse=True)
    texts = [t.encode() for t in pc.take(words.names, pa.array(used)).to_pylist()]
    crc = np.fromiter((zlib.crc32(t) for t in texts), np.int64, len(texts))
    run, run_crc = code, crc
    for n in range(1, longest + 1):
        if n > 1:
            # runs of n - 1 words and the word after them, in one document
            inside = np.flatnonzero(doc[n - 1:] == doc[:len(doc) - n + 1]) if len(doc) >= n else np.zeros(0, np.int64)
            pair, run_of = np.unique(run[inside] * max(len(used), 1) + code[inside + n - 1], return_inverse=True)
            head, tail = np.divmod(pair, max(len(used), 1))
            run_crc = np.fromiter((zlib.crc32(b" " + texts[b], int(c)) for c, b in zip(run_crc[head], tail)), np.int64, len(pair))
            run = np.full(len(doc), 0, np.int64)
            run[inside] = run_of
            yield doc[inside], run_crc[run_of] % buckets
        else:
            yield doc, run_crc[run] % buckets


def _count(longest: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for _, bucket in features(words_of(part.column("text"), SEPARATORS), longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        if len(at):
            yield to_arrow(BUCKET_COUNTS, [at, total[at]])
    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts: a table of fixed size."""
    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(longest, buckets), "bucket int, n bigint")
    total = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed target share over the smoothed source share of each bucket."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


WEIGHTS = [("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())]


def _weigh(gains: np.ndarray, longest: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), SEPARATORS)
                n, weight = np.zeros(words.rows, np.int64), np.zeros(words.rows, np.int64)
                for doc, bucket in features(words, longest, len(gains)):
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    if len(first):
                        weight[doc[first]] += np.add.reduceat(gains[bucket], first)
                        n += np.bincount(doc, minlength=words.rows)
                n_words = np.bincount(words.doc, minlength=words.rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words), pa.array(n), pa.array(weight)],
                                                 names=["doc_id", *(name for name, _ in WEIGHTS)])
    return run


def feature_weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_weigh(gains, longest), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def draw_highest(scored: DataFrame, eligible, numerator: int, denominator: int, order) -> DataFrame:
    """scored with a rank from 1 for the first numerator/denominator of the eligible rows, else null.

    order: columns that decide the order. Rows are cut into ranges of it; the range of a row is written with
    it, so a task that is run again cannot disagree with the counts. Only ranges are counted together, never rows.
    """
    rows = stage(scored.withColumn("_in", F.coalesce(eligible, F.lit(False))), "scored")
    n = rows.where("_in").count()
    asked = n * numerator // denominator
    ranges = max(1, math.ceil(n / RANGE_ROWS), min(n // 1000, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = stage(rows.where("_in").repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    drawn = ranged.join(F.broadcast(before), "_range").withColumn("rank", rank)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= asked, F.col("rank")))
    rest = rows.where("not _in").withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.select(*rest.columns).unionByName(rest).drop("_in")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", longest: int = 1,
             buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): rank from 1 for the drawn documents, else null.

    Of the documents with `least_words` words, percent in a hundred (rounded down) are drawn, those with the highest
    scores; equal scores go by the smaller id. Null texts have no words, weight 0 and are scored too. Null ids are
    hashed as an empty text and come first among equals; repeated rows each get a row, with neighbouring ranks
    if drawn. Empty tables give no rows, an empty target the gains of the smoothing. Further columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    weights = feature_weights(docs, gains, id_col, text_col, longest)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weights.withColumn("score", F.col("weight") + noise)
    drawn = draw_highest(scored, F.col("n_words") >= least_words, percent, 100,
                         [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
