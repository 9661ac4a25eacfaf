"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id

# Labelled rows a fit uses at most (in expectation, with a margin). Their ids are broadcast: some MB.
MAX_LABELLED = 40_000
_FINE = 1 << 30


def labelled_sample(labels: DataFrame, target: str, modulus: int, held_out: int, max_rows: int = MAX_LABELLED,
                    id_col: str = "doc_id") -> DataFrame:
    """doc_id, label 0/1 and fold of the rows to learn from.

    Rows whose crc32(id as text) mod `modulus` is `held_out` are never returned; fold is that
    remainder. Null labels are left out. Above max_rows a share of the ids is taken by hash; it
    does not depend on the order of rows.
    """
    rows = (labels.where(F.col(target).isNotNull())
            .select(F.col(id_col).alias("doc_id"), F.col(target).cast("int").alias("label"),
                    F.pmod(crc_of_id(F.col(id_col)), F.lit(modulus)).cast("int").alias("fold"))
            .where(F.col("fold") != held_out).groupBy("doc_id", "fold").agg(F.max("label").alias("label")))
    n = rows.count()
    keep = max_rows - 4 * max_rows ** 0.5
    if n > keep:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(_FINE)) < int(_FINE * keep / n))
    return rows
