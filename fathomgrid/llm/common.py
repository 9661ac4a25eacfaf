"""Helpers shared by the text operators.

Conventions that hold for every operator here:

* Only the named id and text columns are read, so further columns cannot clash with own names.
* Rows are ordered by (id, hash of the text); null ids come first. Rows that share both id and
  text are one document: they get the same result, and every row is returned.
* A null text is an empty text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.durable import durable

__all__ = ["stage", "crc_of_id", "documents", "free_names", "mix", "mix_int", "rows_in", "small_table", "text_hash", "to_arrow"]

# Tasks get these functions with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules["fathomgrid.llm"])

M64 = (1 << 64) - 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder, and free the shuffle files that made it."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return durable(df, name)
    finally:
        spark.conf.set(_CLEANUP, before)


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns every operator works on, as doc_id and text."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_hash(text: Column) -> Column:
    """Second part of a document's identity."""
    return F.xxhash64(text)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of an id written as text; null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0).cast("bigint"))


def rows_in(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names))


def to_arrow(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The given names, lengthened until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def small_table(spark: SparkSession, **columns) -> DataFrame:
    """A DataFrame from a few driver-side arrays of bounded length."""
    return spark.createDataFrame(pa.table(columns))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & M64], np.uint64))[0])
