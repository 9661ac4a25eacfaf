"""Tables that outlive executors, and joins whose small side has a checked size.

Intermediate results that several consumers read are written to the folder the
cluster names in ``spark.checkpoint.dir`` and read back, which cuts the lineage:
losing an executor costs a re-read, never a recomputation of the whole job.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Bytes a side may have to be broadcast, and the rows of ordinary width that make them up.
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 1_000_000


def durable_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(root)
    return root


_written: list[str] = []


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables of a run when it ends.

    Results must be written or collected inside; tables made with keep=True stay.
    """
    first = len(_written)
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written[first:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        del _written[first:]


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; `run_scope` deletes what is there unless keep is set."""
    path = f"{durable_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _written.append(path)
    return path


def durable(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Write df once to the shared folder; later reads prune columns and row groups.

    keep: the table outlives the `run_scope` it is made in.
    """
    spark = df.sparkSession
    path = scratch(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def recorded(df: DataFrame, name: str = "table", **aggregates: Column) -> tuple[DataFrame, dict]:
    """`durable`, with the row count (n) and further aggregates taken while writing: no job of their own.

    They are made in the writing tasks, of which each partition counts once, also when tasks are repeated.
    """
    watch = Observation()
    table = durable(df.observe(watch, F.count(F.lit(1)).alias("n"), *[a.alias(k) for k, a in aggregates.items()]), name)
    return table, {"n": 0, **dict.fromkeys(aggregates), **watch.get}


def ranges_of(*cols: str) -> dict[str, Column]:
    """Aggregates for `recorded` that `inside_ranges` reads."""
    return {f"{f.__name__}_{c}": f(c) for c in cols for f in (F.min, F.max)}


def measured(df: DataFrame, *range_cols: str):
    """Row count and the value range of some columns of a small table, in one job."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in range_cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*aggs).first()


def inside_ranges(measure, *cols: str) -> Column:
    """Literal range predicate from `measured`: it reaches the Parquet scan."""
    if measure["n"] == 0:
        return F.lit(False)
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).between(measure[f"min_{c}"], measure[f"max_{c}"])
    return cond


def row_bytes(df: DataFrame) -> int:
    """Width of a row of numbers; text counts as 32 bytes, nested values as 64."""
    wide = {"string": 32, "binary": 32}
    return sum(64 if "<" in kind else wide.get(kind, 8) for _, kind in df.dtypes)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table of this many rows may be broadcast."""
    return rows <= BROADCAST_ROWS and rows * row_bytes(df) <= BROADCAST_BYTES


def join_checked(df: DataFrame, side: DataFrame, keys, rows: int | None = None,
                 how: str = "inner") -> DataFrame:
    """Join df with a side that has few rows per key.

    The side is broadcast only when its counted size is small. Beyond that it is a plain
    equi-join on shuffled keys: adaptive execution splits partitions that a hot key of df
    makes large, and repeats only the matching rows of the other side.
    """
    rows = side.count() if rows is None else rows
    return df.join(F.broadcast(side) if small_enough(side, rows) else side, list(keys), how)


def group_stats_join(df: DataFrame, stats: DataFrame, keys, name: str = "stats") -> DataFrame:
    """Attach per-group aggregates to every row of the table they came from.

    The aggregates are combined map-side and written once; their measured size then
    decides how they are joined back. No window gathers a whole group in one task.
    """
    table, size = recorded(stats, name)
    return join_checked(df, table, keys, size["n"])
