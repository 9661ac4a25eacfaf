"""The model cell table: one row per (snapshot, level, row, column)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable, inside_ranges, join_checked, ranges_of, recorded
from ..functions.columns import missing_to_null
from ..model import FILL_VALUE, GRID

CELL_SCHEMA = (
    "iter INT, iz INT, iy INT, ix INT, "
    "UVEL DOUBLE, VVEL DOUBLE, THETA DOUBLE, SALT DOUBLE, WVEL DOUBLE"
)


# The date of snapshot 0 and the seconds of a model step.
REF_DATE, DELTA_T = "2012-10-01", 300

# Folder columns of a stored cell table: the snapshots a folder may hold.
PARTS = ("iter_from", "iter_to")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell table from Parquet (column pruning and range predicates reach the files)."""
    return spark.read.schema(CELL_SCHEMA).parquet(path)


def write_cells(cells: DataFrame, path: str, iters_per_part: int = 288) -> None:
    """Store cells so that readers skip what they do not need.

    Snapshot ranges become folders; inside them files are ranges of rows and columns,
    so a box around an array touches few row groups. A small table beside them lists
    every snapshot and its folder (`read_snapshots`).
    """
    first = (F.floor(F.col("iter") / iters_per_part) * iters_per_part).cast("int")
    (cells.withColumn("iter_from", first)
     .withColumn("iter_to", F.col("iter_from") + (iters_per_part - 1))
     .repartitionByRange("iter_from", "iy", "ix", "iter")
     .sortWithinPartitions("iter_from", "iy", "ix", "iz", "iter")
     .write.partitionBy(*PARTS).parquet(path))
    spark = cells.sparkSession
    stored = spark.read.schema(f"iter INT, {', '.join(f'{c} INT' for c in PARTS)}").parquet(path)
    stored.distinct().write.parquet(_index_path(path))


def _index_path(path: str) -> str:
    return path.rstrip("/") + "-snapshots"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(iter, iter_from, iter_to): the snapshots of a stored cell table, without reading cells."""
    return spark.read.schema(f"iter INT, {', '.join(f'{c} INT' for c in PARTS)}").parquet(_index_path(path))


def select_snapshots(snapshots: DataFrame, iters=None, start: str | None = None, end: str | None = None, stride: int = 1,
                     ref_date: str = REF_DATE, delta_t: int = DELTA_T) -> DataFrame:
    """The snapshots asked for, as in `load_model`; a stride counts those there are, however spaced.

    Places are counted inside each folder and shifted by the number of earlier snapshots, so only one
    row per folder meets in one task.
    """
    df = _bounded(snapshots, iters, start, end, ref_date, delta_t)
    if stride > 1:
        per = df.groupBy("iter_from").agg(F.count(F.lit(1)).alias("n"))
        earlier = Window.orderBy("iter_from").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per.select("iter_from", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        place = F.row_number().over(Window.partitionBy("iter_from").orderBy("iter")) - 1
        df = (df.withColumn("place", place).join(offsets, "iter_from")
              .filter((F.col("place") + F.col("before")) % stride == 0))
    return df.select("iter", *PARTS)


def snapshot_times(snapshots: DataFrame, ref_date: str = REF_DATE, delta_t: int = DELTA_T) -> DataFrame:
    """(time) of the given snapshots."""
    return snapshots.select(_stamp(ref_date, delta_t).alias("time"))


def _stamp(ref_date: str, delta_t: int):
    seconds = (F.col("iter") * F.lit(int(delta_t))).cast("decimal(18,6)")
    return F.lit(ref_date).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def _bounded(df: DataFrame, iters, start, end, ref_date: str, delta_t: int) -> DataFrame:
    """Bounds on the snapshot number, and on the folders if df names them."""
    zero = datetime.fromisoformat(ref_date)
    lo = None if start is None else -(-int((label_span(start)[0] - zero).total_seconds()) // delta_t)
    hi = None if end is None else -(-int((label_span(end)[1] - zero).total_seconds()) // delta_t) - 1
    for bound, test, folder in ((lo, F.col("iter") >= F.lit(lo), "iter_to"), (hi, F.col("iter") <= F.lit(hi), "iter_from")):
        if bound is not None:
            df = df.filter(test)
            if folder in df.columns:
                df = df.filter(F.col(folder) >= bound if folder == "iter_to" else F.col(folder) <= bound)
    if iters is not None:
        ends = (iters[0], iters[-1]) if isinstance(iters, range) else iters  # a range may be as long as all numbers
        lo, hi = min(ends), max(ends)
        df = df.filter(F.col("iter").between(lo, hi))
        if set(PARTS) <= set(df.columns):
            df = df.filter((F.col("iter_to") >= lo) & (F.col("iter_from") <= hi))
        if not isinstance(iters, range):
            df = df.filter(F.col("iter").isin([int(i) for i in iters]))
        elif abs(iters.step) > 1:
            df = df.filter((F.col("iter") - lo) % abs(iters.step) == 0)
    return df


def label_span(label: str) -> tuple[datetime, datetime]:
    """Start of the span an ISO label names, and start of what follows it."""
    if len(label) not in _LABEL_UNITS:
        raise ValueError(f"unsupported time label {label!r}")
    start = datetime.fromisoformat(label + _LABEL_PAD[len(label):])
    unit = _LABEL_UNITS[len(label)]
    if unit == "YEAR":
        return start, start.replace(year=start.year + 1)
    if unit == "MONTH":
        return start, (start + timedelta(days=32)).replace(day=1)
    return start, start + timedelta(**{unit.lower() + "s": 1})


def load_model(cells: DataFrame, iters=None, ref_date: str = REF_DATE, delta_t: int = DELTA_T, fill: float = FILL_VALUE,
               start: str | None = None, end: str | None = None, stride: int = 1, every: int | None = None,
               snapshots: DataFrame | None = None) -> DataFrame:
    """Select snapshots, stamp their time, and turn fill values into NULL.

    Only data columns are masked, never the cell indices. `iters` is a range or list of
    snapshot numbers. start and end are ISO labels, both inclusive, as in `time_slice`;
    stride keeps every so many snapshots of a table with one every `every` steps, counted
    from the first at or after start. All become bounds and tests on the snapshot number,
    which skip folders and row groups of a stored table. snapshots: those to keep, from
    `select_snapshots`; Spark skips the folders of all others at run time.
    """
    df = _bounded(cells, None, start, end, ref_date, delta_t)
    if stride > 1:
        if not every:
            raise ValueError("a stride on snapshot numbers needs their spacing, or select_snapshots")
        first = df.agg(F.min("iter")).first()[0]
        df = df.filter((F.col("iter") - F.lit(first)) % (stride * every) == 0)
    df = _bounded(df, iters, None, None, ref_date, delta_t)
    if snapshots is not None:
        keys = [c for c in ("iter_from", "iter") if c in df.columns]
        table, size = recorded(snapshots.select(*keys), "snapshots", **ranges_of(*keys))
        near = inside_ranges(size, *keys)  # a filter on both sides: only then are folders skipped at run time
        df = join_checked(df.filter(near), table.filter(near), keys, size["n"], how="left_semi")
    time = _stamp(ref_date, delta_t)
    data = [c for c in df.columns if c in GRID]
    rest = [c for c in df.columns if c not in GRID and c not in PARTS]
    return df.select(*rest, time.alias("time"),
                     *[missing_to_null(F.col(c), fill).alias(c) for c in data])


# Length of an ISO label -> unit it names.
_LABEL_UNITS = {4: "YEAR", 7: "MONTH", 10: "DAY", 13: "HOUR", 16: "MINUTE", 19: "SECOND"}
_LABEL_PAD = "0000-01-01T00:00:00"


def _label_start(label: str):
    full = label + _LABEL_PAD[len(label):]
    return F.lit(full.replace("T", " ")).cast("timestamp_ntz")


def time_slice(df: DataFrame, start: str | None = None, end: str | None = None, steps=(REF_DATE, DELTA_T)) -> DataFrame:
    """Rows between two ISO labels, both inclusive.

    A label names a span: an end of '2012-11-11' keeps that whole day, '2012-11' the month. Cells that still
    carry their snapshot number are bounded by it as well, which reaches the scan.
    """
    if "iter" in df.columns and steps is not None:
        df = _bounded(df, None, start, end, *steps)
    if start is not None:
        df = df.filter(F.col("time") >= _label_start(start))
    if end is not None:
        if len(end) not in _LABEL_UNITS:
            raise ValueError(f"unsupported time label {end!r}")
        unit = _LABEL_UNITS[len(end)]
        df = df.filter(F.col("time") < _label_start(end) + F.expr(f"INTERVAL 1 {unit}"))
    return df


def time_stride(df: DataFrame, step: int) -> DataFrame:
    """Keep every step-th distinct time, counted from the first.

    Positions are counted inside each day and shifted by the number of earlier times;
    only the per-day totals (one row per day) meet in one task.
    """
    times = df.select("time").distinct().withColumn("day", F.to_date("time"))
    per_day = times.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_day.select("day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    in_day = F.row_number().over(Window.partitionBy("day").orderBy("time"))
    kept = (times.withColumn("pos", in_day - 1).join(offsets, "day")
            .filter((F.col("pos") + F.col("before")) % step == 0).select("time"))
    return join_checked(df, durable(kept, "stride"), ["time"], how="left_semi")


def crop(df: DataFrame, **bounds) -> DataFrame:
    """Inclusive range filter on coordinate columns: crop(df, lon=(217, 223), lat=(-3, 3))."""
    for c, (lo, hi) in bounds.items():
        df = df.filter(F.col(c).between(lo, hi))
    return df
