"""Means, spreads and error summaries of cubes and of estimated against model w."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import inside_ranges, join_checked, measured
from ..grid import Grid
from ..model import ALIAS, GRID
from .distributions import exact_percentiles
from .geometry import nearest_level


def domain_mean(cells: DataFrame, grid: Grid, max_depth: float,
                variables=("UVEL", "VVEL", "WVEL")) -> DataFrame:
    """Mean over time and levels down to max_depth per (iy, ix); each variable on its own axis.

    Levels count equally. One pass: the depth test is a per-level flag, and the range of
    levels that pass it is pushed into the scan.
    """
    deep = F.lit(-float(max_depth))
    flags = grid.axes.filter(F.col("axis").isin(sorted({GRID[v][2] for v in variables}))).groupBy(
        F.col("idx").alias("iz")).agg(
        *[F.max(F.when(F.col("axis") == a, F.col("pos") >= deep)).alias(f"in_{a}")
          for a in sorted({GRID[v][2] for v in variables})])
    size = measured(flags.where(F.greatest(*(c for c in flags.columns if c != "iz"), F.lit(False))), "iz")
    used = cells.select("iz", "iy", "ix", *variables)
    joined = join_checked(used.where(inside_ranges(size, "iz")), flags, ["iz"], size["n"])
    return joined.groupBy("iy", "ix").agg(
        *[F.avg(F.when(F.col(f"in_{GRID[v][2]}"), F.col(v))).alias(ALIAS[v]) for v in variables])


def map_rows(mean: DataFrame, grid: Grid, variables=("UVEL", "VVEL", "WVEL")) -> DataFrame:
    """Mean map in long form with each variable's own coordinates: (variable, iy, ix, lat, lon, value)."""
    names = {ALIAS[v]: v for v in variables}
    rows = mean.unpivot(["iy", "ix"], list(names), "variable", "value")
    where = {alias: GRID[v] for alias, v in names.items()}

    def axis_of(i):
        pairs = [x for alias, g in where.items() for x in (F.lit(alias), F.lit(g[i]))]
        return F.create_map(*pairs)[F.col("variable")]

    x = grid.axes.select(F.col("axis").alias("xa"), F.col("idx").alias("ix"), F.col("pos").alias("lon"))
    y = grid.axes.select(F.col("axis").alias("ya"), F.col("idx").alias("iy"), F.col("pos").alias("lat"))
    located = join_checked(rows.withColumn("xa", axis_of(0)).withColumn("ya", axis_of(1)), x, ["xa", "ix"])
    return (join_checked(located, y, ["ya", "iy"])
            .select("variable", "iy", "ix", "lat", "lon", "value"))


def profile_stats(bias: DataFrame, columns=("w_est", "w_model", "bias")) -> DataFrame:
    """Mean and standard deviation over time per level."""
    return _mean_std(bias, ["config", "k"], columns)


def depth_mean_series(bias: DataFrame, columns=("w_est", "w_model", "bias")) -> DataFrame:
    """Mean and standard deviation over depth per time."""
    return _mean_std(bias, ["config", "time"], columns)


def _mean_std(df, keys, columns):
    return df.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns
                                   for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def error_summary(bias: DataFrame) -> DataFrame:
    """(config, rms, mean_bias, abs_mean_bias, w_est_std, w_model_std)."""
    return bias.groupBy("config").agg(
        F.sqrt(F.avg(F.col("bias") * F.col("bias"))).alias("rms"),
        F.avg("bias").alias("mean_bias"), F.abs(F.avg("bias")).alias("abs_mean_bias"),
        F.stddev_pop("w_est").alias("w_est_std"), F.stddev_pop("w_model").alias("w_model_std"))


def at_nearest_depth(bias: DataFrame, levels: DataFrame, depth: float) -> DataFrame:
    """Rows at the level closest to depth. levels: (config, k, depth)."""
    near = nearest_level(levels, depth)
    return join_checked(bias, near.select("config", "k"), ["config", "k"], how="left_semi")


def abs_limit(values: DataFrame, keys, v: str = "v", prob: float = 0.98) -> DataFrame:
    """Symmetric limit: exact percentile of absolute values per key, (keys..., bound)."""
    absolute = values.select(*keys, F.abs(v).alias("v"))
    return (exact_percentiles(absolute, keys, {"bound": prob}))
