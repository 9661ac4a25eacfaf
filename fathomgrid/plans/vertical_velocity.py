"""Estimated against modelled vertical velocity, for many arrays in one job."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..grid import Grid
from ..operators.summaries import abs_limit, at_nearest_depth, depth_mean_series, profile_stats
from ..operators.velocity import array_divergence, model_w, w_bias, w_from_divergence
from ..sources.cells import time_slice


def w_comparison(cells: DataFrame, grid: Grid, positions: DataFrame, max_depth: float = 70,
                 dz: float = 2, spatial_mean: bool = True, hull: DataFrame | None = None,
                 depth_range=None, time_range=None) -> DataFrame:
    """(config, time, k, depth, w_est, w_model, bias) on the interfaces.

    The estimate comes from one scan of the cells; no per-sensor samples are built. Ranges (see `w_range`)
    bound the scan: w is summed up from the surface, so nothing below the deep end is read, nor any other time.
    """
    if time_range is not None:
        cells = time_slice(cells, *time_range)
    if depth_range is not None:
        layers = max(1, math.floor(-min(depth_range) / dz))
        max_depth = min(max_depth, layers * dz)
        rows = w_comparison(cells, grid, positions, max_depth, dz, spatial_mean, hull)
        return w_range(rows, depth_range)
    estimate = w_from_divergence(array_divergence(cells, grid, positions, max_depth, dz), dz)
    return w_bias(estimate, model_w(cells, grid, positions, max_depth, dz, spatial_mean=spatial_mean,
                                    hull=hull))


def w_range(comparison: DataFrame, depth_range=None, time_range=None) -> DataFrame:
    """Restrict a comparison to depths (shallow, deep), both negative down, and time labels."""
    if time_range is not None:
        comparison = time_slice(comparison, *time_range)
    if depth_range is not None:
        shallow, deep = depth_range
        comparison = comparison.filter(F.col("depth").between(deep, shallow))
    return comparison


def w_comparison_tables(comparison: DataFrame, depth_range=None, time_range=None,
                        point_depth: float = -50) -> dict[str, DataFrame]:
    """The tables behind the comparison figure.

    hovmoller, profiles (mean and spread over time), series (over depth) and point (the
    level nearest to point_depth). The comparison is written once and read by each.
    """
    rows = durable(w_range(comparison, depth_range, time_range), "w-comparison")
    levels = rows.select("config", "k", "depth").distinct()
    return {
        "hovmoller": rows,
        "profiles": profile_stats(rows),
        "series": depth_mean_series(rows),
        "point": at_nearest_depth(rows, levels, point_depth),
    }


def w_limits(comparison: DataFrame) -> DataFrame:
    """(config, what, bound): 98th percentile of |w|, both fields pooled, and of |bias|."""
    pooled = (comparison.unpivot(["config"], ["w_est", "w_model", "bias"], "what", "v")
              .withColumn("what", F.when(F.col("what") == "bias", "bias").otherwise("w")))
    return abs_limit(pooled, ["config", "what"])


def bias_tables(comparison: DataFrame, point_depth: float = -50) -> DataFrame:
    """Bias by time, by depth and at one level, in one long table.

    (config, series, time, k, bias): series is 'by_time', 'by_depth' or 'at_level'.
    """
    comparison = durable(comparison, "w-comparison")
    by_time = comparison.groupBy("config", "time").agg(F.avg("bias").alias("bias"))
    by_depth = comparison.groupBy("config", "k").agg(F.avg("bias").alias("bias"))
    levels = comparison.select("config", "k", "depth").distinct()
    at = at_nearest_depth(comparison, levels, point_depth)
    cols = ["config", "series", "time", "k", "bias"]
    return (by_time.withColumns({"series": F.lit("by_time"), "k": F.lit(None).cast("int")}).select(*cols)
            .unionByName(by_depth.withColumns({
                "series": F.lit("by_depth"), "time": F.lit(None).cast("timestamp_ntz")}).select(*cols))
            .unionByName(at.withColumn("series", F.lit("at_level")).select(*cols)))
