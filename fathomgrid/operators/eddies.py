"""Anomalies, vertical eddy fluxes and their depth integrals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import group_stats_join
from ..functions.columns import correlation, layer_mid
from ..model import TRACERS
from .interpolation import interfaces_to_layers
from .velocity import hull_mean

# Order in which fluxes are reported.
FLUXES = ("wT", "wS", "wU", "wV")


def eddy_anomalies(df: DataFrame, keys, variables=("U", "V", "T", "S")) -> DataFrame:
    """Add Up, Vp, Tp, Sp: value minus its mean over time at the same point and level.

    keys name the point and level, e.g. (config, glider, k) or (config, iy, ix, k).
    """
    present = [v for v in variables if v in df.columns]
    means = df.groupBy(*keys).agg(*[F.avg(v).alias(f"{v}_mean") for v in present])
    return (group_stats_join(df, means, keys, "time-means")
            .withColumns({f"{v}p": F.col(v) - F.col(f"{v}_mean") for v in present})
            .drop(*[f"{v}_mean" for v in present]))


def vertical_eddy_flux(df: DataFrame, keys, w: str = "W", tracers=TRACERS) -> DataFrame:
    """Time mean of w' phi' for each tracer: (keys..., wT, wS, wU, wV).

    Primes are deviations from each series' own mean over its valid times, the product is
    averaged over times where both are valid. Written as a covariance over the common
    times plus the product of the two mean shifts, so that one pass with mergeable
    aggregates suffices and nothing is joined back.
    """
    present = [v for v in tracers if v in df.columns]

    def flux(v):
        both_w = F.avg(F.when(F.col(v).isNotNull(), F.col(w)))
        both_v = F.avg(F.when(F.col(w).isNotNull(), F.col(v)))
        return (F.covar_pop(w, v) + (both_w - F.avg(w)) * (both_v - F.avg(v))).alias(f"w{v}")

    return df.groupBy(*keys).agg(*[flux(v) for v in present])


def array_vertical_flux(w_est: DataFrame, samples: DataFrame) -> DataFrame:
    """Flux profile the array sees: (config, k, wT, wS, wU, wV).

    Its w, brought to layer middles, against tracers averaged over the sensors.
    """
    w = interfaces_to_layers(w_est, "w_est")
    tracers = [v for v in TRACERS if v in samples.columns]
    mean = samples.groupBy("config", "time", "k").agg(*[F.avg(v).alias(v) for v in tracers])
    return vertical_eddy_flux(mean.join(w, ["config", "time", "k"], "left"), ["config", "k"], "w_est", tracers)


def model_vertical_flux(region: DataFrame) -> DataFrame:
    """True flux profile: flux at every hull cell, then the plain mean over cells."""
    per_cell = vertical_eddy_flux(region, ["config", "iy", "ix", "k"], "W")
    return hull_mean(per_cell, [f for f in FLUXES if f in per_cell.columns], ["config", "k"])


def areamean_vertical_flux(region: DataFrame) -> DataFrame:
    """Flux of the hull-mean w and hull-mean tracers: what an ideal array could see."""
    mean = hull_mean(region, ["W", *[v for v in TRACERS if v in region.columns]])
    return vertical_eddy_flux(mean, ["config", "k"], "W")


def flux_rows(profile: DataFrame, value: str, dz: float) -> DataFrame:
    """Flux profile in long form: (config, k, flux, value, obs_depth)."""
    present = [f for f in FLUXES if f in profile.columns]
    return (profile.unpivot(["config", "k"], present, "flux", value)
            .withColumn("obs_depth", layer_mid(F.col("k"), dz)))


def depth_integral(rows: DataFrame, value: str, levels: int, keys=("config", "flux"), z: str = "obs_depth") -> DataFrame:
    """Trapezoidal integral over depth, surface to bottom; missing if any of the levels is.

    z decreases downward, so the integral of a positive profile is negative. The window
    holds one profile.
    """
    w = Window.partitionBy(*keys).orderBy("k")
    piece = F.lit(0.5) * (F.col(value) + F.lead(value).over(w)) * (F.lead(z).over(w) - F.col(z))
    return (rows.withColumn("piece", piece).groupBy(*keys)
            .agg(F.coalesce(F.sum("piece"), F.lit(0.0)).alias("total"),
                 F.count(value).alias("present"))
            .select(*keys, F.when(F.col("present") == levels, F.col("total")).alias(value)))


def flux_integrals(array_flux: DataFrame, model_flux: DataFrame, dz: float, levels: int) -> DataFrame:
    """(config, flux, total_integral, glider_integral, recovered_frac) over this many levels."""
    total = depth_integral(flux_rows(model_flux, "total_integral", dz), "total_integral", levels)
    seen = depth_integral(flux_rows(array_flux, "glider_integral", dz), "glider_integral", levels)
    return total.join(seen, ["config", "flux"], "full").withColumn(
        "recovered_frac", F.try_divide("glider_integral", "total_integral"))


def flux_compare(array_flux: DataFrame, model_flux: DataFrame, dz: float, levels: int) -> DataFrame:
    """Both profiles side by side with the recovered fraction of each flux."""
    profiles = (flux_rows(model_flux, "total", dz)
                .drop("obs_depth").join(flux_rows(array_flux, "glider", dz).drop("obs_depth"), ["config", "flux", "k"], "full")
                .withColumn("obs_depth", layer_mid(F.col("k"), dz)))
    parts = flux_integrals(array_flux, model_flux, dz, levels).select("config", "flux", "recovered_frac")
    return profiles.join(parts, ["config", "flux"])


def flux_profile_stats(array_flux: DataFrame, areamean_flux: DataFrame, model_flux: DataFrame,
                       dz: float) -> DataFrame:
    """Depth means of the three flux profiles and the correlation of the first two over depth."""
    keys = ["config", "flux", "k"]
    rows = (flux_rows(array_flux, "array", dz).drop("obs_depth")
            .join(flux_rows(areamean_flux, "areamean", dz).drop("obs_depth"), keys)
            .join(flux_rows(model_flux, "total", dz).drop("obs_depth"), keys))
    return rows.groupBy("config", "flux").agg(
        F.avg("array").alias("array_dmean"), F.avg("areamean").alias("areamean_dmean"),
        F.avg("total").alias("total_dmean"), correlation(F.col("array"), F.col("areamean")).alias("r_array_areamean"))
