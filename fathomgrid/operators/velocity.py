"""Divergence and vertical velocity: from the sparse array, and from the model itself."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable, join_checked
from ..functions.columns import correlation, interface, layer_mid
from ..grid import Grid
from ..model import EARTH_RADIUS_M, levels_in
from .geometry import hull_cells, interface_levels
from .interpolation import apply_weights, centroid_w, complete, interp_levels, point_weights_long, stencil_of

RANK_EPS = 1e-12


def planefit_weights(positions: DataFrame) -> DataFrame:
    """Least-squares gradient weights of each sensor: (config, glider, wx, wy, n_glider).

    sum(wx * u) is du/dx and sum(wy * v) is dv/dy of the plane fitted to the array. With
    coordinates centred on the array the fit has a closed form. An array on a line gets
    the minimum-norm solution, a single point gets zero gradients.
    """
    n, m = F.count(F.lit(1)), F.lit(math.pi / 180 * EARTH_RADIUS_M)
    east = F.cos(F.radians("lat_c")) * m
    moments = positions.groupBy("config").agg(
        F.avg("lat").alias("lat_c"), F.avg("lon").alias("lon_c"), n.alias("n_glider"),
        (F.var_pop("lon") * n).alias("v_lon"), (F.covar_pop("lon", "lat") * n).alias("v_both"),
        (F.var_pop("lat") * n).alias("v_lat")).select(
        "config", "n_glider", "lat_c", "lon_c", east.alias("east"),
        (F.col("v_lon") * east * east).alias("sxx"), (F.col("v_both") * east * m).alias("sxy"),
        (F.col("v_lat") * m * m).alias("syy"))
    x = (F.col("lon") - F.col("lon_c")) * F.col("east")
    y = (F.col("lat") - F.col("lat_c")) * m
    sxx, sxy, syy = F.col("sxx"), F.col("sxy"), F.col("syy")
    trace, det = sxx + syy, sxx * syy - sxy * sxy
    on_line = det <= F.lit(RANK_EPS) * trace * trace

    def weight(full: Column, line: Column) -> Column:
        return (F.when(trace == 0, F.lit(0.0))
                .when(on_line, F.try_divide(line, trace * trace))
                .otherwise(F.try_divide(full, det)))

    return positions.join(moments, "config").select(
        "config", "glider",
        weight(syy * x - sxy * y, sxx * x + sxy * y).alias("wx"),
        weight(sxx * y - sxy * x, sxy * x + syy * y).alias("wy"),
        "n_glider")


def remove_depth_mean(samples: DataFrame, n_levels: int, variables=("U", "V")) -> DataFrame:
    """Subtract each column's depth mean; any missing level makes the whole column missing.

    The window holds one sensor's profile at one time.
    """
    column = Window.partitionBy("config", "time", "glider")

    def anomaly(v):
        whole = F.count(v).over(column) == n_levels
        return F.when(whole, F.col(v) - F.avg(v).over(column))

    return samples.withColumns({v: anomaly(v) for v in variables})


def planefit_divergence(samples: DataFrame, positions: DataFrame, n_levels: int | None = None,
                        remove_barotropic: bool = False) -> DataFrame:
    """Divergence of the plane fitted at every time and level: (config, time, k, div).

    One missing sensor makes that (time, level) missing.
    """
    if remove_barotropic:
        if n_levels is None:
            raise ValueError("remove_barotropic needs n_levels")
        samples = remove_depth_mean(samples, n_levels)
    fit = planefit_weights(positions)
    joined = join_checked(samples.select("config", "time", "k", "glider", "U", "V"), fit, ["config", "glider"])
    term = F.col("wx") * F.col("U") + F.col("wy") * F.col("V")
    return (joined.groupBy("config", "time", "k")
            .agg(F.sum(term).alias("s"), F.count(term).alias("seen"), F.max("n_glider").alias("n"))
            .select("config", "time", "k", F.when(F.col("seen") == F.col("n"), F.col("s")).alias("div")))


def array_divergence(cells: DataFrame, grid: Grid, positions: DataFrame,
                     max_depth: float = 70, dz: float = 2) -> DataFrame:
    """Plane-fit divergence straight from the cells: (config, time, k, div).

    Interpolation and fit are both linear, so their weights are multiplied beforehand:
    one scan and one shuffle, without the per-sensor samples in between. Same result as
    `planefit_divergence(sample_fields(...))`, with a row for every array, time and level.
    """
    ids = ["config", "glider"]
    variables = ("UVEL", "VVEL")
    corners = point_weights_long(grid, positions.select(*ids, "lat", "lon"), ids, variables)
    # every sensor must have a stencil, otherwise the array's fit is missing
    fitted = corners.join(planefit_weights(positions), ids)
    u, v = stencil_of("UVEL"), stencil_of("VVEL")
    gradient = F.when(F.col("kind") == u, F.col("wx")).otherwise(F.col("wy"))
    per_cell = fitted.groupBy("config", "iy", "ix").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("w") * gradient)).alias(f"hw_{k}") for k in (u, v)],
        # a sensor with n sources adds 1/n for each: the sum counts sensors that have a stencil
        *[F.sum(F.when(F.col("kind") == k, 1 / F.col("n"))).alias(f"reach_{k}") for k in (u, v)],
        F.max("n_glider").alias("n_glider"))
    per_cell = durable(per_cell, "fit-weights")
    everyone = [F.sum(f"reach_{k}") == F.max("n_glider") for k in (u, v)]
    usable = (per_cell.groupBy("config")
              .agg(*[F.count(f"hw_{k}").alias(f"hn_{k}") for k in (u, v)], (everyone[0] & everyone[1]).alias("full"))
              .filter("full").drop("full"))
    horizontal = per_cell.drop(f"reach_{u}", f"reach_{v}", "n_glider").join(usable, "config")
    terms = [(var, f"hw_{k}", f"hn_{k}", "Z") for var, k in (("UVEL", u), ("VVEL", v))]
    return apply_weights(cells, grid, horizontal, ["config"], {"div": terms}, max_depth, dz, targets=positions)


def layer_thickness(samples: DataFrame) -> DataFrame:
    """(config, dz) read off the observation depths: spacing, or twice a single depth."""
    first = F.max(F.when(F.col("k") == 0, F.col("obs_depth")))
    second = F.max(F.when(F.col("k") == 1, F.col("obs_depth")))
    return samples.groupBy("config").agg(
        F.coalesce(F.abs(second - first), F.abs(first) * 2).alias("dz"))


def w_from_divergence(div: DataFrame, dz: float | Column, keys=("config", "time")) -> DataFrame:
    """Integrate divergence downward from w = 0 at the surface: (keys..., k, w_est, depth).

    Interface k + 1 lies below layer k. A missing layer makes every deeper interface
    missing. The window holds one profile. dz is a number or a column of div.
    """
    step = dz if isinstance(dz, Column) else F.lit(float(dz))
    profile = Window.partitionBy(*keys).orderBy("k")
    above = profile.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    complete = F.count("div").over(above) == F.col("k") + 1
    w = F.when(complete, F.sum(F.col("div") * step).over(above))
    surface = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("w_est"), F.lit(0.0).alias("depth"))
    below = F.struct((F.col("k") + 1).cast("int").alias("k"), F.col("w").alias("w_est"),
                     (F.lit(0.0) - (F.col("k") + 1) * step).alias("depth"))
    steps = F.when(F.col("rank") == 1, F.array(surface, below)).otherwise(F.array(below))
    return (div.withColumn("w", w).withColumn("rank", F.row_number().over(profile))
            .select(*keys, F.inline(steps)))


def planefit_w(samples: DataFrame, positions: DataFrame, n_levels: int | None = None,
               dz: float | None = None, remove_barotropic: bool = False):
    """Both results of the plane fit: (w_est on interfaces, div on layers).

    Without dz the layer thickness is read off each array's obs_depth.
    """
    div = planefit_divergence(samples, positions, n_levels, remove_barotropic)
    if dz is None:
        div = join_checked(div, layer_thickness(samples), ["config"])
    else:
        div = div.withColumn("dz", F.lit(float(dz)))
    w = w_from_divergence(div, F.col("dz"))
    return w, div.withColumn("obs_depth", -(F.col("k") * F.col("dz") + F.col("dz") / 2)).drop("dz")


def hull_mean(field: DataFrame, values, keys=("config", "time", "k")) -> DataFrame:
    """Unweighted mean over the cells of each array's hull, missing cells skipped."""
    return field.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def remove_linear_trend(w: DataFrame, max_depth: float, levels: int, keys=("config", "time"),
                        value: str = "w_model") -> DataFrame:
    """Subtract the linear profile that carries w from 0 to its value at the deepest interface.

    levels is the number of that interface; where its value is missing or absent, the whole
    profile is missing.
    """
    profile = Window.partitionBy(*keys)
    bottom = F.max(F.when(F.col("k") == levels, F.col(value))).over(profile)
    return w.withColumn(value, F.col(value) + bottom / F.lit(float(max_depth)) * F.col("depth"))


def model_w(cells: DataFrame, grid: Grid, positions: DataFrame, max_depth: float = 70,
            dz: float = 2, remove_barotropic: bool = False, spatial_mean: bool = True,
            hull: DataFrame | None = None) -> DataFrame:
    """The model's own W at the interface depths: (config, time, k, w_model, depth).

    Averaged over the hull, or taken at the array's centroid.
    """
    if spatial_mean:
        hull = hull_cells(grid, positions) if hull is None else hull
        columns = hull.select("config", "iy", "ix")
        w = hull_mean(interp_levels(cells, grid, ["WVEL"], max_depth, dz, columns, interface_levels), ["W"])
        w = complete(w, cells, grid, columns, ["config"], levels_in(max_depth, dz) + 1, name="hull-w")
        w = w.withColumnRenamed("W", "w_model").withColumn("depth", interface(F.col("k"), dz))
    else:
        w = centroid_w(cells, grid, positions, max_depth, dz)
    return remove_linear_trend(w, max_depth, levels_in(max_depth, dz)) if remove_barotropic else w


def flux_divergence_weights(metrics: DataFrame, columns: DataFrame) -> DataFrame:
    """Edge weights of the flux-form divergence at the given cells.

    metrics: (iy, ix, dyG, dxG, rA); columns: (config, iy, ix). The flux through an edge
    is velocity times edge length; a cell's divergence is the flux out of its upper minus
    that of its lower edge in x and in y, over its area. Past the last row or column the
    flux is zero, so that edge gives no weight.
    """
    u, v = stencil_of("UVEL"), stencil_of("VVEL")
    edges = metrics.select("iy", "ix", "dyG", "dxG")
    area = columns.join(metrics.select("iy", "ix", "rA"), ["iy", "ix"])
    own = area.select("config", F.col("iy").alias("ty"), F.col("ix").alias("tx"), "rA")
    moves = F.array(*[F.struct(F.lit(kind).alias("kind"), (F.col("ty") + dy).alias("iy"),
                               (F.col("tx") + dx).alias("ix"), F.lit(float(sign)).alias("sign"))
                      for kind, dy, dx, sign in ((u, 0, 0, -1), (u, 0, 1, 1), (v, 0, 0, -1), (v, 1, 0, 1))])
    sides = own.select("config", "ty", "tx", "rA", F.inline(moves))
    length = F.when(F.col("kind") == u, F.col("dyG")).otherwise(F.col("dxG"))
    long = (sides.join(edges, ["iy", "ix"])
            .withColumn("w", F.col("sign") * length / F.col("rA"))
            .select("config", "ty", "tx", "iy", "ix", "kind", "w", F.lit(1).alias("n")))
    sources = long.groupBy("config", "ty", "tx").agg(
        *[F.count_if(F.col("kind") == k).alias(f"hn_{k}") for k in (u, v)])
    return (long.groupBy("config", "ty", "tx", "iy", "ix")
            .agg(*[F.sum(F.when(F.col("kind") == k, F.col("w"))).alias(f"hw_{k}") for k in (u, v)])
            .join(sources, ["config", "ty", "tx"]))


def cell_divergence(cells: DataFrame, grid: Grid, columns: DataFrame,
                    max_depth: float = 70, dz: float = 2, form: str | None = None) -> DataFrame:
    """Flux divergence at each given cell and observation level: (config, iy, ix, time, k, div).

    Times and levels without any of a cell's edges have no row.
    """
    horizontal = flux_divergence_weights(grid.metrics, columns)
    terms = [(v, f"hw_{stencil_of(v)}", f"hn_{stencil_of(v)}", "Z") for v in ("UVEL", "VVEL")]
    return (apply_weights(cells, grid, horizontal, ["config", "ty", "tx"], {"div": terms}, max_depth, dz, form=form)
            .withColumnsRenamed({"ty": "iy", "tx": "ix"}))


def model_divergence(cells: DataFrame, grid: Grid, positions: DataFrame,
                     max_depth: float = 70, dz: float = 2, hull: DataFrame | None = None) -> DataFrame:
    """Hull mean of the model's flux divergence: (config, time, k, div, obs_depth).

    A row for every array with a hull, time and level; only these means are completed, not the cells.
    """
    hull = hull_cells(grid, positions) if hull is None else hull
    columns = hull.select("config", "iy", "ix")
    mean = hull_mean(cell_divergence(cells, grid, columns, max_depth, dz), ["div"])
    return (complete(mean, cells, grid, columns, ["config"], levels_in(max_depth, dz), name="hull-divergence")
            .withColumn("obs_depth", layer_mid(F.col("k"), dz)))


def w_bias(w_est: DataFrame, w_model: DataFrame) -> DataFrame:
    """(config, time, k, depth, w_est, w_model, bias), matched on the integer level."""
    return (w_est.select("config", "time", "k", "depth", "w_est")
            .join(w_model.select("config", "time", "k", "w_model"), ["config", "time", "k"])
            .withColumn("bias", F.col("w_est") - F.col("w_model")))


def divergence_correlation(estimated: DataFrame, true: DataFrame, keys=("config",)) -> DataFrame:
    """Correlation over all times and levels; missing if any value is missing.

    A time or level that only one side has counts as missing in the other.
    """
    pairs = (estimated.select(*keys, "time", "k", F.col("div").alias("e"))
             .join(true.select(*keys, "time", "k", F.col("div").alias("m")), [*keys, "time", "k"], "full"))
    gap = F.count_if(F.col("e").isNull() | F.col("m").isNull())
    return pairs.groupBy(*keys).agg(correlation(F.col("e"), F.col("m")).alias("c"), gap.alias("gaps")).select(
        *keys, F.when(F.col("gaps") == 0, F.col("c")).alias("div_corr"))
