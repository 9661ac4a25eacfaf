"""Interpolation as fixed linear combinations of cells at one time.

Sampling at sensors, regridding to cell centres, interpolation to depth levels, plane-fit
divergence and flux divergence all use one kernel: the cell table meets a small table of
horizontal weights (by row and column) and a small table of vertical weights (by level),
and one aggregation per (time, target, level) sums weight * value. The weights are time
independent and multiply, so only the two small factors are ever broadcast. Where a cell would
meet many targets and levels at once, levels are applied first and targets then, which shuffles
a sum instead of a product of the two numbers.

Whoever asks for targets gets a row for each at every time and level. Rows are counted after the
aggregation, and only targets that are short of some are completed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import inside_ranges, join_checked, ranges_of, recorded, small_enough
from ..functions.columns import interface, layer_mid
from ..grid import Grid
from ..model import ALIAS, CELL_KEYS, GRID, levels_in
from .geometry import hull_cells, interface_levels, obs_levels


def stencil_of(variable: str) -> str:
    """Variables on the same horizontal axes share one stencil, named by them."""
    x, y, _ = GRID[variable]
    return f"{x}_{y}"


def point_weights_long(grid: Grid, targets: DataFrame, ids, variables) -> DataFrame:
    """Bilinear weights at points: (ids..., kind, iy, ix, w, n), n sources per target and kind.

    targets: (ids..., lat, lon). Each variable is interpolated on its own staggered axes.
    Two lookups in the small span table; nothing is shuffled.
    """
    ids = list(ids)
    grids = sorted({GRID[v][:2] for v in variables})
    kinds = F.array(*[F.struct(
        F.lit(f"{x}_{y}").alias("kind"),
        F.lit(x).alias("xa"), grid.strip(x, F.col("lon")).alias("xs"),
        F.lit(y).alias("ya"), grid.strip(y, F.col("lat")).alias("ys")) for x, y in grids])
    df = targets.select(*ids, F.col("lon").alias("_x"), F.col("lat").alias("_y"), F.inline(kinds))
    df = grid.interpolated(df, "xa", "xs", "_x", "ix", "wx", "nx")
    df = grid.interpolated(df, "ya", "ys", "_y", "iy", "wy", "ny")
    return df.select(*ids, "kind", "iy", "ix", (F.col("wx") * F.col("wy")).alias("w"),
                     (F.col("nx") * F.col("ny")).alias("n"))


def _wide(weights: DataFrame, ids, keys, kinds, prefix) -> DataFrame:
    """One row per (target, source) with a weight and an expected count per kind."""
    def of(k, c):
        return F.when(F.col("kind") == k, F.col(c))
    return weights.groupBy(*ids, *keys).agg(*[
        a for k in kinds for a in (F.sum(of(k, "w")).alias(f"{prefix}w_{k}"),
                                   F.max(of(k, "n")).alias(f"{prefix}n_{k}"))])


def point_weights(grid: Grid, targets: DataFrame, ids, variables) -> DataFrame:
    """The same with one row per source: (ids..., iy, ix, hw_<stencil>, hn_<stencil>)."""
    return _wide(point_weights_long(grid, targets, ids, variables), list(ids), ["iy", "ix"],
                 sorted({stencil_of(v) for v in variables}), "h")


def level_weights(grid: Grid, levels: DataFrame) -> DataFrame:
    """Linear weights in depth: (k, iz, zw_<axis>, zn_<axis>). levels: (k, z)."""
    zaxes = sorted({g[2] for g in GRID.values()} & set(grid.extents))
    kinds = F.array(*[F.struct(F.lit(a).alias("kind"), grid.strip(a, F.col("z")).alias("zs")) for a in zaxes])
    found = grid.interpolated(levels.select("k", "z", F.inline(kinds)), "kind", "zs", "z", "iz", "w", "n")
    return _wide(found, ["k"], ["iz"], zaxes, "z")


def _level_count(levels, max_depth: float, dz: float) -> int:
    return levels_in(max_depth, dz) + (1 if levels is interface_levels else 0)


def _vertical(cells: DataFrame, grid: Grid, levels, max_depth: float, dz: float, zaxes):
    """Hinted level weights on the given axes, their scan range and size, the same for every use of a grid."""
    key = (levels.__name__, max_depth, dz)
    used = F.greatest(*[F.coalesce(f"zn_{a}", F.lit(0)) for a in sorted(zaxes)], F.lit(0)) > 0
    return grid.once((*key, *sorted(zaxes)), lambda: _small(
        level_weights(grid, levels(cells.sparkSession, max_depth, dz)).filter(used), "levels", "iz"))


def _small(weights: DataFrame, name: str, *cols: str):
    """Weights written once, hinted for broadcast if their size allows, the scan range, and (rows, sources)."""
    table, size = recorded(weights, name, sources=F.approx_count_distinct(F.struct(*cols)), **ranges_of(*cols))
    hinted = F.broadcast(table) if small_enough(table, size["n"]) else table
    return hinted, inside_ranges(size, *cols), (size["n"], size["sources"])


# ---------------------------------------------------------------- rows asked for

TIMES_PER_BUCKET = 1024


def all_times(cells: DataFrame, grid: Grid) -> tuple[DataFrame, int]:
    """(time, bucket) of a cell table and their number, read once per grid and table from its time column alone."""
    def make():
        times, size = recorded(cells.select("time").distinct(), "times")
        n = size["n"]
        return times.withColumn("bucket", F.pmod(F.xxhash64("time"), F.lit(max(1, math.ceil(n / TIMES_PER_BUCKET)))).cast("int")), n
    return grid.once(("times", cells), make)


def known_times(cells: DataFrame, grid: Grid, times: DataFrame) -> None:
    """State the times of a cell table, e.g. from its snapshot index, so that the table is not read for them."""
    grid.once(("times", cells), lambda: all_times(times, grid))


def frame_rows(cells: DataFrame, grid: Grid, targets: DataFrame, n_levels: int) -> DataFrame:
    """(ids..., time, k): every target at every time and level.

    Targets are repeated for each bucket of times and meet the times by its number, an equi-join that
    neither holds all times in one row nor pairs the two tables blindly.
    """
    times, n = all_times(cells, grid)
    buckets = max(1, math.ceil(n / TIMES_PER_BUCKET))
    rows = targets.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    steps = F.sequence(F.lit(0), F.lit(n_levels - 1)) if n_levels else F.array().cast("array<int>")
    return join_checked(rows, times, ["bucket"], n).drop("bucket").withColumn("k", F.explode(steps))


def complete(rows: DataFrame, cells: DataFrame, grid: Grid, targets: DataFrame, ids, n_levels: int, finish=None,
             name: str = "kernel") -> DataFrame:
    """rows, written once, with a row for every target at every time and level.

    rows: (ids..., time, k, values). Each target's rows are counted against times x levels; the ones
    that are short get the rows they lack, without values. finish, if given, adds columns before writing.
    """
    ids = list(ids)
    finish = finish or (lambda df: df)
    targets = targets.select(*ids).distinct()
    _, n_times = all_times(cells, grid)
    table, size = recorded(finish(rows), name)
    if size["n"] == targets.count() * n_times * n_levels:  # every row of rows is one of those asked for
        return table
    have = table.groupBy(*ids).agg(F.count(F.lit(1)).alias("_have"))
    short, size = recorded(targets.join(have, ids, "left")
                           .where(F.coalesce("_have", F.lit(0)) < n_times * n_levels).select(*ids), "short")
    n_short = size["n"]
    there = join_checked(table.select(*ids, "time", "k"), short, ids, n_short, "left_semi")
    lacking = frame_rows(cells, grid, short, n_levels).join(there, [*ids, "time", "k"], "left_anti")
    values = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in lacking.columns]
    return table.unionByName(finish(lacking.select("*", *values)).select(*table.columns))


# ---------------------------------------------------------------- kernel

def _value(total, seen, expected):
    """A sum that counts only if every expected term was there."""
    return F.when((F.col(seen) == F.col(expected)) & (F.col(expected) > 0), F.col(total))


def apply_levels(cells: DataFrame, vertical: DataFrame, variables: dict, columns: DataFrame | None = None) -> DataFrame:
    """Depth interpolation of whole columns: (time, iy, ix, k, variables), from levels with at least one cell.

    variables: name -> z axis. Cells are dealt by column and time once; joining the level weights and adding
    up happen where they land. columns restricts to those (iy, ix).
    """
    src = cells.select("time", *CELL_KEYS, *variables)
    if columns is not None:
        src = join_checked(src, columns.select("iy", "ix").distinct(), ["iy", "ix"], how="left_semi")
    joined = src.repartition("time", "iy", "ix").join(vertical, ["iz"])
    aggs = []
    for v, axis in variables.items():
        term = F.col(f"zw_{axis}") * F.col(v)
        aggs += [F.sum(term).alias(f"{v}_sum"), F.count(term).alias(f"{v}_seen"),
                 F.coalesce(F.max(f"zn_{axis}"), F.lit(-1)).alias(f"{v}_all")]
    return joined.groupBy("time", "iy", "ix", "k").agg(*aggs).select(
        "time", "iy", "ix", "k", *[_value(f"{v}_sum", f"{v}_seen", f"{v}_all").alias(v) for v in variables])


def better_form(across: tuple[int, int], down: tuple[int, int], n_levels: int) -> str:
    """'direct' or 'levels first', whichever brings fewer rows per cell into shuffles.

    across and down: rows and distinct sources of the horizontal and the level weights. Directly, a cell gives
    a row per target and level it contributes to. With levels first it is dealt once itself,
    and then every level of its column goes to each target; that must save a third to be worth a shuffle more.
    """
    targets, steps = across[0] / max(across[1], 1), down[0] / max(down[1], 1)
    return "levels first" if 1.5 * (1 + targets * n_levels / max(down[1], 1)) < targets * steps else "direct"


def apply_weights(cells: DataFrame, grid: Grid, horizontal: DataFrame, ids, outputs, max_depth: float,
                  dz: float, levels=obs_levels, targets: DataFrame | None = None, form: str | None = None,
                  finish=None) -> DataFrame:
    """The kernel: sum of weight * value per (time, ids, k).

    outputs maps a result column to the list of (variable, horizontal weight column,
    horizontal count column, z axis) terms added up in it. A result is NULL unless every
    expected cell is present. targets: the ids asked for; each gets a row at every time and
    level, also where its stencil or all its cells are missing (see `complete`, also for finish).
    form: 'direct' or 'levels first'; by default the better one for these weights.

    The row, column and level ranges of the weights are pushed into the scan as literals;
    the joins then drop all other cells before any shuffle, and the last aggregation is
    combined map-side.
    """
    ids = list(ids)
    horizontal, in_box, across = _small(horizontal, "weights", "iy", "ix")
    axis_of = {t[0]: t[3] for terms in outputs.values() for t in terms}
    vertical, in_levels, down = _vertical(cells, grid, levels, max_depth, dz, set(axis_of.values()))
    used = sorted(axis_of)
    n_levels = _level_count(levels, max_depth, dz)
    near = cells.filter(in_box & in_levels).select("time", *CELL_KEYS, *used)
    if (form or better_form(across, down, n_levels)) == "direct":
        joined = near.join(horizontal, ["iy", "ix"]).join(vertical, ["iz"])
        factor, number = (lambda axis: F.col(f"zw_{axis}")), (lambda axis: F.col(f"zn_{axis}"))
    else:
        joined = apply_levels(near, vertical, {v: axis_of[v] for v in used}, horizontal).join(horizontal, ["iy", "ix"])
        factor, number = (lambda axis: F.lit(1.0)), (lambda axis: F.lit(1))
    aggs = []
    for name, terms in outputs.items():
        total, seen, expected = F.lit(0.0), F.lit(0), F.lit(0)
        for variable, hw, hn, axis in terms:
            term = F.col(hw) * factor(axis) * F.col(variable)
            total = total + F.coalesce(term, F.lit(0.0))
            seen = seen + term.isNotNull().cast("int")
            expected = expected + F.coalesce(F.max(F.col(hn) * number(axis)), F.lit(-1))
        aggs += [F.sum(total).alias(f"{name}_sum"), F.sum(seen).alias(f"{name}_seen"),
                 expected.alias(f"{name}_all")]
    rows = joined.groupBy("time", *ids, "k").agg(*aggs).select(
        *ids, "time", "k", *[_value(f"{n}_sum", f"{n}_seen", f"{n}_all").alias(n) for n in outputs])
    return rows if targets is None else complete(rows, cells, grid, targets, ids, n_levels, finish)


def _plain_outputs(variables):
    return {ALIAS[v]: [(v, f"hw_{stencil_of(v)}", f"hn_{stencil_of(v)}", GRID[v][2])] for v in variables}


def sample_fields(cells: DataFrame, grid: Grid, positions: DataFrame,
                  variables=("UVEL", "VVEL", "THETA", "SALT"),
                  max_depth: float = 70, dz: float = 2, finish=None) -> DataFrame:
    """Fields at every sensor and observation level.

    Pointwise bilinear in the horizontal, linear in depth:
    (config, glider, lat, lon, time, k, U, V, T, S, obs_depth), one row for every sensor,
    time and level. A value whose stencil has a missing or absent cell, or lies outside the
    grid or its levels, is missing. finish: adds columns before the table is written.
    """
    ids = ["config", "glider", "lat", "lon"]
    horizontal = point_weights(grid, positions, ids, variables)
    return (apply_weights(cells, grid, horizontal, ids, _plain_outputs(variables), max_depth, dz, targets=positions,
                          finish=finish)
            .withColumn("obs_depth", layer_mid(F.col("k"), dz)))


def model_region(cells: DataFrame, grid: Grid, positions: DataFrame,
                 variables=("UVEL", "VVEL", "THETA", "SALT"),
                 max_depth: float = 70, dz: float = 2, hull: DataFrame | None = None, finish=None,
                 form: str | None = None) -> DataFrame:
    """The full population: every field at every cell centre inside each array's hull.

    (config, iy, ix, time, k, U, V, T, S[, W], obs_depth, lat, lon). The hull is applied
    to the weights, so cells outside it are dropped before anything is shuffled. `hull` may
    pass in `hull_cells` if it is at hand. finish and form: see `apply_weights`.
    """
    ids = ["config", "ty", "tx"]
    hull = hull_cells(grid, positions) if hull is None else hull
    centres = hull.withColumnsRenamed({"iy": "ty", "ix": "tx"})
    horizontal = point_weights(grid, centres, ids, variables)
    values = apply_weights(cells, grid, horizontal, ids, _plain_outputs(variables), max_depth, dz, targets=centres,
                           form=form, finish=finish)
    return (with_cell_position(values.withColumnsRenamed({"ty": "iy", "tx": "ix"}), grid)
            .withColumn("obs_depth", layer_mid(F.col("k"), dz)))


def with_cell_position(df: DataFrame, grid: Grid) -> DataFrame:
    """Add lat, lon of tracer cell centres (two one-dimensional lookups)."""
    return df.join(grid.nodes("YC", "iy", "lat"), "iy").join(grid.nodes("XC", "ix", "lon"), "ix")


def interp_levels(cells: DataFrame, grid: Grid, variables, max_depth: float, dz: float,
                  columns: DataFrame | None = None, levels=obs_levels) -> DataFrame:
    """Depth interpolation only, to layers or (levels=interface_levels) interfaces.

    (iy, ix, time, k, values). Without columns: one row for every level of each column of the cell
    table, at the times it has cells. columns, if given, restricts to those (iy, ix) and may repeat
    them under a config; then levels without any cell have no row.
    """
    axis_of = {v: GRID[v][2] for v in variables}
    vertical, in_levels, _ = _vertical(cells, grid, levels, max_depth, dz, set(axis_of.values()))
    names = {v: ALIAS[v] for v in variables}
    if columns is not None:
        known, in_box, _ = _small(columns, "columns", "iy", "ix")
        ids = [c for c in columns.columns if c not in ("iy", "ix")] + ["iy", "ix"]
        # each column once, however many arrays it belongs to
        done = apply_levels(cells.filter(in_box & in_levels), vertical, axis_of, columns)
        return done.join(known, ["iy", "ix"]).withColumnsRenamed(names).select(*ids, "time", "k", *names.values())
    n = _level_count(levels, max_depth, dz)
    # cells between the levels asked for still say that a column exists: they carry no level
    joined = cells.select("time", *CELL_KEYS, *variables).repartition("time", "iy", "ix").join(vertical, ["iz"], "left")
    aggs = []
    for v, axis in axis_of.items():
        term = F.col(f"zw_{axis}") * F.col(v)
        aggs += [F.sum(term).alias(f"{v}_sum"), F.count(term).alias(f"{v}_seen"), F.max(f"zn_{axis}").alias(f"{v}_all")]
    per_level = joined.groupBy("time", "iy", "ix", "k").agg(*aggs).select(
        "time", "iy", "ix", "k", *[_value(f"{v}_sum", f"{v}_seen", f"{v}_all").alias(names[v]) for v in variables])
    # one column's levels, dealt together above; only a column that lacks some is filled up
    profile = per_level.groupBy("time", "iy", "ix").agg(F.collect_list(F.when(
        F.col("k").isNotNull(), F.struct("k", *names.values()))).alias("p"))
    kind = F.struct(F.lit(None).cast("int").alias("k"), *[F.lit(None).cast("double").alias(c) for c in names.values()])

    def filled(k):
        found = F.get(F.filter("p", lambda x: x["k"] == k), F.lit(0))
        return F.coalesce(found, F.struct(k.alias("k"), *[F.lit(None).cast("double").alias(c) for c in names.values()]))

    every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), filled) if n else F.slice(F.array(kind), 1, 0)
    return profile.select("iy", "ix", "time", F.inline(F.when(F.size("p") == n, F.col("p")).otherwise(every)))


def interfaces_to_layers(profile: DataFrame, value: str, keys=("config", "time")) -> DataFrame:
    """Values on interfaces brought to the layer middles between them.

    Interface k and k + 1 bound layer k, so the linear value there is their mean; missing
    if either is. Groups are single profiles.
    """
    w = Window.partitionBy(*keys).orderBy("k")
    nxt, nxt_k = F.lead(value).over(w), F.lead("k").over(w)
    return (profile.select(*keys, "k", ((F.col(value) + nxt) / 2).alias(value), nxt_k.alias("_next"))
            .filter(F.col("_next") == F.col("k") + 1).drop("_next"))


def centroid_w(cells: DataFrame, grid: Grid, positions: DataFrame,
               max_depth: float = 70, dz: float = 2) -> DataFrame:
    """Model W at each array's centroid and the interface depths: (config, time, k, w_model)."""
    centre = positions.groupBy("config").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    horizontal = point_weights(grid, centre, ["config"], ["WVEL"])
    return (apply_weights(cells, grid, horizontal, ["config"], _plain_outputs(["WVEL"]), max_depth, dz,
                          interface_levels, centre)
            .withColumnRenamed("W", "w_model").withColumn("depth", interface(F.col("k"), dz)))
