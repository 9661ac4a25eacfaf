"""Array geometry: projection, boxes, depth axes, convex hulls and the cells inside them.

Tables here hold sensors, axes and grid columns, not times or levels. Their joins carry no
hint: Spark broadcasts by measured size and splits skewed keys at run time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable, recorded
from ..functions.columns import interface, layer_mid, turn
from ..grid import Grid
from ..model import BOX_MARGIN_DEG, EARTH_RADIUS_M, levels_in
from .value_cells import Ranks, ordered_values

POINT = "array<struct<lon: double, lat: double>>"
# Largest set of sensors whose hull is built in one list; larger arrays are first reduced to the
# hull vertices of parts, and stay a table of rows if more than this many are left.
HULL_PART = 4096
# Sensors of one stretch of a ring that are looked at together.
RING_PART = 512


def project_to_metres(positions: DataFrame) -> DataFrame:
    """Add x_m, y_m: equirectangular metres about each configuration's centroid."""
    centre = positions.groupBy("config").agg(F.avg("lat").alias("lat_c"), F.avg("lon").alias("lon_c"))
    metres = F.lit(math.pi / 180 * EARTH_RADIUS_M)
    return (positions.join(centre, "config")
            .withColumn("x_m", (F.col("lon") - F.col("lon_c")) * F.cos(F.radians("lat_c")) * metres)
            .withColumn("y_m", (F.col("lat") - F.col("lat_c")) * metres)
            .select(*positions.columns, "x_m", "y_m"))


def hull_bbox(positions: DataFrame, margin: float = BOX_MARGIN_DEG) -> DataFrame:
    """(config, lon_min, lon_max, lat_min, lat_max) with a margin in degrees."""
    m = F.lit(float(margin))
    return positions.groupBy("config").agg(
        (F.min("lon") - m).alias("lon_min"), (F.max("lon") + m).alias("lon_max"),
        (F.min("lat") - m).alias("lat_min"), (F.max("lat") + m).alias("lat_max"))


def obs_levels(spark: SparkSession, max_depth: float, dz: float) -> DataFrame:
    """(k, z): middles of the layers down to max_depth."""
    n = levels_in(max_depth, dz)
    return spark.range(n).select(F.col("id").cast("int").alias("k")).withColumn("z", layer_mid(F.col("k"), dz))


def interface_levels(spark: SparkSession, max_depth: float, dz: float) -> DataFrame:
    """(k, z): interfaces from the surface down to max_depth."""
    n = levels_in(max_depth, dz) + 1
    return spark.range(n).select(F.col("id").cast("int").alias("k")).withColumn("z", interface(F.col("k"), dz))


def depth_axes(requests: DataFrame) -> DataFrame:
    """Both depth axes for many (key..., max_depth, dz) requests at once.

    Adds k, obs_depth (NULL for the last k, which has only an interface) and depth.
    """
    n = F.floor(F.col("max_depth") / F.col("dz")).cast("int")
    k, dz = F.col("k"), F.col("dz")
    return (requests.withColumn("n", n)
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
            .withColumn("obs_depth", F.when(k < F.col("n"), -(k * dz + dz / 2)))
            .withColumn("depth", F.lit(0.0) - k * dz)
            .drop("n"))


def brackets(grid: Grid, targets: DataFrame) -> DataFrame:
    """Neighbouring axis nodes and linear weights of each target coordinate.

    targets: (axis, pos, keys...). Gives one row per contributing node: (axis, keys...,
    idx, w). A target on a node uses that node alone; one outside the axis gives no row.
    """
    keys = [c for c in targets.columns if c not in ("axis", "pos")]
    filed = targets.withColumn("strip", grid.strip_by(F.col("axis"), F.col("pos")))
    return grid.interpolated(filed, "axis", "strip", "pos", "idx", "w", "n").select("axis", *keys, "idx", "w")


def nearest_level(levels: DataFrame, depth: float, keys=("config",), z: str = "depth") -> DataFrame:
    """The level of a depth axis closest to `depth`: (keys..., k, depth)."""
    near = F.struct(F.abs(F.col(z) - F.lit(float(depth))), F.col("k"))
    return (levels.groupBy(*keys).agg(F.min_by(F.struct("k", F.col(z)), near).alias("m"))
            .select(*keys, F.col("m.k").alias("k"), F.col(f"m.{z}").alias(z)))


# ---------------------------------------------------------------- convex hull

def _half_hull(points: Column, eps: Column) -> Column:
    """One side of the hull of points sorted by (lon, lat).

    Folding in the next point drops the tail of the chain that it sees from the outside.
    Along a convex chain the visible edges are exactly the last ones, so the number of
    edges that are not visible tells how much of the chain stays.
    """
    def add(chain, p):
        def hidden(i):
            a, b = F.element_at(chain, i), F.element_at(chain, i + 1)
            return turn(a["lon"], a["lat"], b["lon"], b["lat"], p["lon"], p["lat"]) > eps
        stay = F.when(F.size(chain) < 2, F.size(chain)).otherwise(
            F.size(F.filter(F.sequence(F.lit(1), F.size(chain) - 1), hidden)) + 1)
        return F.concat(F.slice(chain, F.lit(1), stay), F.array(p))
    return F.aggregate(points, F.array().cast(POINT), add)


def _hull_of(points: Column, eps: Column) -> Column:
    """Hull vertices, anticlockwise from the westernmost point; collinear ones dropped."""
    lower, upper = _half_hull(points, eps), _half_hull(F.reverse(points), eps)
    def open_end(chain):
        return F.slice(chain, F.lit(1), F.greatest(F.size(chain) - 1, F.lit(0)))
    return F.concat(open_end(lower), open_end(upper))


def hull_vertices(positions: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(config, vertices, problem): convex hull of each array as one anticlockwise point list.

    eps is relative: turns below eps times the square of the array's extent count as straight,
    in parts and in the whole alike. An array that spans no area keeps its row, with a problem
    named instead of vertices; so does one with more than HULL_PART vertices, whose hull only
    `hull_edges` gives.
    """
    lists, rings, _ = _hulls(positions, eps)
    if rings is None:
        return lists
    large = rings.select("config").distinct().withColumns({
        "vertices": F.lit(None).cast(POINT), "problem": F.lit("too many vertices for a list")})
    return lists.unionByName(large)


def _hulls(positions: DataFrame, eps: float):
    """Hulls as lists, hulls as rings of rows (None if there are none), and each array's tolerance.

    Arrays above HULL_PART sensors are cut into parts whose hulls are taken: the hull of all parts' vertices is
    the same hull. Where that hardly helps any more, since most sensors lie near the hull, what is
    left goes round by angle (`_rings`).
    """
    extent = F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat"))
    about, seen = recorded(positions.groupBy("config").agg((extent * extent * F.lit(eps)).alias("eps"), F.count(F.lit(1)).alias("size")),
                           "extents", largest=F.max("size"))
    about, largest = about.select("config", "eps"), seen["largest"] or 0
    points = positions.select("config", F.struct("lon", "lat").alias("p"))
    rings = None
    while largest > HULL_PART:
        sizes = points.groupBy("config").agg(F.count(F.lit(1)).alias("n"))
        cut = points.join(sizes, "config").join(about, "config").withColumn(
            "part", F.pmod(F.xxhash64("p"), F.ceil(F.col("n") / (HULL_PART / 4))).cast("int"))
        points = durable(_collect_hull(cut, ["config", "part", "eps"]).select("config", F.explode("vertices").alias("p")), "hull-parts")
        counted, seen = recorded(points.groupBy("config").agg(F.count(F.lit(1)).alias("n")), "hull-sizes", largest=F.max("n"))
        left = seen["largest"] or 0
        if HULL_PART < left and left > largest / 2:
            large = counted.where(F.col("n") > HULL_PART).select("config")
            rings = _rings(points.join(large, "config", "left_semi"), about)
            points = points.join(large, "config", "left_anti")
            break
        largest = left
    hulls = _collect_hull(points.join(about, "config"), ["config", "eps"])
    flat = F.size("vertices") < 3
    lists = hulls.select("config", F.when(~flat, F.col("vertices")).alias("vertices"), F.when(flat, "spans no area").alias("problem"))
    return lists, rings, about


def _kept_stretch(points: Column, eps: Column) -> Column:
    """Points of a stretch ordered by angle, without those that the others show not to be vertices; both ends stay."""
    def add(chain, p):
        def hidden(i):
            a, b = F.element_at(chain, i)["p"], F.element_at(chain, i + 1)["p"]
            return turn(a["lon"], a["lat"], b["lon"], b["lat"], p["p"]["lon"], p["p"]["lat"]) > eps
        last = F.array_max(F.filter(F.sequence(F.lit(1), F.size(chain) - 1), hidden))
        stay = F.when(F.size(chain) < 2, F.size(chain)).otherwise(F.coalesce(last, F.lit(0)) + 1)
        return F.concat(F.slice(chain, F.lit(1), stay), F.array(p))
    return F.aggregate(points, F.array().cast("array<struct<pos: bigint, p: struct<lon: double, lat: double>>>"), add)


def _rings(points: DataFrame, about: DataFrame) -> DataFrame:
    """(config, pos, p, n): hull vertices of large arrays, numbered anticlockwise from 0.

    Seen from a point inside, the order by angle is the order along the hull. A point that does not turn
    left between its neighbours in that order lies inside the triangle of these two and the centre, so it is
    no vertex, whatever else is there. Stretches of RING_PART points are cleared independently; a second pass
    shifts the stretches by half, and both repeat until neither removes anything: then every
    three neighbours turn left, and the ring is convex. Ranks, stretches and edges are rows; no task
    holds a whole array.
    """
    centre = points.groupBy("config").agg(F.avg("p.lon").alias("x"), F.avg("p.lat").alias("y"))
    dx, dy = F.col("p.lon") - F.col("x"), F.col("p.lat") - F.col("y")
    ring = durable(points.join(centre, "config").select("config", "p", F.atan2(dy, dx).alias("angle"), (dx * dx + dy * dy).alias("far"))
                   .groupBy("config", "angle").agg(F.max_by("p", F.struct("far", "p.lon")).alias("p")), "ring")
    quiet, shift = 0, 0
    while True:
        order = ordered_values(Ranks(ring.select("config", F.lit("true").alias("side"), F.col("angle").alias("v")), ("config",)))
        placed = durable(ring.join(order.select("config", F.col("v").alias("angle"), (F.col("past_n_true_0") - 1).alias("pos"),
                                                F.col("all_n_true_0").alias("n")), ["config", "angle"]), "ring-order")
        if quiet == 2:
            return placed.select("config", "pos", "p", "n")
        # the first points follow the last ones once more
        again = F.when(F.col("pos") < RING_PART, F.array("pos", F.col("pos") + F.col("n"))).otherwise(F.array("pos"))
        members = placed.select("config", "n", "p", F.explode(again).alias("pos"))
        stretches = members.join(about, "config").groupBy(
            "config", "n", "eps", F.floor((F.col("pos") + shift) / RING_PART).alias("part")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("all"))
        kept = F.transform(_kept_stretch(F.col("all"), F.col("eps")), lambda m: m["pos"])
        gone = F.array_except(F.transform("all", lambda m: m["pos"]), kept)
        gone, size = recorded(stretches.select("config", "n", F.explode(gone).alias("at"))
                              .select("config", (F.col("at") % F.col("n")).alias("pos")).distinct(), "ring-gone")
        quiet = quiet + 1 if not size["n"] else 0
        if size["n"]:
            ring = durable(placed.join(gone, ["config", "pos"], "left_anti").select("config", "angle", "p"), "ring")
        shift = RING_PART // 2 - shift


def _collect_hull(points: DataFrame, keys) -> DataFrame:
    return (points.groupBy(*keys).agg(F.sort_array(F.collect_set("p")).alias("pts"))
            .select(*keys, _hull_of(F.col("pts"), F.col("eps")).alias("vertices")))


def hull_edges(positions: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(config, x0, y0, x1, y1): directed hull edges, interior on the left; none of a flat array."""
    return _edges(positions, eps).drop("y_min", "y_max")


def _edges(positions: DataFrame, eps: float = 1e-12) -> DataFrame:
    lists, rings, _ = _hulls(positions, eps)
    v = F.col("vertices")
    nxt = F.concat(F.slice(v, F.lit(2), F.size(v) - 1), F.slice(v, F.lit(1), F.lit(1)))
    lat = F.transform(v, lambda p: p["lat"])
    edges = (lists.where("problem is null")
             .select("config", F.array_min(lat).alias("y_min"), F.array_max(lat).alias("y_max"),
                     F.explode(F.arrays_zip(v.alias("a"), nxt.alias("b"))).alias("e"))
             .select("config", F.col("e.a.lon").alias("x0"), F.col("e.a.lat").alias("y0"),
                     F.col("e.b.lon").alias("x1"), F.col("e.b.lat").alias("y1"), "y_min", "y_max"))
    if rings is None:
        return edges
    range_of = rings.groupBy("config").agg(F.min("p.lat").alias("y_min"), F.max("p.lat").alias("y_max"))
    after = rings.select("config", F.pmod(F.col("pos") - 1, F.col("n")).alias("pos"), F.col("p").alias("b"))
    return edges.unionByName(rings.join(after, ["config", "pos"]).join(range_of, "config").select(
        "config", F.col("p.lon").alias("x0"), F.col("p.lat").alias("y0"), F.col("b.lon").alias("x1"), F.col("b.lat").alias("y1"),
        "y_min", "y_max"))


def _index_range(df: DataFrame, grid: Grid, axis: str, lo: str, hi: str, first: str, last: str) -> DataFrame:
    """Add the first and last axis index inside [lo, hi]; rows without any are dropped."""
    a, b, _ = grid.extents[axis]
    df = (df.withColumns({"_axis": F.lit(axis), "_lo": F.greatest(F.col(lo), F.lit(a)),
                          "_hi": F.least(F.col(hi), F.lit(b))})
          .filter(F.col("_lo") <= F.col("_hi")))
    for side, name in (("_lo", first), ("_hi", last)):
        keep = list(df.columns)
        on_node = "i0" if side == "_hi" else "i1"
        df = grid.around(df.withColumn("_strip", grid.strip(axis, F.col(side))), "_axis", "_strip", side)
        node = (F.when(F.col(side) == F.col("x0"), F.col("i0"))
                .when(F.col(side) == F.col("x1"), F.col("i1")).otherwise(F.col(on_node)))
        df = df.select(*keep, node.alias(name))
    return df.drop("_axis", "_lo", "_hi").filter(F.col(first) <= F.col(last))


def box_spans(grid: Grid, positions: DataFrame, margin: float = BOX_MARGIN_DEG) -> DataFrame:
    """(config, iy0, iy1, ix0, ix1, n_point): tracer rows and columns in each array's box."""
    df = _index_range(hull_bbox(positions, margin), grid, "YC", "lat_min", "lat_max", "iy0", "iy1")
    df = _index_range(df, grid, "XC", "lon_min", "lon_max", "ix0", "ix1")
    n = (F.col("iy1") - F.col("iy0") + 1).cast("bigint") * (F.col("ix1") - F.col("ix0") + 1)
    return df.select("config", "iy0", "iy1", "ix0", "ix1", n.alias("n_point"))


def _rows_of(grid: Grid, spans: DataFrame) -> DataFrame:
    """One row per grid row of each box, with its latitude, spread over the cluster.

    Columns are listed only after that, so one wide array does not unfold in a single task.
    """
    keep = [c for c in spans.columns if c not in ("iy0", "iy1", "n_point")]
    return (spans.select(*keep, F.explode(F.sequence("iy0", "iy1")).alias("iy"))
            .repartition("config", "iy").join(grid.nodes("YC", "iy", "lat"), "iy"))


def _columns_of(grid: Grid, rows: DataFrame) -> DataFrame:
    cells = rows.withColumn("ix", F.explode(F.sequence("ix0", "ix1")))
    return cells.join(grid.nodes("XC", "ix", "lon"), "ix")


def box_cells(grid: Grid, positions: DataFrame, margin: float = BOX_MARGIN_DEG) -> DataFrame:
    """(config, iy, ix, lat, lon): every tracer cell centre in each array's box."""
    rows = _rows_of(grid, box_spans(grid, positions, margin))
    return _columns_of(grid, rows).select("config", "iy", "ix", "lat", "lon")


def hull_cells(grid: Grid, positions: DataFrame) -> DataFrame:
    """Durable (config, iy, ix, lat, lon): tracer cell centres strictly inside each array's hull.

    Scan lines: on a line of latitude the hull reaches from its falling to its rising edge
    (interior on the left). Every edge is listed on the grid rows it crosses, two edges a row,
    and only the columns between them are listed. The result has no time or depth and feeds
    several operators, so it is written once.
    """
    rise, lat = F.col("by") - F.col("ay"), F.col("lat")
    at = F.col("ax") + (F.col("bx") - F.col("ax")) * (lat - F.col("ay")) / rise
    edges = (_edges(positions).filter("y0 <> y1")
             .withColumnsRenamed({"x0": "ax", "y0": "ay", "x1": "bx", "y1": "by"})
             .withColumns({"low": F.least("ay", "by"), "high": F.greatest("ay", "by")}))
    crossed = _index_range(edges, grid, "YC", "low", "high", "iy0", "iy1")
    cut = (crossed.withColumn("iy", F.explode(F.sequence("iy0", "iy1"))).join(grid.nodes("YC", "iy", "lat"), "iy")
           .filter((lat > F.col("y_min")) & (lat < F.col("y_max")))
           .groupBy("config", "iy", "lat")
           .agg(F.max(F.when(rise < 0, at)).alias("west"), F.min(F.when(rise > 0, at)).alias("east"))
           .filter(F.col("west") < F.col("east")))
    inside = (_columns_of(grid, _index_range(cut, grid, "XC", "west", "east", "ix0", "ix1"))
              .filter((F.col("lon") > F.col("west")) & (F.col("lon") < F.col("east")))
              .select("config", "iy", "ix", "lat", "lon"))
    return durable(inside, "hull-cells")
