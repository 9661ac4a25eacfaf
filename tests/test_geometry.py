import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fathomgrid.operators import geometry as G
from fathomgrid.operators import interpolation as I
from fathomgrid.sources.cells import load_model

from .fields import Cube, M_PER_DEG, hexagon, inside_convex, positions_df


@pytest.fixture(scope="module")
def cube(spark):
    return Cube(spark, seed=3)


def test_projection(spark):
    rows = [("a", 0, 10.0, 20.0), ("a", 1, 12.0, 24.0), ("b", 0, 5.0, 5.0)]
    got = {(r["config"], r["glider"]): (r["x_m"], r["y_m"]) for r in G.project_to_metres(positions_df(spark, rows)).collect()}
    assert np.allclose(got["a", 1], (2 * np.cos(np.radians(11)) * M_PER_DEG, M_PER_DEG))
    assert got["b", 0] == (0.0, 0.0)


def test_levels(spark):
    obs = G.obs_levels(spark, 70, 2).orderBy("k").toPandas()
    assert len(obs) == 35 and obs["z"][0] == -1 and obs["z"][34] == -69
    ifc = G.interface_levels(spark, 70, 2).orderBy("k").toPandas()
    assert len(ifc) == 36 and ifc["z"][0] == 0 and ifc["z"][35] == -70


def test_nearest_level(spark):
    levels = spark.createDataFrame([("a", k, -2.0 * k) for k in range(11)], "config string, k int, depth double")
    assert G.nearest_level(levels, -7.2).first()["k"] == 4
    assert G.nearest_level(levels, -500).first()["k"] == 10


def hull_points(spark, rows):
    e = G.hull_edges(positions_df(spark, rows)).collect()
    return {(r["x0"], r["y0"]) for r in e}


def test_hull_drops_inner_and_collinear_points(spark):
    rows = [("r", g, lat, lon) for g, (lat, lon) in enumerate(
        [(0, 0), (0, 2), (-1, 0), (-1, 2), (1, 0), (1, 2), (0, 1), (1, 1), (0, 0)])]
    assert hull_points(spark, [(c, g, float(a), float(b)) for c, g, a, b in rows]) == {
        (0.0, -1.0), (2.0, -1.0), (2.0, 1.0), (0.0, 1.0)}


def test_a_line_is_marked_and_others_go_on(spark):
    rows = [("l", g, 0.1 * g, 0.2 * g) for g in range(4)] + hexagon(0.0, 220.0, 0.1) + [
        ("tiny", 0, 0.0, 220.0), ("tiny", 1, 5e-7, 220.0), ("tiny", 2, 0.0, 220.0000005)]
    got = {r["config"]: r for r in G.hull_vertices(positions_df(spark, rows)).collect()}
    assert got["l"]["problem"] == "spans no area" and got["l"]["vertices"] is None
    assert len(got["hex"]["vertices"]) == 6 and len(got["tiny"]["vertices"]) == 3
    assert {r["config"] for r in G.hull_edges(positions_df(spark, rows)).collect()} == {"hex", "tiny"}


def test_large_array_hull_is_built_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(3000, 2))
    rows = [("big", i, float(a), float(b)) for i, (a, b) in enumerate(pts)] + hexagon(0.0, 0.0, 1.0, "small")
    whole = hull_points(spark, rows)
    monkeypatch.setattr(G, "HULL_PART", 256)
    assert hull_points(spark, rows) == whole


def ring_of(n, radius=1.0, squash=1.0):
    return [("ring", i, squash * radius * math.sin(2 * math.pi * i / n), 220 + radius * math.cos(2 * math.pi * i / n)) for i in range(n)]


def test_hulls_with_more_vertices_than_a_list(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = ring_of(900, squash=0.7)
    # a little inside, so that random parts keep many of them; and many at nearly one angle
    rows += [("ring", 900 + i, lat * 0.9999, 220 + (lon - 220) * 0.9999) for i, (_, _, lat, lon) in enumerate(ring_of(899, squash=0.7))]
    rows += [("ring", 2000 + i, 0.5 + 1e-6 * y, 220.6 + 1e-6 * x) for i, (x, y) in enumerate(rng.normal(size=(300, 2)))]
    rows += [("small", i, lat, lon) for _, i, lat, lon in hexagon(0.0, 220.0, 0.3)]
    rng.shuffle(rows)
    rows = [(c, int(g), float(a), float(b)) for c, g, a, b in rows]
    whole = hull_points(spark, rows)
    monkeypatch.setattr(G, "HULL_PART", 64)
    monkeypatch.setattr(G, "RING_PART", 40)
    sizes = []
    collect = G._kept_stretch
    monkeypatch.setattr(G, "_kept_stretch", lambda points, eps: (sizes.append(1), collect(points, eps))[1])
    assert hull_points(spark, rows) == whole
    assert sizes
    found = {r["config"]: r["problem"] for r in G.hull_vertices(positions_df(spark, rows)).collect()}
    assert found == {"ring": "too many vertices for a list", "small": None}
    edges = [r for r in G.hull_edges(positions_df(spark, rows)).collect() if r["config"] == "ring"]
    ends = {(r["x0"], r["y0"]): (r["x1"], r["y1"]) for r in edges}
    at = start = next(iter(ends))
    for _ in edges:  # one closed line, anticlockwise
        at = ends[at]
    assert at == start and len(ends) == len(edges)
    assert sum(r["x0"] * r["y1"] - r["x1"] * r["y0"] for r in edges) > 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-40, 40), st.integers(-40, 40)), min_size=3, max_size=12, unique=True))
def test_cells_inside_random_hulls(spark, cube, points):
    a = np.array(points, dtype=float)
    if np.linalg.matrix_rank(a - a[0]) < 2:
        return
    # off the grid's lattice, so that no centre lies exactly on an edge
    rows = [("p", i, lat * 0.00571 + 0.00013 * i, 220 + lon * 0.00617 + 0.00017 * i * i) for i, (lat, lon) in enumerate(points)]
    got = {(r["iy"], r["ix"]) for r in G.hull_cells(cube.grid, positions_df(spark, rows)).collect()}
    want = {(y, x) for y, lat in enumerate(cube.pos["YC"]) for x, lon in enumerate(cube.pos["XC"])
            if inside_convex(rows, lon, lat)}
    assert got == want


def test_cells_on_an_edge_are_outside(spark, cube):
    x, y = cube.pos["XC"], cube.pos["YC"]
    rows = [("e", 0, y[2], x[2]), ("e", 1, y[2], x[6]), ("e", 2, y[6], x[2]), ("e", 3, y[6], x[6])]
    got = {(r["iy"], r["ix"]) for r in G.hull_cells(cube.grid, positions_df(
        spark, [(c, g, float(a), float(b)) for c, g, a, b in rows])).collect()}
    assert got == {(a, b) for a in (3, 4, 5) for b in (3, 4, 5)}


def test_box_counts(spark, cube):
    rows = hexagon(0.0, 220.0, 0.05) + hexagon(50.0, 220.0, 0.05, "away")
    got = {r["config"]: r["n_point"] for r in G.box_spans(cube.grid, positions_df(spark, rows)).collect()}
    lon, lat = [r[3] for r in rows[:6]], [r[2] for r in rows[:6]]
    nx = sum(min(lon) - 0.125 <= p <= max(lon) + 0.125 for p in cube.pos["XC"])
    ny = sum(min(lat) - 0.125 <= p <= max(lat) + 0.125 for p in cube.pos["YC"])
    assert got == {"hex": nx * ny}
    assert G.box_cells(cube.grid, positions_df(spark, rows)).count() == nx * ny


def test_published_box_sizes(spark):
    """Box sizes on the 1/24 degree grid for the array shapes with known counts."""
    from fathomgrid.grid import Grid
    axes = [("XC", i, 220 + (i - 54 + 0.5) / 24) for i in range(108)] + [("YC", i, (i - 54 + 0.5) / 24) for i in range(108)]
    rows = []
    for x in (0.1, 0.25, 0.5, 1.0):
        # two sensors on the equator, four at the corners, meridional side twice the zonal one
        for g, (lat, lon) in enumerate([(0, -x), (0, x), (-2 * x, -x), (-2 * x, x), (2 * x, -x), (2 * x, x)]):
            rows.append((f"x{x}", g, float(lat), 220 + lon))
    grid = Grid(spark.createDataFrame(axes, "axis string, idx int, pos double"))
    counts = {r["config"]: r["n_point"] for r in G.box_spans(grid, positions_df(spark, rows)).collect()}
    assert counts == {"x0.1": 160, "x0.25": 540, "x0.5": 1620, "x1.0": 5508}
    hull = {r["config"]: r["count"] for r in G.hull_cells(grid, positions_df(spark, rows)).groupBy("config").count().collect()}
    assert hull == {"x0.1": 40, "x0.25": 288, "x0.5": 1152, "x1.0": 4608}


def test_brackets(spark, cube):
    z = cube.pos["Z"]
    wanted = [("Z", float(p), i) for i, p in enumerate([-0.5, -14.0, -3.0, 0.0, -20.0, -7.0])]
    got = {}
    for r in G.brackets(cube.grid, spark.createDataFrame(wanted, "axis string, pos double, t int")).collect():
        got.setdefault(r["t"], {})[r["idx"]] = r["w"]
    assert got.keys() == {0, 1, 2, 5}
    assert got[0] == {0: 1.0} and got[1] == {5: 1.0} and got[5] == {3: 1.0}
    assert got[2] == pytest.approx({1: 0.6, 2: 0.4})
    assert all(abs(sum(w * z[i] for i, w in got[t].items()) - wanted[t][1]) < 1e-12 for t in got)


def check(got, want):
    assert (got is None and np.isnan(want)) or got == pytest.approx(want, rel=1e-9)


def test_samples_against_direct_interpolation(spark, cube):
    rows = hexagon(0.01, 220.0, 0.13) + [("odd", 0, 0.0, 220.21), ("odd", 1, float(cube.pos["YC"][3]), float(cube.pos["XC"][4]))]
    s = I.sample_fields(load_model(cube.raw), cube.grid, positions_df(spark, rows), max_depth=12, dz=2).collect()
    assert len(s) == 8 * cube.nt * 6
    where = {(r[0], r[1]): r for r in rows}
    filled = 0
    for r in s:
        _, _, lat, lon = where[r["config"], r["glider"]]
        assert (r["lat"], r["lon"]) == (lat, lon) and r["obs_depth"] == -(2.0 * r["k"] + 1)
        t = r["time"].hour // 3 - 1
        for var, name in (("UVEL", "U"), ("VVEL", "V"), ("THETA", "T"), ("SALT", "S")):
            check(r[name], cube.interp(var, lon, lat, r["obs_depth"])[t])
            filled += r[name] is not None
    assert filled > 400


def test_region_is_every_hull_cell_on_centres(spark, cube):
    rows = hexagon(0.01, 220.0, 0.13)
    region = I.model_region(load_model(cube.raw), cube.grid, positions_df(spark, rows),
                            ("WVEL", "UVEL", "VVEL", "THETA", "SALT"), 12, 2).collect()
    cells = {(y, x) for y, lat in enumerate(cube.pos["YC"]) for x, lon in enumerate(cube.pos["XC"]) if inside_convex(rows, lon, lat)}
    assert {(r["iy"], r["ix"]) for r in region} == cells
    for r in region[:400]:
        t = r["time"].hour // 3 - 1
        for var, name in (("UVEL", "U"), ("VVEL", "V"), ("THETA", "T"), ("SALT", "S"), ("WVEL", "W")):
            check(r[name], cube.interp(var, cube.pos["XC"][r["ix"]], cube.pos["YC"][r["iy"]], r["obs_depth"])[t])


def test_shapes_of_the_standard_depth_range(spark):
    """70 m in 2 m layers: 35 sample levels and 36 interfaces per time."""
    big = Cube(spark, seed=5, times=1, missing=0.0)
    deep = big.grid.axes.withColumn("pos", __import__("pyspark.sql.functions", fromlist=["f"]).expr(
        "case when axis like 'Z%' then pos * 6 + case when axis = 'Z' then 2.5 else 0 end else pos end"))
    from fathomgrid.grid import Grid
    from fathomgrid.operators.velocity import model_w
    grid = Grid(deep, big.grid.metrics)
    pos = positions_df(spark, hexagon(0.0, 220.0, 0.125))
    samples = I.sample_fields(load_model(big.raw), grid, pos)
    assert {"U", "V", "T", "S", "lat", "lon"} <= set(samples.columns)
    assert samples.count() == 6 * 35 and samples.filter("U is null or T is null").count() == 0
    w = model_w(load_model(big.raw), grid, pos)
    assert w.count() == 36 and w.filter("w_model is null").count() == 0


def test_kernel_without_broadcast_gives_the_same(spark, cube, monkeypatch):
    pos = positions_df(spark, hexagon(0.01, 220.0, 0.13))
    cols = ["config", "glider", "time", "k", "U", "V", "T", "S"]
    one = I.sample_fields(load_model(cube.raw), cube.grid, pos, max_depth=12, dz=2).select(cols).toPandas()
    monkeypatch.setattr("fathomgrid.durable.BROADCAST_ROWS", 0)
    two = I.sample_fields(load_model(cube.raw), cube.grid, pos, max_depth=12, dz=2).select(cols).toPandas()
    order = ["config", "glider", "time", "k"]
    one, two = (f.sort_values(order).reset_index(drop=True) for f in (one, two))
    assert np.allclose(one[["U", "V", "T", "S"]], two[["U", "V", "T", "S"]], rtol=1e-12, equal_nan=True)
