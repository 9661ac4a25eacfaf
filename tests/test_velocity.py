import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.operators import velocity as V
from fathomgrid.operators.interpolation import interfaces_to_layers, sample_fields
from fathomgrid.sources.cells import load_model

from .fields import Cube, M_PER_DEG, hexagon, inside_convex, linear_samples, positions_df


def test_divergence_of_a_linear_field_is_recovered(spark):
    rows = hexagon(0.0, 220.0, 0.125)
    div = V.planefit_divergence(linear_samples(spark, rows, 1e-5), positions_df(spark, rows)).toPandas()
    assert len(div) == 30
    assert np.allclose(div["div"], 1e-5, rtol=1e-6)


def test_w_is_divergence_times_depth(spark):
    rows = hexagon(0.0, 220.0, 0.125)
    samples = linear_samples(spark, rows, 1e-5)
    read_off, div = V.planefit_w(samples, positions_df(spark, rows))
    assert div.filter("obs_depth = -(2 * k + 1)").count() == 30
    w, _ = V.planefit_w(samples, positions_df(spark, rows), dz=2)
    assert read_off.exceptAll(w).count() == 0
    w = w.filter("time = 0").orderBy("k").toPandas()
    assert list(w["k"]) == list(range(11))
    assert np.allclose(w["w_est"], 1e-5 * np.arange(11) * 2, rtol=1e-6)
    assert w["w_est"][0] == 0.0 and w["depth"][5] == -10.0


def test_layer_thickness(spark):
    rows = hexagon(0.0, 220.0, 0.125)
    samples = linear_samples(spark, rows, 1e-5, dz=3.0)
    assert V.layer_thickness(samples).first()["dz"] == 3.0
    assert V.layer_thickness(samples.filter("k = 0")).first()["dz"] == 3.0


def pinv_gradients(rows):
    lat, lon = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    x = (lon - lon.mean()) * np.cos(np.radians(lat.mean())) * M_PER_DEG
    y = (lat - lat.mean()) * M_PER_DEG
    return np.linalg.pinv(np.column_stack([np.ones(len(x)), x, y]), rcond=1e-8)[1:]


@pytest.mark.parametrize("rows", [
    hexagon(10.0, 220.0, 0.3),
    [("a", 0, 0.0, 219.9), ("a", 1, 0.2, 220.3), ("a", 2, -0.4, 220.0)],
    [("a", g, 0.1 * g, 220 + 0.2 * g) for g in range(5)],
    [("a", 0, 1.0, 220.0)],
], ids=["hexagon", "triangle", "line", "point"])
def test_fit_weights_match_the_pseudo_inverse(spark, rows):
    got = V.planefit_weights(positions_df(spark, rows)).orderBy("glider").toPandas()
    want = pinv_gradients(rows)
    # on a line the truncated decomposition itself is only good to about 1e-10
    assert np.allclose(got["wx"], want[0], rtol=1e-6, atol=2e-10)
    assert np.allclose(got["wy"], want[1], rtol=1e-6, atol=2e-10)


def test_one_missing_sensor_kills_its_level_and_all_deeper_w(spark):
    rows = hexagon(0.0, 220.0, 0.125)
    hole = (F.col("time") == 1) & (F.col("k") == 4) & (F.col("glider") == 2)
    samples = linear_samples(spark, rows, 1e-5).withColumn("U", F.when(~hole, F.col("U")))
    div = V.planefit_divergence(samples, positions_df(spark, rows))
    assert [tuple(r) for r in div.filter("div is null").select("time", "k").collect()] == [(1, 4)]
    w = V.w_from_divergence(div, 2.0)
    assert sorted(r["k"] for r in w.filter("w_est is null").collect()) == [5, 6, 7, 8, 9, 10]
    absent = V.planefit_divergence(samples.filter(~hole), positions_df(spark, rows))
    assert absent.filter("div is null").count() == 1


def test_depth_mean_removal(spark):
    rows = hexagon(0.0, 220.0, 0.125)
    samples = linear_samples(spark, rows, 1e-5)
    div = V.planefit_divergence(samples, positions_df(spark, rows), 10, remove_barotropic=True)
    assert np.allclose(div.toPandas()["div"], 0, atol=1e-18)
    hole = (F.col("time") == 0) & (F.col("k") == 4) & (F.col("glider") == 2)
    broken = V.planefit_divergence(samples.filter(~hole), positions_df(spark, rows), 10, remove_barotropic=True)
    assert sorted(r["k"] for r in broken.filter("div is null").collect()) == list(range(10))


@pytest.fixture(scope="module")
def cube(spark):
    return Cube(spark, missing=0.004)


@pytest.fixture(scope="module")
def arrays(spark):
    return hexagon(0.01, 220.0, 0.13) + [
        ("box", 0, -0.1, 219.85), ("box", 1, -0.1, 220.1), ("box", 2, 0.12, 219.85), ("box", 3, 0.12, 220.1),
        ("box", 4, 0.0, 219.85), ("out", 0, 0.0, 219.9), ("out", 1, 0.1, 220.0), ("out", 2, 0.0, 230.0)]


def test_fused_divergence_equals_the_two_step_one(spark, cube, arrays):
    cells, pos = load_model(cube.raw), positions_df(spark, arrays)
    fused = V.array_divergence(cells, cube.grid, pos, 12, 2)
    steps = V.planefit_divergence(sample_fields(cells, cube.grid, pos, ("UVEL", "VVEL"), 12, 2), pos)
    a = fused.orderBy("config", "time", "k").toPandas()
    b = steps.orderBy("config", "time", "k").toPandas()
    assert len(a) == len(b) == 72  # also the array with a sensor off the grid
    assert (a[["config", "time", "k"]] == b[["config", "time", "k"]]).all(None)
    assert a["div"].notna().sum() > 10 and a["div"].isna().sum() > 0
    assert np.allclose(a["div"], b["div"], rtol=1e-9, equal_nan=True)
    assert steps.filter("config = 'out' and div is not null").count() == 0


def hull_mask(cube, rows):
    return np.array([[inside_convex(rows, x, y) for x in cube.pos["XC"]] for y in cube.pos["YC"]])


def test_model_w_is_the_hull_mean(spark, cube, arrays):
    w = V.model_w(load_model(cube.raw), cube.grid, positions_df(spark, [a for a in arrays if a[0] != "out"]), 10, 2)
    w = {(r["config"], r["time"].hour // 3 - 1, r["k"]): r["w_model"] for r in w.collect()}
    for config in ("hex", "box"):
        mask = hull_mask(cube, [a for a in arrays if a[0] == config])
        for k in range(6):
            values = np.stack([[cube.interp("WVEL", x, y, -2.0 * k) for x in cube.pos["XC"]] for y in cube.pos["YC"]])
            want = np.nanmean(values[mask], axis=0)
            for t in range(cube.nt):
                assert math.isclose(w[config, t, k], want[t], rel_tol=1e-9)


def test_trend_removal_brings_the_deepest_w_to_zero(spark, cube, arrays):
    pos = positions_df(spark, [a for a in arrays if a[0] == "hex"])
    for mean in (True, False):
        w = V.model_w(load_model(cube.raw), cube.grid, pos, 10, 2, remove_barotropic=True, spatial_mean=mean)
        deepest = [r["w_model"] for r in w.filter("k = 5").collect()]
        assert all(v is None or abs(v) < 1e-12 for v in deepest)


def test_flux_divergence_against_direct_differences(spark, cube):
    rows = [("all", 0, -0.25, 219.7), ("all", 1, -0.25, 220.3), ("all", 2, 0.25, 219.7), ("all", 3, 0.25, 220.3)]
    cols = spark.createDataFrame([("all", y, x) for y in range(cube.ny) for x in range(cube.nx)],
                                 "config string, iy int, ix int")
    got = V.cell_divergence(load_model(cube.raw), cube.grid, cols, 12, 2).collect()
    u = np.pad(cube.data["UVEL"] * cube.dyg, ((0, 0), (0, 0), (0, 0), (0, 1)))
    v = np.pad(cube.data["VVEL"] * cube.dxg, ((0, 0), (0, 0), (0, 1), (0, 0)))
    div = (np.diff(u, axis=3) + np.diff(v, axis=2)) / cube.ra
    z = cube.pos["Z"]
    assert len(got) == cube.nt * 6 * cube.ny * cube.nx
    for r in got:
        t, d = r["time"].hour // 3 - 1, -(r["k"] * 2.0 + 1)
        i = np.searchsorted(-z, -d, side="right") - 1
        f = (d - z[i]) / (z[i + 1] - z[i])
        want = (1 - f) * div[t, i, r["iy"], r["ix"]]
        if f > 0:  # a level on a node needs that node alone
            want += f * div[t, i + 1, r["iy"], r["ix"]]
        assert (r["div"] is None and np.isnan(want)) or math.isclose(r["div"], want, rel_tol=1e-9, abs_tol=1e-18)
    mean = V.model_divergence(load_model(cube.raw), cube.grid, positions_df(spark, rows), 12, 2)
    assert mean.count() == cube.nt * 6


def test_interfaces_to_layers(spark):
    w = spark.createDataFrame([("a", 0, k, float(v) if v is not None else None)
                               for k, v in enumerate([0, 2, None, 6, 8])], "config string, time int, k int, w double")
    got = [(r["k"], r["w"]) for r in interfaces_to_layers(w, "w").orderBy("k").collect()]
    assert got == [(0, 1.0), (1, None), (2, None), (3, 7.0)]


def test_divergence_correlation_needs_every_value(spark):
    a = spark.createDataFrame([("a", 0, k, float(k)) for k in range(5)], "config string, time int, k int, div double")
    b = a.withColumn("div", F.col("div") * 2 + F.when(F.col("k") == 2, 1).otherwise(0))
    assert V.divergence_correlation(a, b).first()["div_corr"] > 0.9
    holed = b.withColumn("div", F.when(F.col("k") != 3, F.col("div")))
    assert V.divergence_correlation(a, holed).first()["div_corr"] is None
