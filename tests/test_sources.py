import json

import pytest
from pyspark.sql import functions as F

from fathomgrid import durable as durable_module
from fathomgrid.operators.summaries import domain_mean, map_rows
from fathomgrid.plans.domain_mean import domain_maps, velocity_map
from fathomgrid.plans.field_comparison import FieldComparison, write_stats
from fathomgrid.plans.vertical_velocity import w_comparison, w_comparison_tables, w_limits
from fathomgrid.sources import arrays
from fathomgrid.sources import cells as C

from .fields import Cube, hexagon, positions_df

CONFIG = {"name": "rect", "description": "four corners", "center": {"lat": 0.0, "lon": 220.0}, "x_deg": 0.25,
          "positions": [[0.5, 219.75], [-0.5, 219.75], [0.5, 220.25], [-0.5, 220.25]]}


def test_array_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "rect.json").write_text(json.dumps(CONFIG, indent=2))
    wide = dict(CONFIG, name="wide", diameter_deg=0.5)
    del wide["x_deg"]
    (tmp_path / "deep" / "wide.json").write_text(json.dumps(wide, indent=2))
    got = arrays.load_positions(spark, str(tmp_path)).orderBy("config", "glider").collect()
    assert [tuple(r) for r in got[:4]] == [("rect", g, *p) for g, p in enumerate(CONFIG["positions"])]
    meta = {r["config"]: (r["x_deg"], r["diameter_deg"]) for r in arrays.read_arrays(spark, str(tmp_path)).collect()}
    assert meta == {"rect": (0.25, None), "wide": (None, 0.5)}


def test_hexagons(spark):
    centers = spark.createDataFrame([("h", 1.0, 220.0, 0.25)], "config string, lat double, lon double, diameter double")
    got = arrays.hexagon_positions(centers).orderBy("glider").collect()
    for r, (_, g, lat, lon) in zip(got, hexagon(1.0, 220.0, 0.125)):
        assert (r["glider"], r["lat"], r["lon"]) == (g, pytest.approx(lat, abs=1e-14), pytest.approx(lon, abs=1e-12))


def test_further_columns_come_with_the_sensors(spark):
    centers = spark.createDataFrame([(f"h{i}", 1.0 * i, 220.0, 0.25) for i in range(3)],
                                    "config string, lat double, lon double, diameter double")
    written = centers.select("config", "diameter", F.transform(arrays.hexagon(), lambda p: F.array(p["lat"], p["lon"])).alias("positions"))
    got = arrays.positions(written, F.col("diameter").alias("size"))
    assert got.columns == ["config", "glider", "lat", "lon", "size"]
    assert sorted(map(tuple, got.drop("size").collect())) == sorted(map(tuple, arrays.hexagon_positions(centers).collect()))


def test_listed_arrays_are_not_joined(spark):
    from checks.queries import QUERIES
    plan = QUERIES["positions_explode"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # nothing passes through the driver


def test_a_range_of_snapshots_without_end(spark):
    numbers = spark.createDataFrame([(36 * i, 0, 10 ** 6) for i in range(1, 20)] + [(360_000, 0, 10 ** 6)],
                                    "iter int, iter_from int, iter_to int")
    kept = C.select_snapshots(numbers, iters=range(72, 2 ** 31, 36))
    assert sorted(r["iter"] for r in kept.collect()) == [36 * i for i in range(2, 20)] + [360_000]


def test_stored_snapshots_of_a_larger_table(spark, tmp_path, monkeypatch):
    from checks import fixtures as X
    from checks.queries import QUERIES

    late = [36 * i for i in range(2, 30)] + [36 * i for i in range(3000, 3030)]  # above 100,000
    cells = spark.createDataFrame([(i, 1, 0, 0, *[1.0] * 5) for i in late], C.CELL_SCHEMA)
    monkeypatch.setattr(X, "raw_cells", lambda spark, d: cells)
    got = QUERIES["stored_irregular_stride"](spark, str(tmp_path)).count()
    assert got == len([i for i in late if i % 5][::3])


@pytest.fixture(scope="module")
def series(spark):
    return spark.range(36, 36 * 100, 36).select(
        F.col("id").cast("int").alias("iter"), F.lit(1).alias("iz"), F.lit(0).alias("iy"), F.lit(0).alias("ix"),
        F.when(F.col("id") % 72 == 0, -999.0).when(F.col("id") % 108 == 0, float("nan")).otherwise(1.5).alias("UVEL"))


def test_load_masks_data_and_stamps_time(spark, series):
    df = C.load_model(series, range(36, 36 * 6 + 1, 36))
    got = [(r["iter"], r["time"].isoformat(), r["UVEL"]) for r in df.orderBy("iter").collect()]
    assert got[0] == (36, "2012-10-01T03:00:00", 1.5)
    assert [v for _, _, v in got] == [1.5, None, None, None, 1.5, None]
    assert "UVEL" in C.load_model(series).columns and C.load_model(series).count() == 99
    assert C.load_model(series, [36, 360]).count() == 2
    assert C.load_model(series, range(36, 3600, 72)).count() == 50
    plan = C.load_model(series, range(72, 145, 36))
    assert [r["iter"] for r in plan.orderBy("iter").collect()] == [72, 108, 144]


@pytest.mark.parametrize("start, end, first, last", [
    ("2012-10-11", None, "2012-10-11T00:00", "2012-10-13T09:00"),
    (None, "2012-10-02", "2012-10-01T03:00", "2012-10-02T21:00"),
    ("2012-10-02", "2012-10-04", "2012-10-02T00:00", "2012-10-04T21:00"),
    ("2012-10-02T06", "2012-10-02T12", "2012-10-02T06:00", "2012-10-02T12:00"),
    ("2012", "2012-10", "2012-10-01T03:00", "2012-10-13T09:00"),
])
def test_time_labels_are_inclusive(spark, series, start, end, first, last):
    r = C.time_slice(C.load_model(series), start, end).agg(F.min("time"), F.max("time")).first()
    assert (r[0].isoformat()[:16], r[1].isoformat()[:16]) == (first, last)


def test_stride_keeps_every_third_time(spark, series):
    cells = C.time_slice(C.load_model(series), "2012-10-01T12")
    both = cells.unionByName(cells)  # several rows per time
    got = [r["iter"] for r in C.time_stride(both, 3).select("iter").distinct().orderBy("iter").collect()]
    assert got == list(range(144, 3600, 36))[::3]


def test_written_cells_come_back_and_prune(spark, tmp_path):
    cube = Cube(spark, seed=9, times=3)
    path = str(tmp_path / "cells")
    C.write_cells(cube.raw, path, iters_per_part=36)
    back = C.read_cells(spark, path)
    assert back.count() == cube.raw.count()
    assert back.select(cube.raw.columns).exceptAll(cube.raw).count() == 0
    late = C.load_model(back, range(108, 145, 36)).filter("iy between 2 and 3").select("time", "UVEL")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = late._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(iy,2)" in scan and "GreaterThanOrEqual(iter,108)" in scan
    assert "iter_to" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "VVEL" not in scan.split("ReadSchema")[1]
    assert late.count() == 6 * 2 * cube.nx


def test_domain_mean_tests_depth_on_each_axis(spark):
    cube = Cube(spark, seed=2)
    cells = C.load_model(cube.raw)
    got = {(r["iy"], r["ix"]): r for r in domain_mean(cells, cube.grid, 9).collect()}
    import numpy as np
    for var, name, z in (("UVEL", "U", "Z"), ("WVEL", "W", "Zl")):
        want = np.nanmean(cube.data[var][:, cube.pos[z] >= -9], axis=(0, 1))
        assert all(got[k][name] == pytest.approx(want[k], rel=1e-10) for k in got)
    rows = map_rows(domain_mean(cells, cube.grid, 9), cube.grid)
    assert rows.count() == 3 * cube.ny * cube.nx
    one = rows.filter("variable = 'U' and iy = 3 and ix = 4").first()
    assert (one["lat"], one["lon"]) == (cube.pos["YC"][3], cube.pos["XG"][4])
    maps = domain_maps(cells, cube.grid, 9, window={"lon": (219.9, 220.0), "lat": (-0.05, 0.05)})
    assert 0 < maps["maps"].count() < rows.count() and maps["limits"].count() == 3


def test_velocity_map_keeps_the_margin_around_each_array(spark):
    cube = Cube(spark, seed=2)
    pos = positions_df(spark, hexagon(0.0, 220.0, 0.02) + hexagon(0.0, 220.1, 0.02, "b"))
    got = velocity_map(C.load_model(cube.raw), cube.grid, pos, 9, margin=0.03)
    box = got.groupBy("config").agg(F.min("lon"), F.max("lon")).collect()
    assert {r["config"] for r in box} == {"hex", "b"}
    assert all(r[2] - r[1] < 0.11 for r in box)


def test_comparison_tables(spark):
    cube = Cube(spark, seed=8, missing=0.0)
    pos = positions_df(spark, hexagon(0.01, 220.0, 0.13))
    rows = w_comparison(C.load_model(cube.raw), cube.grid, pos, 10, 2)
    tables = w_comparison_tables(rows, (-1, -8), point_depth=-50)
    assert {r["k"] for r in tables["hovmoller"].select("k").collect()} == {1, 2, 3, 4}
    assert {r["k"] for r in tables["point"].collect()} == {4}
    assert tables["profiles"].count() == 4 and tables["series"].count() == 4
    assert {r["what"] for r in w_limits(rows).collect()} == {"w", "bias"}


def test_stats_records_are_written_per_array(spark, tmp_path):
    cube = Cube(spark, seed=8, missing=0.0)
    pos = positions_df(spark, hexagon(0.01, 220.0, 0.13) + hexagon(0.0, 220.05, 0.1, "b"))
    run = FieldComparison(C.load_model(cube.raw), cube.grid, pos, 12, 2)
    records = run.stats_record(tstep=3)
    path = str(tmp_path / "stats")
    write_stats(records, path)
    back = spark.read.json(path).collect()
    assert {r["name"] for r in back} == {"hex", "b"} and {r["max_depth"] for r in back} == {12}
    r = next(r for r in back if r["name"] == "hex")
    assert (r["n_glider"], r["n_time"], r["tstep"]) == (6, 4, 3) and r["n_point"] > r["n_hull"] > 0
    assert set(r["fields"].asDict()) == {"T", "S", "U", "V", "sigma0", "divergence"}
    assert set(r["flux"].asDict()) == {"wT", "wS", "wU", "wV"}
    assert -1 <= r["div_corr"] <= 1
    assert all(0 <= f["ks"] <= 1 and 0 <= f["js"] <= 1 for f in r["fields"].asDict().values())


def test_plain_join_equals_broadcast(spark, monkeypatch):
    big = spark.range(5000).selectExpr("if(id % 10 < 8, 0, id % 7) as k", "id")
    side = spark.range(7).selectExpr("id as k", "id * 10 as v")
    want = durable_module.join_checked(big, side, ["k"]).orderBy("id").collect()
    monkeypatch.setattr(durable_module, "BROADCAST_ROWS", 0)
    got = durable_module.join_checked(big, side, ["k"])
    assert got.orderBy("id").collect() == want
    semi = durable_module.join_checked(big, side.filter("k < 2"), ["k"], how="left_semi")
    assert semi.count() == big.filter("k < 2").count()


def test_shared_folder_is_the_clusters(spark, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert durable_module.durable_root(spark) == named.rstrip("/")


def test_a_run_leaves_no_tables(spark, tmp_path):
    import os

    from fathomgrid.durable import durable, durable_root, run_scope

    root = f"{durable_root(spark)}/{spark.sparkContext.applicationId}".removeprefix("file:")
    with run_scope(spark):
        kept = durable(spark.range(5).toDF("id"), "kept", keep=True)
        inner = durable(spark.range(5).toDF("id"), "inner")
        assert inner.count() == 5
        there = set(os.listdir(root))
    assert {n.rsplit("-", 1)[0] for n in there - set(os.listdir(root))} == {"inner"}
    assert kept.count() == 5
