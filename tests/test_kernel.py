"""Forms of the kernel, completion of short targets, and what reaches the scan."""

import pytest
from pyspark.sql import functions as F

from fathomgrid.operators import interpolation as I
from fathomgrid.operators import velocity as V
from fathomgrid.operators.geometry import hull_cells
from fathomgrid.plans.vertical_velocity import w_comparison, w_range
from fathomgrid.sources import cells as C
from .fields import Cube, hexagon, positions_df


@pytest.fixture(scope="module")
def cube(spark):
    return Cube(spark, missing=0.05)


@pytest.fixture(scope="module")
def arrays(spark):
    return positions_df(spark, hexagon(0.01, 220.0, 0.13) + hexagon(0.02, 220.0, 0.1, "near") + hexagon(5.0, 225.0, 0.1, "away"))


def rows(df, keys):
    return {tuple(r[k] for k in keys): tuple(r[c] for c in df.columns if c not in keys) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for key, values in a.items():
        for x, y in zip(values, b[key]):
            assert y == (x if x is None or not isinstance(x, float) else pytest.approx(x, rel=1e-9, abs=1e-12)), key


def test_both_forms_agree(spark, cube, arrays):
    model = C.load_model(cube.raw)
    keys = ["config", "iy", "ix", "time", "k"]
    direct, levels = (rows(I.model_region(model, cube.grid, arrays, ("WVEL", "UVEL", "VVEL", "SALT"), 12, 1, form=f)
                           .select(*keys, "U", "V", "S", "W"), keys) for f in ("direct", "levels first"))
    assert any(v[0] is None for v in direct.values()) and any(v[0] is not None for v in direct.values())
    same(direct, levels)
    columns = hull_cells(cube.grid, arrays).select("config", "iy", "ix")
    same(*(rows(V.cell_divergence(model, cube.grid, columns, 12, 1, form=f), keys) for f in ("direct", "levels first")))


def test_the_form_follows_the_fan_out():
    # many targets on each cell and many levels in each layer: sum instead of product
    assert I.better_form((3000, 1000), (60, 10), 30) == "levels first"
    # one target per cell, levels coarser than the model's: nothing to win
    assert I.better_form((1000, 1000), (20, 20), 10) == "direct"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_blind_pairing_and_no_second_scan(spark, cube, arrays, monkeypatch):
    plans = []
    whole = I.recorded
    monkeypatch.setattr(I, "recorded", lambda df, *a, **k: (plans.append(executed(df)), whole(df, *a, **k))[1])
    monkeypatch.setattr(I, "TIMES_PER_BUCKET", 2)
    model = C.load_model(cube.raw.where("not (iter = 72 and iy < 5)"))  # some targets are short at one time
    got = I.model_region(model, cube.grid, arrays, ("WVEL", "UVEL", "VVEL", "THETA", "SALT"), 20, 2)
    n = hull_cells(cube.grid, arrays).count()
    assert got.count() == n * 4 * 10 and got.select("config", "iy", "ix", "time", "k").distinct().count() == n * 4 * 10
    plans.append(executed(got))
    assert not [p for p in plans if "CartesianProduct" in p or "NestedLoop" in p]
    samples = I.sample_fields(model, cube.grid, arrays, max_depth=8, dz=2)
    assert samples.count() == 18 * 4 * 4 and samples.where("config = 'away' and U is null").count() == 6 * 4 * 4
    assert V.model_w(model, cube.grid, arrays, 8, 2).count() == 2 * 4 * 5


def test_a_full_table_is_returned_as_written(spark, cube, arrays):
    model = C.load_model(cube.raw)
    inner = arrays.where("config = 'hex'")
    got = I.sample_fields(model, cube.grid, inner, max_depth=8, dz=2)
    assert "Union" not in executed(got) and got.count() == 6 * 4 * 4


def test_columns_without_a_level_are_filled(spark, cube):
    model = C.load_model(cube.raw.where("not (iy = 3 and iz < 3)"))
    got = I.interp_levels(model, cube.grid, ["WVEL"], 8, 2)
    assert got.count() == 10 * 12 * 4 * 4
    assert got.where("iy = 3 and k = 0 and W is not null").count() == 0


@pytest.fixture(scope="module")
def stored(spark, cube, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "table")
    raw = cube.raw
    for step in (144, 288, 432):
        raw = raw.unionByName(cube.raw.withColumn("iter", F.col("iter") + step + 1))
    C.write_cells(raw.where("iter not in (108, 181)"), path, 72)
    return path


def test_snapshots_come_from_the_index(spark, stored):
    cells, index = C.read_cells(spark, stored), C.read_snapshots(spark, stored)
    every = sorted(r["iter"] for r in cells.select("iter").distinct().collect())
    assert sorted(r["iter"] for r in index.collect()) == every and len(every) == 14
    kept = C.select_snapshots(index, stride=3)
    model = C.load_model(cells, snapshots=kept)
    assert sorted(r["iter"] for r in model.select("iter").distinct().collect()) == every[::3]
    assert "dynamicpruning" in model._jdf.queryExecution().optimizedPlan().toString().lower()
    times = C.snapshot_times(kept)
    assert not [f for f in times.inputFiles() if "-snapshots" not in f]
    want = C.time_stride(C.load_model(cells), 3).select("time").distinct()
    assert sorted(times.collect()) == sorted(want.collect())
    late = C.select_snapshots(index, range(150, 500), start="2012-10-01T18", stride=2)
    assert sorted(r["iter"] for r in late.collect()) == [i for i in every if 216 <= i < 500][::2]


def test_known_times_are_not_read_again(spark, cube, stored, arrays):
    index = C.read_snapshots(spark, stored)
    model = C.load_model(C.read_cells(spark, stored), snapshots=index)
    I.known_times(model, cube.grid, C.snapshot_times(index))
    times, n = I.all_times(model, cube.grid)
    assert n == 14 and times.count() == 14


def test_ranges_of_a_comparison_bound_the_scan(spark, cube, stored, arrays, monkeypatch):
    plans = []
    whole = I.recorded
    monkeypatch.setattr(I, "recorded", lambda df, name, **k: (plans.append((name, executed(df))), whole(df, name, **k))[1])
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    model = C.load_model(C.read_cells(spark, stored))
    limits = dict(depth_range=(-1, -7), time_range=("2012-10-01T06", "2012-10-02"))
    got = w_comparison(model, cube.grid, arrays, 12, 2, **limits)
    kernels = [p for name, p in plans if name in ("kernel", "hull-w")]
    assert kernels and all("GreaterThanOrEqual(iter," in p and "LessThanOrEqual(iter," in p for p in kernels)
    assert all("LessThanOrEqual(iz," in p for p in kernels)
    want = w_range(w_comparison(model, cube.grid, arrays, 12, 2), **limits)
    keys = ["config", "time", "k"]
    same(rows(got, keys), rows(want.select(*got.columns), keys))
