import pytest
from pyspark.sql import functions as F

from fathomgrid.plans.field_comparison import FieldComparison, write_stats
from fathomgrid.sources import cells as C
from .fields import Cube, hexagon, positions_df


@pytest.fixture(scope="module")
def cube(spark):
    return Cube(spark, missing=0.0)


@pytest.fixture(scope="module")
def arrays(spark):
    return positions_df(spark, hexagon(0.01, 220.0, 0.13) + hexagon(5.0, 225.0, 0.1, "away"))


def test_shallower_depth_from_the_same_tables(spark, cube, arrays, tmp_path):
    model = C.load_model(cube.raw)
    deep = FieldComparison(model, cube.grid, arrays, max_depth=12, dz=2)
    shallow = FieldComparison(model, cube.grid, arrays, max_depth=8, dz=2)
    want = {r["name"]: r for r in shallow.stats_record().collect()}
    record = deep.at_depth(8).stats_record()
    got = {r["name"]: r for r in record.collect()}
    assert got.keys() == want.keys() == {"hex", "away"}
    assert got["away"]["n_point"] == got["away"]["n_hull"] == 0 and got["away"]["div_corr"] is None
    assert got["hex"]["div_corr"] == pytest.approx(want["hex"]["div_corr"], rel=1e-9)
    for field, values in want["hex"]["fields"].items():
        for name, value in values.asDict().items():
            assert got["hex"]["fields"][field][name] == pytest.approx(value, rel=1e-9)
    path = str(tmp_path / "stats")
    write_stats(deep.stats_record(), path)
    write_stats(record, path)
    assert sorted((r["max_depth"], r["config"]) for r in spark.read.json(path).collect()) == [
        (8, "away"), (8, "hex"), (12, "away"), (12, "hex")]
    with pytest.raises(ValueError):
        deep.at_depth(20)


def test_labels_and_stride_reach_the_scan(spark, cube, tmp_path):
    path = str(tmp_path / "cells")
    C.write_cells(cube.raw.unionByName(cube.raw.withColumn("iter", F.col("iter") + 1152)), path, 72)
    stored = C.load_model(C.read_cells(spark, path), start="2012-10-01T06", end="2012-10-04", stride=3, every=36)
    every = C.load_model(C.read_cells(spark, path))
    want = C.time_stride(C.time_slice(every, "2012-10-01T06", "2012-10-04"), 3)
    assert sorted(r["time"] for r in stored.select("time").distinct().collect()) == sorted(
        r["time"] for r in want.select("time").distinct().collect())
    plan = stored._jdf.queryExecution().executedPlan().toString()
    folders = next(x for x in plan.split("PartitionFilters: [")[1:]).split("]")[0]
    assert "iter_to" in folders and "iter_from" in folders
    assert "GreaterThanOrEqual(iter," in plan and "LessThanOrEqual(iter," in plan


def test_mean_map_reads_the_levels_it_needs(spark, cube, tmp_path):
    from fathomgrid.operators.summaries import domain_mean

    path = str(tmp_path / "cells")
    C.write_cells(cube.raw, path)
    mean = domain_mean(C.load_model(C.read_cells(spark, path)), cube.grid, 3)
    plan = mean._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(iz," in plan


def test_copies_of_a_value_on_a_limit_are_counted_together(spark):
    # the third of 401 values is the lower limit: the sum 0.1 + 0.2, just above its two other copies 0.3
    values = [0.3, 0.3, 0.1 + 0.2] + [1 + i / 397 for i in range(398)]
    table = spark.createDataFrame([("a", v) for v in values], "config string, U double")
    run = FieldComparison(None, None, None, fields=("U",), digits=9)
    run.__dict__.update(obs_raw=table, true_raw=table.limit(0))
    assert sum(r["n_obs"] for r in run.field_pdfs().collect()) == 399
