"""Value cells, ranges of bounded size, and nested depths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.operators import distributions as D
from fathomgrid.operators import value_cells as C
from fathomgrid.plans.field_comparison import FieldComparison, write_stats
from fathomgrid.sources.cells import load_model
from .fields import Cube, hexagon, positions_df

PROBS = {"lo": 0.005, "mid": 0.5, "hi": 0.995, "min": 0.0, "max": 1.0}


def table(spark, values, sides=None):
    sides = sides if sides is not None else ["obs" if i % 3 == 0 else "true" for i in range(len(values))]
    return spark.createDataFrame([("a", s, float(v)) for s, v in zip(sides, values)], "config string, side string, v double")


VALUES = {
    "smooth": lambda r: r.normal(size=2000),
    "outlier": lambda r: np.append(r.random(2000), [1e300, -1e300]),
    "ties": lambda r: np.where(r.random(2000) < 0.4, 0.25, r.integers(0, 50, 2000) / 7),
    "close": lambda r: 1 + r.integers(0, 40, 2000) * 2.0 ** -52,
    "one value": lambda r: np.full(50, 3.5),
}


@pytest.mark.parametrize("name", VALUES)
@pytest.mark.parametrize("small", [False, True])
def test_percentiles_against_numpy(spark, monkeypatch, name, small):
    if small:  # many splits
        monkeypatch.setattr(C, "FINE", 16)
        monkeypatch.setattr(C, "FINAL_ROWS", 20)
    values = VALUES[name](np.random.default_rng(4))
    got = D.rank_percentiles(D.rank_table(table(spark, values), ["config"]), PROBS).first()
    assert [got[p] for p in PROBS] == pytest.approx(list(np.percentile(values, [100 * p for p in PROBS.values()])), rel=1e-13)


@pytest.mark.parametrize("name", ["smooth", "outlier", "ties"])
def test_distances_from_many_ranges(spark, monkeypatch, name):
    monkeypatch.setattr(C, "RANGE_BYTES", 4096)
    monkeypatch.setattr(C, "FINE", 32)
    values = VALUES[name](np.random.default_rng(5))
    ranks = D.rank_table(table(spark, values), ["config"])
    assert C.ranges(ranks)[2] > 1 or name == "ties"  # which make few rows
    rows = sorted(D.ecdf(ranks).collect(), key=lambda r: r["v"])
    o, t = np.sort(values[::3]), np.sort(np.delete(values, np.arange(0, len(values), 3)))
    v = np.unique(values)
    assert [r["v"] for r in rows] == list(v) and [r["next_v"] for r in rows] == [*v[1:], None]
    assert [r["f_obs"] for r in rows] == pytest.approx(list(np.searchsorted(o, v, side="right") / len(o)), abs=1e-15)
    assert [r["f_true"] for r in rows] == pytest.approx(list(np.searchsorted(t, v, side="right") / len(t)), abs=1e-15)


def test_ranges_grow_with_the_rows_and_take_two_shuffles(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE_BYTES", 64 * 48)
    rng = np.random.default_rng(6)
    once, twice = rng.normal(size=4000), rng.normal(size=8000)
    few, many = (C.ranges(D.rank_table(table(spark, x), ["config"]))[2] for x in (once, twice))
    assert many == pytest.approx(2 * few, rel=0.05) and few > 10
    values, _, n = C.ranges(D.rank_table(table(spark, once), ["config"]))
    plan = values._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "rangepartitioning" not in plan
    assert values.rdd.getNumPartitions() == n
    largest = values.groupBy("range").count().agg(F.max("count")).first()[0]
    assert largest <= 2 * C.RANGE_BYTES / 48


def test_nested_depths_equal_separate_populations(spark):
    rng = np.random.default_rng(8)
    rows = [("a", "obs" if rng.random() < 0.3 else "true", float(v), int(c))
            for v, c in zip(rng.integers(0, 300, 3000) / 7 + rng.normal(size=3000).round(1), rng.integers(0, 3, 3000))]
    rows += [("b", "obs", 1.0, 2), ("b", "true", 2.0, 2)]  # only in the deepest
    pop = spark.createDataFrame(rows, "config string, side string, v double, depth_class int")
    depths = (10.0, 20.0, 30.0)
    ranks = D.rank_table(pop, ["config"], depths)
    limits = D.pooled_limits(ranks)
    got = {(r["config"], r["max_depth"]): r for r in D.dist_stats(pop, ["config"], ranks, limits).collect()}
    lim = {(r["config"], r["max_depth"]): r for r in limits.collect()}
    hist = D.histogram(ranks, limits).collect()
    for c, depth in enumerate(depths):
        alone = D.rank_table(pop.where(F.col("depth_class") <= c), ["config"])
        alone_limits = D.pooled_limits(alone)
        for r in D.dist_stats(alone.population, ["config"], alone, alone_limits).collect():
            for name, value in r.asDict().items():
                mine = got[r["config"], depth][name]
                assert mine == (value if isinstance(value, str) or value is None else pytest.approx(value, rel=1e-12)), name
        for r in alone_limits.collect():
            assert (lim[r["config"], depth]["lo"], lim[r["config"], depth]["hi"]) == pytest.approx((r["lo"], r["hi"]), rel=1e-14)
        want = {(r["config"], r["bin"]): (r["n_obs"], r["n_true"]) for r in D.histogram(alone, alone_limits).collect()}
        assert {(r["config"], r["bin"]): (r["n_obs"], r["n_true"]) for r in hist if r["max_depth"] == depth} == want
    assert ("b", 10.0) not in got and got["b", 30.0]["ks"] == 1


def test_records_of_two_depths_replace_earlier_ones(spark, tmp_path):
    cube = Cube(spark, missing=0.0)
    model = load_model(cube.raw)
    arrays = positions_df(spark, hexagon(0.01, 220.0, 0.13) + hexagon(5.0, 225.0, 0.1, "away"))
    both = FieldComparison(model, cube.grid, arrays, max_depth=12, dz=2, depths=(8, 12)).stats_record()
    got = {(r["name"], r["max_depth"]): r for r in both.collect()}
    assert set(got) == {("hex", 8), ("hex", 12), ("away", 8), ("away", 12)}
    for depth in (8, 12):
        alone = FieldComparison(model, cube.grid, arrays, max_depth=depth, dz=2)
        for r in alone.stats_record().collect():
            mine = got[r["name"], depth]
            assert (mine["div_corr"] is None) == (r["div_corr"] is None)
            assert r["div_corr"] is None or mine["div_corr"] == pytest.approx(r["div_corr"], rel=1e-9)
            for part in ("fields", "flux"):
                assert (mine[part] or {}).keys() == (r[part] or {}).keys()
                for name, values in (r[part] or {}).items():
                    for stat, value in values.asDict().items():
                        assert mine[part][name][stat] == (value if value is None else pytest.approx(value, rel=1e-9))
    path = str(tmp_path / "stats")
    write_stats(both, path)
    write_stats(both.where("name = 'hex'").withColumn("tstep", F.lit(9)), path)
    back = spark.read.json(path).collect()
    assert sorted((r["name"], r["max_depth"], r["tstep"]) for r in back) == [
        ("away", 8, 1), ("away", 12, 1), ("hex", 8, 9), ("hex", 12, 9)]
    with pytest.raises(ValueError):
        FieldComparison(model, cube.grid, arrays, max_depth=12, depths=(8, 10))
