import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.functions.columns import histogram_bin, sigma0
from fathomgrid.operators import distributions as D
from fathomgrid.operators.summaries import abs_limit


def population(spark, sides):
    """sides: {(config, field): (obs, true)}"""
    rows = [(c, f, s, None if v is None else float(v)) for (c, f), pair in sides.items()
            for s, vs in zip(("obs", "true"), pair) for v in vs]
    return spark.createDataFrame(rows, "config string, field string, side string, v double")


def js_1d(o, t, edges):
    p, q = (np.histogram(x, edges)[0].astype(float) for x in (o, t))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt(np.nansum(p * np.log2(p / m)) / 2 + np.nansum(q * np.log2(q / m)) / 2)


def quantile(sorted_values, p):
    """Order statistic at a fractional place, by hand."""
    place = p * (len(sorted_values) - 1)
    below = int(place)
    above = min(below + 1, len(sorted_values) - 1)
    return sorted_values[below] + (place - below) * (sorted_values[above] - sorted_values[below])


def bin_borders(*samples):
    """61 borders from the pooled 0.5th to the 99.5th percentile."""
    pool = sorted(float(v) for sample in samples for v in sample)
    low, high = quantile(pool, 0.005), quantile(pool, 0.995)
    step = (high - low) / 60
    return np.array([low + i * step for i in range(60)] + [high])


def distances(o, t):
    v = np.unique(np.concatenate([o, t]))
    fo = np.searchsorted(np.sort(o), v, side="right") / len(o)
    ft = np.searchsorted(np.sort(t), v, side="right") / len(t)
    gap = np.abs(fo - ft)
    return gap.max(), np.sum(gap[:-1] * np.diff(v))


def skew(x):
    d = x - x.mean()
    return (d ** 3).mean() / (d ** 2).mean() ** 1.5


CASES = {
    ("a", "smooth"): (lambda r: r.normal(size=400), lambda r: r.normal(0.3, 1.2, size=1500)),
    ("a", "tied"): (lambda r: r.integers(0, 11, 300) / 100, lambda r: r.integers(0, 11, 700) / 100),
    ("b", "hot"): (lambda r: np.where(r.random(3000) < 0.5, 7.0, r.normal(size=3000)), lambda r: r.normal(size=50)),
    ("b", "tails"): (lambda r: r.standard_cauchy(500), lambda r: r.standard_cauchy(500) * 2),
}


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(7)
    return {k: (a(rng), b(rng)) for k, (a, b) in CASES.items()}


def test_every_statistic_against_numpy(spark, drawn):
    got = {(r["config"], r["field"]): r for r in D.dist_stats(population(spark, drawn)).collect()}
    assert got.keys() == drawn.keys()
    for key, (o, t) in drawn.items():
        r = got[key]
        ks, w1 = distances(o, t)
        borders = bin_borders(o, t)
        assert r["ks"] == pytest.approx(ks, abs=1e-15)
        assert r["wasserstein"] == pytest.approx(w1, rel=1e-12)
        assert r["js"] == pytest.approx(js_1d(o, t, borders), rel=1e-9)
        for s, x in (("obs", o), ("true", t)):
            assert r[f"{s}_mean"] == pytest.approx(x.mean(), rel=1e-10)
            assert r[f"{s}_std"] == pytest.approx(x.std(), rel=1e-10)
            assert r[f"{s}_skew"] == pytest.approx(skew(x), rel=1e-6)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_results_do_not_depend_on_the_number_of_ranges(spark, drawn, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        ranks = D.rank_table(population(spark, drawn), ["config", "field"])
        d = {(r["config"], r["field"]): r for r in D.ecdf_distances(ranks).collect()}
        p = {(r["config"], r["field"]): r for r in D.rank_percentiles(
            ranks, {"lo": 0.005, "mid": 0.5, "hi": 0.995, "min": 0.0, "max": 1.0}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for key, (o, t) in drawn.items():
        ks, w1 = distances(o, t)
        assert d[key]["ks"] == pytest.approx(ks, abs=1e-15)
        assert d[key]["wasserstein"] == pytest.approx(w1, rel=1e-12)
        want = np.percentile(np.concatenate([o, t]), [0.5, 50, 99.5, 0, 100])
        assert [p[key][c] for c in ("lo", "mid", "hi", "min", "max")] == pytest.approx(list(want), rel=1e-13)


def test_histograms_against_numpy(spark, drawn):
    keys = ["config", "field"]
    ranks = D.rank_table(population(spark, drawn), keys)
    limits = D.pooled_limits(ranks)
    rows = D.histogram_density(D.histogram(ranks, limits), limits, keys).orderBy("bin").collect()
    assert len(rows) == 60 * len(drawn)
    for key, (o, t) in drawn.items():
        mine = [r for r in rows if (r["config"], r["field"]) == key]
        borders = bin_borders(o, t)
        for s, x in (("obs", o), ("true", t)):
            assert [r[f"n_{s}"] for r in mine] == list(np.histogram(x, borders)[0])
            assert np.allclose([r[f"density_{s}"] for r in mine], np.histogram(x, borders, density=True)[0], rtol=1e-9)


def test_bins_on_their_edges(spark):
    values = [i / 100 for i in range(-1, 12)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(histogram_bin(F.col("v"), F.lit(0.0), F.lit(0.1), 60)).collect()]
    edges = np.linspace(0.0, 0.1, 61)
    want = [None if v < 0 or v > 0.1 else min(int(np.searchsorted(edges, v, side="right")) - 1, 59) for v in values]
    assert got == want


def test_one_sided_and_constant_populations(spark):
    pop = population(spark, {("a", "empty"): ([], [1, 2, 3]), ("a", "flat"): ([5, 5], [5, 5, 5]), ("a", "one"): ([1], [2])})
    got = {r["field"]: r for r in D.dist_stats(pop).collect()}
    assert got["empty"]["ks"] is None and got["empty"]["wasserstein"] is None and got["empty"]["js"] is None
    assert got["flat"]["ks"] == 0 and got["flat"]["wasserstein"] == 0 and got["flat"]["js"] == 0
    # both values lie outside the inner 99 %, so no bin holds anything
    assert got["one"]["ks"] == 1 and got["one"]["wasserstein"] == 1 and got["one"]["js"] is None


def test_only_finite_values_count(spark):
    wide = spark.createDataFrame(
        [("a", "obs", 1.0, 2.0), ("a", "obs", None, 2.0), ("a", "true", float("nan"), 3.0),
         ("a", "true", float("inf"), 4.0), ("a", "true", 5.0, None)],
        "config string, side string, U double, V double")
    assert D.field_population(wide, ["U", "V"]).count() == 6
    pairs = D.pair_population(wide, [("uv", "U", "V")])
    assert [(r["x"], r["y"]) for r in pairs.collect()] == [(1.0, 2.0)]


def test_joint_distributions_against_numpy(spark):
    rng = np.random.default_rng(11)
    o, t = rng.normal(size=(800, 2)), rng.normal(size=(3000, 2)) @ np.array([[1, 0.5], [0, 1]])
    o[:, 1] = np.round(o[:, 1], 1)
    rows = [("a", s, float(x), float(y)) for s, xy in (("obs", o), ("true", t)) for x, y in xy]
    wide = spark.createDataFrame(rows, "config string, side string, U double, V double")
    pairs = D.pair_population(wide, [("uv", "U", "V")])
    r = D.joint_compare(pairs).first()
    borders = [bin_borders(o[:, i], t[:, i]) for i in (0, 1)]
    ho, ht = (np.histogramdd(x, bins=borders)[0] for x in (o, t))
    hist = {(h["bin_x"], h["bin_y"]): (h["n_obs"], h["n_true"]) for h in D.joint_histogram(pairs, D.joint_limits(pairs)).collect()}
    assert {k: v for k, v in hist.items()} == {
        (i, j): (ho[i, j], ht[i, j]) for i, j in zip(*np.nonzero(ho + ht))}
    p, q = ho / ho.sum(), ht / ht.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        js = np.sqrt((np.nansum(p * np.log2(p / m)) + np.nansum(q * np.log2(q / m))) / 2)
    assert r["js"] == pytest.approx(js, rel=1e-9)
    for s, x in (("obs", o), ("true", t)):
        assert r[f"cov_{s}"] == pytest.approx(np.cov(x.T)[0, 1], rel=1e-9)
        assert r[f"corr_{s}"] == pytest.approx(np.corrcoef(x.T)[0, 1], rel=1e-9)


def test_thinning_is_a_repeatable_share(spark):
    rows = spark.range(20000).selectExpr("id", "if(id % 10 < 9, 'hot', 'cold') as k")
    identity = F.expr("id * 7919 % 20011 / 20011D")
    one = {r["id"] for r in D.thin(rows, identity, 0.1).collect()}
    assert one == {i for i in range(20000) if i * 7919 % 20011 / 20011 < 0.1}
    assert D.thin(rows.repartition(7), identity, 1.0).count() == 20000 and D.thin(rows, identity, 0).count() == 0


def test_absolute_limit(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=999)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None), ("a", float("nan"))], "k string, v double")
    assert abs_limit(df, ["k"]).first()["bound"] == pytest.approx(np.percentile(np.abs(x), 98), rel=1e-13)


def test_density_check_values(spark):
    df = spark.createDataFrame([(0.0, 5.0), (35.0, 5.0), (35.0, 25.0), (-1.0, 5.0), (None, 5.0)], "s double, t double")
    got = [r[0] for r in df.select(sigma0(F.col("s"), F.col("t"))).collect()]
    assert [round(v + 1000, 5) for v in got[:3]] == [999.96675, 1027.67547, 1023.34306]
    assert got[3:] == [None, None]
