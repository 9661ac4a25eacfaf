import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import fathomgrid.durable as durable_module
from fathomgrid.operators import eddies as E


@pytest.fixture(scope="module")
def region(spark):
    rng = np.random.default_rng(4)
    a = {v: rng.normal(size=(9, 5, 4)) for v in "WTSUV"}
    a["T"] += 25
    for x in a.values():
        x[rng.random(x.shape) < 0.05] = np.nan
    rows = [("c", p // 3, p % 3, t, k, *(None if np.isnan(a[v][t, p, k]) else float(a[v][t, p, k]) for v in "WTSUV"))
            for t in range(9) for p in range(5) for k in range(4)]
    df = spark.createDataFrame(rows, "config string, iy int, ix int, time int, k int, W double, T double, S double, U double, V double")
    return a, df


def anomaly(x, axis=0):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return x - np.nanmean(x, axis=axis, keepdims=True)


def test_anomalies(spark, region, monkeypatch):
    a, df = region
    for limit in (1_000_000, 0):  # broadcast means, then salted join
        monkeypatch.setattr(durable_module, "BROADCAST_ROWS", limit)
        got = E.eddy_anomalies(df, ["config", "iy", "ix", "k"]).collect()
        assert len(got) == 180
        for r in got:
            p = r["iy"] * 3 + r["ix"]
            for v in "UVTS":
                want = anomaly(a[v])[r["time"], p, r["k"]]
                assert (r[f"{v}p"] is None and np.isnan(want)) or r[f"{v}p"] == pytest.approx(want, abs=1e-12)


def test_fluxes_use_each_series_own_mean(spark, region):
    a, df = region
    got = {(r["iy"] * 3 + r["ix"], r["k"]): r for r in E.vertical_eddy_flux(df, ["config", "iy", "ix", "k"]).collect()}
    flux = {v: np.nanmean(anomaly(a["W"]) * anomaly(a[v]), axis=0) for v in "TSUV"}
    for (p, k), r in got.items():
        for v in "TSUV":
            assert r[f"w{v}"] == pytest.approx(flux[v][p, k], rel=1e-9)
    mean = {r["k"]: r for r in E.model_vertical_flux(df).collect()}
    for k in range(4):
        for v in "TSUV":
            assert mean[k][f"w{v}"] == pytest.approx(np.nanmean(flux[v][:, k]), rel=1e-9)


def test_array_flux(spark, region):
    a, df = region
    samples = df.withColumn("glider", F.col("iy") * 3 + F.col("ix")).drop("W", "iy", "ix")
    rng = np.random.default_rng(5)
    w = rng.normal(size=(9, 5))
    w[2, 3] = np.nan
    w_est = spark.createDataFrame([("c", t, k, None if np.isnan(w[t, k]) else float(w[t, k])) for t in range(9) for k in range(5)],
                                  "config string, time int, k int, w_est double")
    got = {r["k"]: r for r in E.array_vertical_flux(w_est, samples).collect()}
    mid = (w[:, :-1] + w[:, 1:]) / 2
    for k in range(4):
        for v in "TSUV":
            want = np.nanmean(anomaly(mid)[:, k] * anomaly(np.nanmean(a[v], axis=1))[:, k])
            assert got[k][f"w{v}"] == pytest.approx(want, rel=1e-9)


def test_integrals_and_recovered_fraction(spark):
    def profile(**cols):
        n = len(next(iter(cols.values())))
        return spark.createDataFrame(
            [("c", k, *(None if c[k] is None else float(c[k]) for c in cols.values())) for k in range(n)],
            "config string, k int, " + ", ".join(f"{c} double" for c in cols))
    model = profile(wT=[1, 2, 4], wS=[0, 0, 0], wU=[1, None, 1])
    array = profile(wT=[2, 2, 2], wS=[1, 1, 1], wU=[1, 1, 1])
    got = {r["flux"]: r for r in E.flux_integrals(array, model, 2.0, 3).collect()}
    z = np.array([-1.0, -3.0, -5.0])
    assert got["wT"]["total_integral"] == pytest.approx(np.trapezoid([1, 2, 4], z))
    assert got["wT"]["recovered_frac"] == pytest.approx(-8 / np.trapezoid([1, 2, 4], z))
    assert got["wS"]["total_integral"] == 0 and got["wS"]["recovered_frac"] is None
    assert got["wU"]["total_integral"] is None and got["wU"]["glider_integral"] == -4
    short = {r["flux"]: r for r in E.flux_integrals(array, model.filter("k < 2"), 2.0, 3).collect()}
    assert short["wT"]["total_integral"] is None and short["wT"]["glider_integral"] == -8
    stats = {r["flux"]: r for r in E.flux_profile_stats(array, model, model, 2.0).collect()}
    assert stats["wT"]["array_dmean"] == 2 and stats["wT"]["total_dmean"] == pytest.approx(7 / 3)
