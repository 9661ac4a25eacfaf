import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import vector_search


def brute(rows, k, scale=1024):
    used = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in used:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in used if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=10, **kw):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, score string, number int")
    found = vector_search.top_k(table.repartition(4), F.pmod(F.col("id"), F.lit(100)) == 0, k, **kw)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("lanes", [None, 3])
def test_equals_brute_force(spark, monkeypatch, lanes):
    rng = np.random.default_rng(1)
    same = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, same if i % 3 == 0 else rng.normal(size=4).round(rng.integers(0, 3)).tolist()) for i in range(1500)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0]), (2002, [float("nan")] * 4), (2100, [float("inf"), 1.0, 1.0, 1.0]), (2003, []),
             (2200, []), (2300, [1.0]), (2004, [1.0] * 9), (None, same), (-100, same), (-7, [-x for x in same]), (2400, [0.0] * 4)]
    random.Random(1).shuffle(rows)
    monkeypatch.setattr(vector_search, "CANDIDATES", 100)
    monkeypatch.setattr(vector_search, "QUERIES", 7)
    if lanes:
        monkeypatch.setattr(vector_search, "BROADCAST_BYTES", 0)
    assert run(spark, rows, lanes=lanes) == brute(rows, 10)


def test_many_rounds_of_few_bins(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BINS", 64)
    monkeypatch.setattr(vector_search, "FEW", 0)  # down to bins of one integer
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 4, 3) * 30).tolist()) for i in range(800)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    assert run(spark, rows, k=25) == brute(rows, 25)


def test_few_candidates_and_large_components(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [3.0, -4.0]), (5, [0.1, 0.1])]) == brute([(0, [1.0, 2.0]), (1, [3.0, -4.0]), (5, [0.1, 0.1])], 10)
    assert run(spark, [(100, [1.0])]) == []
    assert run(spark, []) == []
    big = [(0, [2.0 ** 19, 1.0]), (1, [2.0 ** 18 + 1, 3.0]), (2, [2.0 ** 18 + 1, 2.0]), (100, [-2.0 ** 20, 7.0])]
    assert run(spark, big) == brute(big, 10)


def test_repeated_rows(spark):
    rows = [(0, [1.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [5.0, 0.0])]
    assert run(spark, rows) == brute(rows, 10)
    twice = run(spark, [(0, [1.0]), (0, [1.0]), (3, [2.0])])
    assert twice == [(0, 1, 3, 2 * 1024 * 1024)] * 2


def test_blocks_of_copies_keep_their_own_ids(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATES", 4)
    rows = [(i, [1.0, 0.5] if i > 40 else [0.25, -1.0]) for i in range(101)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
    found = vector_search.top_k(table, F.pmod(F.col("id"), F.lit(100)) == 0, 50)
    assert sorted(map(tuple, found.collect())) == brute(rows, 50)


def test_scores_above_an_interval_count_once(spark, monkeypatch):
    # bins of whole width reach above the interval of a second round, where other scores lie
    monkeypatch.setattr(vector_search, "FEW", 1)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, int(rng.integers(1, 4)) / 1024]) for i in range(0, 2000, 100)]
    rows += [(i, [0.5, int(rng.integers(0, 4000)) / 1024]) for i in range(2001, 2700) if i % 100]
    for k in (40, 200):
        assert run(spark, rows, k=k) == brute(rows, k)


def test_scores_near_64_bits(spark):
    rows = [(0, [2.0 ** 21, 2.0 ** 20]), (100, [-2.0 ** 20, 5.0])] + [(i, [2.0 ** 20 - i, -float(i)]) for i in range(1, 60)]
    assert run(spark, rows, scale=2.0 ** 10.5) == brute(rows, 10, 2.0 ** 10.5)
