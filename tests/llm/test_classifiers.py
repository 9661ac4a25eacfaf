import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import labels, quality, toxicity

SMALL = "/root/testdata/sf0.01"


def brute_segments(scores):
    """Maximal segments by definition: take the best segment, drop its neighbourhood, repeat on both sides."""
    scores = list(scores)

    def solve(lo, hi):
        best = None
        for a in range(lo, hi):
            s = 0.0
            for b in range(a, hi):
                s += scores[b]
                key = (round(s, 9), -(b - a))
                if s > 1e-12 and (best is None or key > best[0]):
                    best = (key, a, b + 1)
        if best is None:
            return []
        _, a, b = best
        return solve(lo, a) + [(a, b, round(sum(scores[a:b]), 6))] + solve(b, hi)

    return solve(0, len(scores))


def test_segments_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        s = np.array([rng.choice([-2.37, -1.11, -0.31, 0.53, 1.29, 3.7]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 25))])
        assert [(a, b, round(x, 6)) for a, b, x in toxicity.maximal_segments(s)] == brute_segments(s)


def test_quality_features_in_several_scripts():
    at = {n: i for i, n in enumerate(quality.FEATURES)}
    latin, russian, greek, chinese = map(quality.features, (
        "The cat sat there. It saw a dog.", "Кот сидел там. Он видел пса.", "Η γάτα ήταν εκεί. Είδε σκύλο.", "猫坐在那里。它看见一只狗。"))
    marks = quality.features("??? ????? ???. ?? ????? ???.")
    for f in (latin, russian, greek):
        assert f[at["upper"]] > 0.05 and f[at["lower"]] > 0.5 and f[at["other"]] == 0
        assert f[at["sentence"]] < marks[at["words"]]
    assert chinese[at["lower"]] > 0.8 and marks[at["lower"]] == 0
    assert abs(chinese[at["stop"]] + chinese[at["mark"]] - 2 / 13) < 1e-9
    # typeset quotes change nothing else: the same counts by both ways
    plain = "Some words, and A number 12 here: it's fine."
    a, b = quality._counts(plain), quality._counts(plain + "\u4e00")
    assert (b[0] - a[0]).tolist() == [0, 1, 0, 0, 0, 0, 0] and a[2:] == b[2:] and sorted(b[1]) == sorted([*a[1], 1])


def test_quality_score_equals_looked_up_numbers():
    """Against a plain loop over bins and pairs."""
    rng = np.random.default_rng(3)
    edges = [np.sort(rng.normal(size=5)) for _ in range(4)]
    model = quality.AdditiveModel(0.3, edges, rng.normal(size=(4, 6)), [np.array([0, 0, 1, 1, 2, 2])] * 4,
                                  [(0, 2, rng.normal(size=(3, 3))), (1, 3, rng.normal(size=(3, 3)))])
    x = rng.normal(size=(50, 4))
    x[0] = [e[2] for e in edges]     # on an edge: the upper bin
    for row, got in zip(x, model.probability(x)):
        bins = [sum(v >= e for e in edges[f]) for f, v in enumerate(row)]
        raw = 0.3 + sum(model.tables[f][b] for f, b in enumerate(bins))
        raw += sum(t[bins[f] // 2][bins[g] // 2] for f, g, t in model.pairs)
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-12


def area_under_curve(score, label):
    order = np.argsort(np.argsort(score))
    n1, n0 = label.sum(), (1 - label).sum()
    return (order[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("what", ["toxic", "quality"])
def test_held_out_accuracy(spark, what):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = spark.read.parquet(f"{SMALL}/labels.parquet")
    module = toxicity if what == "toxic" else quality
    if what == "toxic":
        out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, truth)).select("doc_id", "score")
    else:
        out = quality.score_quality(docs, quality.fit_quality(docs, truth))
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(module.MODULUS))
    held = out.join(truth, "doc_id").where(fold == module.HELD_OUT).toPandas()
    auc = area_under_curve(held.score.to_numpy(), held[what].to_numpy())
    assert auc > 0.85, auc


def test_sample_leaves_out_the_held_out_fold_and_bounds_rows(spark):
    truth = spark.createDataFrame([(i, i % 2) for i in range(5000)] + [(None, 1), (7, 1), (9, None)], "doc_id bigint, toxic int")
    rows = labels.labelled_sample(truth, "toxic", 5, 0, max_rows=1000).collect()
    import zlib

    assert 500 < len(rows) <= 1000 and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.fold == zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in rows if r.doc_id is not None)


def test_without_labels_scores_are_constant(spark):
    docs = spark.createDataFrame([(1, "some text", 3), (2, None, 4), (None, "", 5)], "doc_id bigint, text string, score int")
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    a = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect()
    b = quality.score_quality(docs, quality.fit_quality(docs, none)).collect()
    assert len(a) == len(b) == 3 and {round(r.score, 6) for r in b} == {0.5}
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, none)).count() == 0
    assert quality.score_quality(empty, quality.fit_quality(empty, none)).count() == 0


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_additive(x, y)
    assert any({f, g} == {0, 1} for f, g, _ in model.pairs)
    assert ((model.probability(x) > 0.5) == (y == 1)).mean() > 0.9
    assert len(quality.features("Ein Text.\nZwei!")) == len(quality.FEATURES)
    assert np.isfinite(quality.features("\n\n")).all() and quality.features("") == (0.0,) * len(quality.FEATURES)
