import random
import re

import pyarrow as pa
import pytest

from fathomgrid.llm import near_duplicates as nd
from fathomgrid.llm.common import to_arrow
from fathomgrid.llm.components import components
from fathomgrid.llm.queries import NEAR_DUPLICATES_RULE


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, t): (len(sets[i]), least[find(i)]) for i, (d, t) in enumerate(rows)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    out, n = [], 0

    def add(text):
        nonlocal n
        out.append((n, text))
        n += 1

    for _ in range(40):
        add(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80))))
    base = [rng.choice(vocab) for _ in range(90)]
    for _ in range(150):  # a chain-like hot group: copies of random earlier copies
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        add(" ".join(w))
        if rng.random() < 0.2:
            base = w
    for k in (3, 17, 60, 61):
        add(out[k][1].upper())
        add(out[k][1].replace(" ", "\n\t "))
    for t in ("", None, " \n", "one", "ONE", "one two", "İi", "\xa0", "a\x1cb a\x1cb"):
        add(t)
    return out


@pytest.mark.parametrize("words,percent,bands,per", [(3, 85, 40, 6), (5, 80, 40, 5)])
def test_equals_brute_force(spark, rows, words, percent, bands, per):
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, c string, d int").repartition(4)
    got = nd.mark_near_duplicates(docs, nd.Rule(words, percent, bands, per)).collect()
    want = brute(rows, words, percent)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.text): (r._n_shingles, r._component) for r in got} == want


def test_rule_of_the_query(spark, rows):
    rule = NEAR_DUPLICATES_RULE
    assert (1 - (rule.percent / 100) ** rule.rows) ** rule.bands < 1e-8
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), rule).collect()
    assert sorted((r.d, r.n_shingles, r.component_id) for r in got) == sorted(
        (d, *v) for (d, _), v in brute(rows, rule.words, rule.percent).items())


def test_few_centres_leave_links_to_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(nd, "CENTRES", 1)
    monkeypatch.setattr(nd, "MEMBERS", 8)
    monkeypatch.setattr(nd, "OTHERS", 16)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = nd.near_duplicates(docs, nd.Rule(3, 85, 40, 6)).collect()
    want = brute(rows, 3, 85)
    assert sorted((r.d, r.n_shingles, r.component_id) for r in got) == sorted((d, *v) for (d, _), v in want.items())


def test_only_links_leave_a_block(spark, monkeypatch):
    """A large group of texts that all share most shingles, few of them enough: likely pairs by the square, few links."""
    rng = random.Random(4)
    base, rows = [f"b{i}" for i in range(200)], []
    for d in range(300):
        w = list(base)
        for k in range(0, 200, 20):  # two of them have about 75 of 100 shingles in common
            if rng.random() < 0.5:
                w[k + 5] = f"d{d}k{k}"
        rows.append((d, " ".join(w)))
    rows += [(d + 1000, rows[d][1] + " more") for d in range(0, 300, 3)]
    want = brute(rows, 3, 85)
    monkeypatch.setattr(nd, "CENTRES", 1)
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), nd.Rule(3, 85, 40, 6)).collect()
    assert sorted((r.d, r.n_shingles, r.component_id) for r in got) == sorted((d, *v) for (d, _), v in want.items())
    # one bucket of all of them, as members and as others
    rule = nd.Rule(3, 85, 1, 1)
    texts = pa.schema([("c", pa.int64()), ("text", pa.string())])
    sets = [r for batch in nd._sets(rule)([to_arrow(texts, list(zip(*rows)))]) for r in batch.to_pylist()]
    block = [dict(r, band=7, bands=[7], block=0, other=0, side=side, component=r["c"]) for side in (nd.MEMBER, nd.RARE) for r in sets]
    found = [r for batch in nd._hidden(rule, 0.4)(iter([pa.RecordBatch.from_pylist(block)])) for r in batch.to_pylist()]
    assert len(found) == len(rows) - len({c for _, c in want.values()})  # 44,850 pairs are likely
    joined = components(spark.createDataFrame(found, "a bigint, b bigint")).collect()
    assert {d: c for d, c in joined if d != c}.items() == {d: c for (d, _), (_, c) in want.items() if d != c}.items()


def test_small_buckets_hide_no_pair(spark):
    """Families of 3 to 5, one pair above the threshold, all others below it, and one band to meet in."""
    rule = nd.Rule(words=3, percent=85, bands=1, rows=1)
    rows = []
    for f in range(400):
        words = [f"f{f}w{i}" for i in range(202)]
        for k, changes in enumerate((2, 3, 4, 4, 4)[:3 + f % 3]):
            w = list(words)
            for i in range(changes):
                w[10 + 38 * k + 6 * i] = f"f{f}k{k}i{i}"
            rows.append((8 * f + k, " ".join(w)))
    keys = {c: c_bands for batch in nd._sets(rule)([to_arrow(pa.schema([("c", pa.int64()), ("text", pa.string())]), list(zip(*rows)))])
            for c, c_bands in zip(batch.column("c").to_pylist(), batch.column("bands").to_pylist())}
    meet = {8 * f for f in range(400) if keys[8 * f] == keys[8 * f + 1]}
    assert len(meet) > 300
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), rule).collect()
    assert {r.d: r.component_id for r in got} == {d: d - 1 if d % 8 == 1 and d - 1 in meet else d for d, _ in rows}


def test_empty_null_ids_and_repeated_rows(spark):
    schema = "doc_id bigint, text string"
    assert nd.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "x")], schema)
    got = nd.mark_near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r._component) for r in got) == [(0, -2**63), (5, -2**63), (5, -2**63), (7, 7)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(40, 50), (50, 41), (41, 41), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 41: 40, 50: 40}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
