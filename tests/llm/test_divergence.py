import random
import re
from collections import Counter, defaultdict

import numpy as np

from fathomgrid.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        found = TERM.findall((text or "").translate(LOWER))
        counts[key].update(found)
        docs[key[0]].update(set(found))
    kept = {lang: [w for w, n in docs[lang].items() if n >= 3] for lang, _ in groups}
    size = {g: sum(counts[g][w] for w in kept[g[0]]) for g in groups}
    out = []

    def part(g, name, values, limit=None):
        order = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:limit]
        out.extend((*g, name, item, value, i + 1) for i, (item, value) in enumerate(order))

    for g in groups:
        terms = kept[g[0]]
        share = lambda n, total: 1 + 10 ** 9 * (n + 1) // (total + len(terms))
        f = lambda p, q: (p - q) ** 2 // q
        part(g, "pair", [(h[1], sum(f(share(counts[g][w], size[g]), share(counts[h][w], size[h])) for w in terms))
                         for h in groups if h[0] == g[0] and h != g])
        all_of = {w: sum(counts[h][w] for h in groups if h[0] == g[0]) for w in terms}
        total = sum(all_of.values())
        got = [(w, share(counts[g][w], size[g]), share(all_of[w], total)) for w in terms if counts[g][w]]
        part(g, "term", [(w, f(p, q)) for w, p, q in got if p > q], top)
    return sorted(out)


def run(docs, **kw):
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, divergence.source_divergence(docs, **kw).select(cols).toPandas().to_numpy().tolist()))


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["été", "Word", "the", "1x2y", "ß", "na_ïve", "中文", "I", "İ"] + [f"w{c}{d}" for c in "abcdefgh" for d in "ijklm"]
    rows = []
    for i in range(600):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "é", None, "z"])
        source = "a" if i % 3 == 0 else source  # a hot group
        rows.append((" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 40]))), lang, source))
    rows += [(None, "en", "empty"), ("", "xx", "a"), (None, "xx", "b"), ("rare one", "yy", "c"), ("rare", "yy", "d")]
    rows += [("the " * 200_000, "en", "long")] + [("the same", "en", "b")] * 7
    docs = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)],
                                 "text string, lang string, source string, n bigint, term int").repartition(7)
    want = brute(rows)
    assert run(docs) == want
    monkeypatch.setattr(divergence, "POSTINGS", 37)  # many small parts of the index
    monkeypatch.setattr(divergence, "GATHER", 5)
    assert run(docs) == want
    monkeypatch.setattr("fathomgrid.durable.BROADCAST_ROWS", 1)  # no broadcast at all
    assert run(docs) == want


def test_top_terms_and_empty_table(spark):
    rows = [(w * 2, "en", s) for w in ("alpha ", "beta ", "gamma ") for s in ("a", "b", "b", "c")] + [("alpha", "en", "a")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert run(docs, top=1) == brute(rows, 1)
    assert run(docs.limit(0)) == []


def test_walk_leaves_no_pair_of_one_group_with_itself():
    term, group = np.array([1, 1, 2, 2, 2]), np.array([7, 9, 7, 8, 9])
    p, zero = np.array([50, 20, 9, 9, 30]), np.array([3, 4, 3, 5, 4])
    got = {(g, t): v for g, to, values in divergence.walk(term, group, p, zero) for t, v in zip(to, values)}
    f = divergence._gap
    want = sum(f(a, b) - f(a, 4) - f(3, b) + f(3, 4) for a, b in ((50, 20), (9, 30)))
    assert got[7, 9] == want and (7, 7) not in got


def test_shares_stay_exact_for_large_counts(spark):
    rows = [(0, 7), (5 * 10 ** 9, 6 * 10 ** 9), (2 ** 40, 2 ** 41 + 13), (2 ** 55, 2 ** 56 - 1)]
    got = spark.createDataFrame(rows, "n bigint, t bigint").select(divergence.share(*map(__import__("pyspark").sql.functions.col, "nt"))).collect()
    assert [r[0] for r in got] == [1 + 10 ** 9 * (n + 1) // t for n, t in rows]
