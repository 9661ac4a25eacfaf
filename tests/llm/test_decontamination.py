import random
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest

from fathomgrid.llm import decontamination as dc


@pytest.fixture(scope="module")
def world():
    rng = random.Random(8)
    common = [f"c{i}" for i in range(30)]
    rare = [f"r{i}" for i in range(3000)]
    say = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(6, 60)))) for i in range(80)] + [(80, " ".join(say(150))), (81, "One."), (82, None)]
    docs = []
    for i in range(120):
        w = say(rng.randint(0, 400))
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w = w[:at] + items[rng.randrange(81)][1].upper().split() + w[at:]
        docs.append((i, " ".join(w)))
    return items, docs + [(200, ""), (201, None), (202, items[5][1]), (203, " ".join(items[7][1].split()[:3]))]


def exact(items, text):
    """Items whose whole text stands in the text, word for word."""
    have = " " + " ".join(dc.words_of(text or "")) + " "
    return {i for i, t in items if t and len(dc.words_of(t)) >= dc.LEAST_WORDS and f" {' '.join(dc.words_of(t))} " in have}


def test_retrieval_equals_all_scores(world):
    items, docs = world
    index = next(iter([dc.Index([(i, dc.words_of(t)[:9], dc.words_of(t)[9:]) for i, t in items if t])]))
    rng = random.Random(1)
    for _ in range(300):
        terms = sorted(rng.sample(range(1, len(index.postings)), 40)) if rng.random() < 0.3 else sorted(
            set(index.vocabulary[w] for w in rng.choice(index.items)[1] + ["c1", "c2", "c3"]))
        lo = rng.randrange(0, len(index.items), index.group)
        hi = min(lo + index.group, len(index.items))
        want = []
        for d in range(lo, hi):
            s = sum(dict(zip(index.postings[t][0], index.postings[t][1])).get(d, 0) for t in terms)
            if s >= 0.3:
                want.append((d, round(s, 9)))
        assert [(d, round(s, 9)) for d, s in index.retrieve(terms, lo, hi, 0.3)] == want


@pytest.mark.parametrize("size", [dc.INDEX_BYTES, 4000])
def test_every_whole_item_is_found(spark, world, size):
    items, docs = world
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int").repartition(4)
    got = {}
    for r in dc.find_leaks(frame, bench, index_bytes=size).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = r
    for d, text in docs:
        want = exact(items, text)
        assert want <= set(got.get(d, {})), (d, want)
        for i in set(got.get(d, {})) - want:  # nothing without enough overlap
            assert min(got[d][i].question_overlap, got[d][i].answer_overlap) >= dc.OVERLAP
    clean = [d for d, text in docs if not exact(items, text)]
    assert sum(d in got for d in clean) <= 0.05 * len(clean)


def test_results_do_not_depend_on_blocks(spark, world):
    items, docs = world
    bench = spark.createDataFrame([*items, (83, "谁写了红楼梦这部小说 曹雪芹写了这部小说"), (84, "who wrote hamlet")], "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    one, many = ([tuple(r) for r in dc.find_leaks(frame, bench, index_bytes=n).collect()] for n in (dc.INDEX_BYTES, 5000))
    key = lambda r: (r[0], r[2])
    assert len(one) > 30
    for a, b in zip(sorted(one, key=key), sorted(many, key=key), strict=True):
        assert key(a) == key(b) and abs(a[3] - b[3]) < 1e-5 and a[5:] == b[5:]
    left = [sorted(r.doc_id for r in dc.drop_leaked(frame, bench, index_bytes=n).collect()) for n in (dc.INDEX_BYTES, 5000)]
    assert left[0] == left[1] == sorted({d for d, _ in docs} - {r[0] for r in one})


def test_short_and_unspaced_items(spark):
    chinese = "谁写了红楼梦这部小说？曹雪芹写了这部小说。"
    bench = spark.createDataFrame([(1, chinese), (2, "Who wrote Hamlet?"), (3, "Yes."), (4, "?!")], "item_id bigint, text string")
    docs = [(1, chinese), (2, "前言。" + chinese + "后记。"), (3, "who wrote hamlet"), (4, "Quiz\n\nWho wrote Hamlet?\nNobody"), (5, "yes"),
            (6, "He asked who wrote hamlet and yes she knew."), (7, "别的一句话没有关系"), (8, "?!"), (9, None)]
    got = dc.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.word) for r in got) == [(1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 2, 1), (5, 3, 0)]


def test_empty_tables(spark):
    bench, docs = "item_id bigint, text string", "doc_id bigint, text string"
    none = spark.createDataFrame([], bench)
    assert dc.find_leaks(spark.createDataFrame([(1, "a")], docs), none).count() == 0
    one = spark.createDataFrame([(1, "a b c d")], bench)
    assert dc.find_leaks(spark.createDataFrame([], docs), one).count() == 0
    assert dc.find_leaks(spark.createDataFrame([(None, "a b c d")], docs), one).count() == 1


ODD = "aZ09_ßÉéÿİıKΣσςЯя谁ก가½²𐐀ªµ́​ \x85\x1c \t\n.,'’-¿()"


def test_numbers_are_those_of_words_read_one_by_one():
    rng = random.Random(3)
    index = dc.Index([(1, dc.words_of("οδοσ οδος i é ß z0 谁 a9 σ я"), ["k"])])
    texts = ["", " ", ".", "İ", "ΟΔΟΣ οδοσ. 'ΟΔΟΣ'", *("".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(3000))]
    ids, ends = index.numbers(pa.array(texts))
    want = [[index.vocabulary[w] for w in dc.words_of(t)] for t in texts]
    assert ids.tolist() == [i for w in want for i in w]
    assert ends.tolist() == list(accumulate(map(len, want)))


def test_passages_hold_every_item_above_the_threshold(world):
    items, docs = world
    index = dc.Index([(i, dc.words_of(t)[:9], dc.words_of(t)[9:]) for i, t in items if t])
    ids, ends = index.numbers(pa.array([t or "" for _, t in docs]))
    kept, n = set(index.passages(ids, ends, dc.THRESHOLD)), 0
    for row, words in enumerate(i.tolist() for i in np.split(ids, ends[:-1])):
        for at in range(max(1, -(-len(words) // dc.STEP) - dc.PASSAGE + 1) if words else 0):
            terms = sorted(set(words[at * dc.STEP:(at + dc.PASSAGE) * dc.STEP]) - {0})
            for group in range(index.most.shape[1]):
                lo = group * index.group
                if index.retrieve(terms, lo, min(lo + index.group, len(index.items)), dc.THRESHOLD):
                    assert (row, at, group) in kept
                    n += 1
    assert n > 40 and len(kept) < 3 * n


def test_texts_searched_together_do_not_mix(world):
    items, docs = world
    index = dc.Index([(i, dc.words_of(t)[:9], dc.words_of(t)[9:]) for i, t in items if t])
    halves = [" ".join(w) for _, t in items if t for w in (t.split()[:len(t.split()) // 2], t.split()[len(t.split()) // 2:])]
    texts = [*(t for _, t in docs), *halves]
    one = {i: found for i, t in enumerate(texts) if (found := index.leaks(t or ""))}
    assert len(one) > 30 and dict(index.leaks_in(pa.array(texts))) == one


def test_words_are_read_where_an_item_is_retrieved(world, monkeypatch):
    items, _ = world
    index = dc.Index([(i, dc.words_of(t)[:9], dc.words_of(t)[9:]) for i, t in items if t and i < 81])
    read, words_of = [], dc.words_of
    monkeypatch.setattr(dc, "words_of", lambda text: read.append(text) or words_of(text))
    clean = "Mañana, c1 c2 (c3) r1 c4; nothing.\nElse c5 here!"
    assert not index.leaks(clean) and not read
    assert index.leaks(items[5][1]) and read == [items[5][1]]


def test_plan_of_one_index(spark, world):
    items, docs = world
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    plan = dc.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench)._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") and "Union" not in plan and "Exchange" not in plan
