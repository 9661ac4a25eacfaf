import hashlib
import random

import pytest

from fathomgrid.llm import suffixes
from fathomgrid.llm.substrings import CHUNK


def brute(rows, size=100):
    """Digest of every row by remembering each string of `size` bytes."""
    seen, result = {}, {}
    for key in sorted({(r[0] if r[0] is not None else -2**63, r[1] or "") for r in rows}):
        data = key[1].encode()
        gone = bytearray(len(data))
        for p in range(len(data) - size + 1):
            w = data[p:p + size]
            if w in seen:
                gone[p:p + size] = b"\1" * size
            else:
                seen[w] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        result[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return result


def words(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    passages = [words(rng, 40, vocab) for _ in range(6)]
    out = []
    for i in range(60):
        text = " ".join([words(rng, rng.randint(0, 120), vocab), rng.choice(passages), words(rng, rng.randint(0, 60), vocab)])
        out.append((i, text))
    base = out[7][1].split()
    for i in range(60, 90):  # near copies
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append((i, " ".join(w)))
    out += [(90, out[3][1]), (91, "ab" * 400), (92, "ab" * 60 + "x" + "ab" * 60), (93, ""), (94, None), (95, "z" * 99),
            (96, "z" * 100), (97, "z" * 101), (98, "é" * 50), (99, "é" * 51), (100, out[3][1]), (100, out[3][1]),
            (None, out[9][1]), (101, out[9][1] + "\0tail")]
    return out


def check(spark, rows, brute_rows=None):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id bigint, text string, h string, spans int, d int").repartition(5)
    got = suffixes.digest(docs).collect()
    want = brute(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1] or "")
    assert len(got) == len(rows)
    for r in got:
        fits = [want[(r.doc_id if r.doc_id is not None else -2**63, t)] for t in texts[r.doc_id]]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in fits, r


def test_equals_brute_force(spark, rows):
    check(spark, rows)


def test_hot_half_runs_by_aggregation(spark, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "TOGETHER", 2)
    check(spark, rows)


def test_small_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr("fathomgrid.llm.substrings.CHUNK", 256)
    check(spark, rows)
    assert CHUNK > 256


def test_empty_and_unique(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffixes.digest(docs).count() == 0
    check(spark, [(1, "short"), (2, "other")])


def test_cut_text_keeps_characters(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("éab", [(1, 3)]), ("abc", None)], "t string, s array<struct<lo:int,hi:int>>")
    assert [r[0] for r in one.select(suffixes.cut_text(F.col("t"), F.col("s"))).collect()] == ["éb", "abc"]
