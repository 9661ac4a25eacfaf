import random

import numpy as np
import public_tokenizers
import pytest

from fathomgrid.llm import sentencepieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "a", " ", "  a  b ", "the cat\nsat on the mat", "▁ literal", "x" * 300, "日本語のテキスト" * 20, "\0\x7f\n\n\t", "🙂é́",
         "<s>", "a" * 40 + " " + "b" * 40]


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(PATH)


def brute(p, text):
    """Plain dynamic programme over the whole text, with every vocabulary piece tried everywhere."""
    text = " " + text
    best, back = [0] + [None] * len(text), [None] * (len(text) + 1)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - p.longest), j):
            found = p.table.get(text[i:j])
            options = [(found[0], [found[1]])] if found else []
            if j == i + 1 and not p.table.get(text[i:j]):
                data = text[i].encode()
                options.append((p.byte_score * len(data), [p.byte[b] for b in data]))
            for score, ids in options:
                if best[i] is not None and (best[j] is None or best[i] + score > best[j]):
                    best[j], back[j] = best[i] + score, (i, ids)
    out, j = [], len(text)
    while j:
        j, ids = back[j]
        out = ids + out
    return out


def test_encode_equals_brute_force_and_round_trips(pieces):
    for t in TEXTS[1:]:
        ids = pieces.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == brute(pieces, t)
        assert pieces.decode(ids) == t
    assert pieces.encode("") == b"" and pieces.decode(b"") == ""


def test_words_solved_together_equal_single_ones(pieces):
    rng = random.Random(8)
    words = ["", "a", " ", "\n", "🙂", "日本", "x" * 70] + [
        "".join(rng.choice(["th", "e", " ", "ing", "é", "tion", "日", "\n", "aa", "🙂", "\0"]) for _ in range(rng.randint(1, 12)))
        for _ in range(300)]
    for w, (ids, score) in zip(words, pieces.solve(words)):
        want, best = pieces.trace(w)
        assert np.frombuffer(ids, "<u4").tolist() == want and score == best
    assert pieces.solve([]) == []


def test_a_full_lookup_starts_anew(pieces, monkeypatch):
    texts = ["the cat " * 3, "sat on", "", "y" * 200]
    want = [pieces.encode(t) for t in texts]
    monkeypatch.setattr(sp, "KNOWN_BYTES", 100)
    monkeypatch.setattr(sp, "TOGETHER", 2)
    assert [pieces.encode(t) for t in texts] == want and pieces.encode_all(texts) == want


def test_scan_equals_sequential_products():
    rng = np.random.default_rng(2)
    m = rng.integers(-1000, 0, (13, 4, 4))
    m[rng.random(m.shape) < 0.3] = sp.NEVER
    now, out = np.maximum(m[0], sp.NEVER // 2), sp.scan(m)
    for c in range(1, 13):
        now = np.maximum(sp.product(now, np.maximum(m[c], sp.NEVER // 2)), sp.NEVER // 2)
        assert (now == out[c]).all()


@pytest.mark.parametrize("chunk", [17, 40])
def test_chunks_equal_whole_texts(spark, pieces, chunk):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(["the", " ", "ing", "x", "é", "tion", "日", "\n", "aa"]) for _ in range(rng.randint(20, 200)))
                     for _ in range(30)]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)] + [(900, None, "y"), (6, texts[6], "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, c string").repartition(3)
    got = sp.decode_documents(sp.encode_documents(docs, PATH, giant=20, chunk=chunk), PATH).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    want = {i: np.frombuffer(pieces.encode(t or ""), "<u4").tolist() for i, t, _ in rows}
    for r in got:
        assert r.ids == want[r.doc_id] and r.n_tokens == len(r.ids)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert sp.decode_documents(sp.encode_documents(docs, PATH), PATH).count() == 0
