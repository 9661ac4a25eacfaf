import hashlib

from pyspark.sql import functions as F

from fathomgrid.llm.lempel_ziv import MINIMA, Phrases, compare_neighbours, fingerprints, likeness, phrase_signature


def phrases(data: bytes) -> set[bytes]:
    """Brute-force parse into phrases as byte strings."""
    seen, at = set(), b""
    for i in range(len(data)):
        at += data[i:i + 1]
        if at not in seen:
            seen.add(at)
            at = b""
    return seen


def test_as_many_phrases_as_brute_force():
    for t in ["", "a", "aaaaaaa", "abababababab", "the cat the cat the dog " * 20, "é日本" * 30]:
        assert len(set(Phrases().feed(t.encode()).hashes[1:])) == len(phrases(t.encode()))
    a, b = "the quick brown fox jumps " * 3, "over the lazy dog " * 4
    assert Phrases().feed(a.encode()).copy().feed(b.encode()).hashes == Phrases().feed((a + b).encode()).hashes


def test_likeness_follows_overlap():
    import random

    rng = random.Random(1)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    a, b = make(400), make(400)
    mixed = a[:len(a) * 3 // 4] + b[:len(b) // 4]
    sa, sb = phrases(a.encode()), phrases(mixed.encode())
    exact = len(sa & sb) / len(sa | sb)
    assert abs(likeness(phrase_signature(a), phrase_signature(mixed)) - exact) < 4 * (0.25 / MINIMA) ** 0.5
    assert likeness(phrase_signature(a), phrase_signature(a)) == 1


def test_neighbours(spark):
    rows = [(i, f"text number {i} " * (i % 7), "x") for i in range(50)] + [(60, None, "x"), (60, "twice", "x"), (None, "no id", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part string").repartition(4)
    got = {(r.doc_id, r.n_chars): r for r in compare_neighbours(docs, parts=6).collect()}
    assert len(got) == len(rows)
    order = [(i, t or "") for i, t, _ in sorted(rows[:50], key=lambda r: -r[0])] + [(None, "no id")]
    first = sorted([r for k, r in got.items() if k[0] == 60], key=lambda r: r.n_chars)
    assert len(first) == 2
    for (i, t), (_, n) in zip(order, order[1:]):
        r = got[i, len(t)]
        m = len(t) // 2
        edited = t[:len(t) - m] + n[:m]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == phrase_signature(t).tobytes().hex()
        assert r.edited_fingerprint == phrase_signature(edited).tobytes().hex()
        assert r.near_next == likeness(phrase_signature(t), phrase_signature(n))


def test_extreme_repeated_and_null_ids(spark):
    """Against the order of all rows: ids at both ends of the type, half the rows under one id, a third under none."""
    ids = [-(1 << 63), 1 - (1 << 63), (1 << 63) - 1, -1, 0, (1 << 60) + 1, 1 << 60]
    rows = [(i, f"extreme {i}") for i in ids] + [(7, hashlib.sha1(str(i).encode()).hexdigest()) for i in range(60)] + [(None, hashlib.md5(str(i).encode()).hexdigest()) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    order = [tuple(r) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) h").orderBy(F.desc_nulls_last("doc_id"), "h").collect()]
    for parts in (1, 9, 30):
        got = {(r.doc_id, r.fingerprint, r.edited_sha256): r for r in compare_neighbours(docs, parts=parts).collect()}
        assert len(got) == len(rows)
        for (i, t, _), (_, n, _) in zip(order, order[1:] + order[:1]):
            m = len(t) // 2
            edited = t[:len(t) - m] + n[:m]
            r = got[i, phrase_signature(t).tobytes().hex(), hashlib.sha256(edited.encode()).hexdigest()]
            assert r.near_next == likeness(phrase_signature(t), phrase_signature(n))


def test_one_row_and_none(spark):
    one = compare_neighbours(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1
    assert compare_neighbours(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert fingerprints(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).first().fingerprint == "f" * 8 * MINIMA
