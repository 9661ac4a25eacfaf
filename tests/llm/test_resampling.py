import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from fathomgrid.llm import resampling
from fathomgrid.llm.words import slices, words_of

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, least, longest=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: Counter(bucket(f) for t in texts for f in runs(t, longest)[1])
    s, t = count(d[1] for d in docs), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, text in docs:
        words, found = runs(text, longest)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    eligible = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank = {id(r): n + 1 for n, r in enumerate(eligible[:percent * len(eligible) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["Été", "WORD", "the", "12ab", "x_y", "中文", "o'clock", "a-b", "İ"] + [f"v{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 60])))) for i in range(500)]
    docs += [(None, "one two three " * 9), (600, None), (601, ""), (602, "the " * 300_000), (603, " -- "), (604, "one two\nthree. " * 9)]
    docs += [(700, "copy of a text " * 8)] * 2
    target = [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(40)] + [None, ""]
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, rank string, weight int").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resampling.resample(table, bench)) == brute(docs, target, 10, 20)
    assert got(resampling.resample(table, bench, percent=37, least_words=3, longest=3, buckets=97)) == brute(docs, target, 37, 3, 3, 97)
    assert got(resampling.resample(table, bench.limit(0), percent=100)) == brute(docs, [], 100, 20)
    assert got(resampling.resample(table.limit(0), bench)) == []


def test_ranks_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 50)
    docs = [(i, "a b c d e f g h i j k l m n o p q r s t " + "u " * (i % 2)) for i in range(1000)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    bench = spark.createDataFrame([("a b u",)], "text string")
    assert got(resampling.resample(table, bench, percent=60)) == brute(docs, ["a b u"], 60, 20)


def test_words_in_bounded_slices():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["aa bb", None, "c" * 50, "", "D e D"])})
    parts = list(slices(batch, limit=10))
    assert sum(p.num_rows for p in parts) == 5 and len(parts) > 1
    words = words_of(batch.column("text"), resampling.SEPARATORS)
    assert [(int(d), words.names[int(c)].as_py()) for d, c in zip(words.doc, words.code)] == [
        (0, "aa"), (0, "bb"), (2, "c" * 50), (4, "d"), (4, "e"), (4, "d")]
