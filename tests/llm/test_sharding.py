import random
import zlib

import numpy as np

from fathomgrid.llm import sharding


def test_balance_slots_and_copies(spark):
    rng = random.Random(2)
    hot = "the same text for a third of all rows " * 3
    rows = [(i, hot if i % 3 == 0 else "".join(rng.choice("abcdefé") for _ in range(rng.randint(0, 400))), i) for i in range(6000)]
    rows += [(None, None, 1), (None, None, 2), (5, "", 1), (5, "", 1)] + [(7000 + i, f"pair {i // 2}", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int").repartition(5)
    got = sharding.shard_documents(docs, 10).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.001 * sizes.mean() + 1 and sizes.min() > 0.97 * sizes.mean()
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted(zip(got["size"], got.text_crc32)) == want
    spread = got[got.text_crc32 != zlib.crc32(hot.encode())].groupby("text_crc32").shard.nunique()
    assert spread.max() == 1
    again = sharding.shard_documents(docs.repartition(3), 10).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard"]
    assert sorted(map(tuple, got[key].fillna(-1).to_numpy().tolist())) == sorted(map(tuple, again[key].fillna(-1).to_numpy().tolist()))


def test_small_groups_beside_a_hot_text_stay_together(spark):
    hot = "hot text " * 40
    cell = lambda texts: spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(
        "t", f"shiftrightunsigned(xxhash64(t), {64 - sharding.CELL_BITS}) c").collect()
    at = cell([hot])[0].c
    near = [r.t for r in cell([f"beside {i}" for i in range(1 << 19)]) if r.c == at]
    assert near
    rows = [(i, hot) for i in range(3000)] + [(9000 + 10 * j + i, t) for j, t in enumerate(near) for i in range(6)]
    rows += [(20_000 + i, f"other {i}") for i in range(3000)] + [(40_000 + i, None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sharding.shard_documents(docs, 10).toPandas()
    assert len(got) == len(rows)
    for t in near:
        assert got[got.text_crc32 == zlib.crc32(t.encode())].shard.nunique() == 1
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    again = sharding.shard_documents(docs.repartition(7), 10).toPandas()
    assert got.set_index("doc_id").sort_index().equals(again.set_index("doc_id").sort_index())


def test_one_more_shard_moves_little():
    rng = np.random.default_rng(1)
    cells, sizes = np.arange(0, 1 << 17, 16), rng.integers(1, 100, 1 << 13)
    sub = np.full(len(cells), -1)
    a, b = sharding.place(cells, sub, sizes, 20), sharding.place(cells, sub, sizes, 21)
    assert sizes[a != b].sum() < 0.5 * sizes.sum()
    assert np.bincount(b, sizes).max() <= 1.001 * sizes.sum() / 21 + 1


def test_empty_and_tiny(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id bigint, text string"), 4).count() == 0
    one = sharding.shard_documents(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), 4).collect()
    assert len(one) == 1 and one[0].slot == 0 and one[0].size == 17
