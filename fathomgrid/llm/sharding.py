"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every document belongs to a ring cell: its text's hash picks one of 2**17 arcs, so equal texts
meet in a cell. In a cell with more bytes than a whole shard, a text whose copies alone exceed a shard
is split by document id into sub-cells, each with a ring position of its own; the cell's other texts
go to sub-cells by text, so copies that fit a shard stay together. A cell goes to the first
virtual node clockwise whose shard still has room; the capacity is the mean load plus a small
slack, so no shard can exceed it while any other has room, and a change of the input moves only
cells near a boundary of capacity.

At scale only the cells are placed one after another, and their number is fixed whatever the
input: one aggregation gives bytes and rows per cell, the placement comes back as a table of fixed
size, and row numbers inside a shard are the cell's first number plus the rank within the cell. Cells
with very many rows (short or null texts) are counted and numbered in lots, so no window holds them whole.
Texts are read once and never shuffled.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_table

CELL_BITS = 17
SPLIT = 256
LOTS, MANY = 64, 1 / 256      # lots of a cell with more than this share of all rows
HEAVY = 1.0        # of a shard's mean load: a larger cell fits no shard
SLACK = 0.0005
VNODES = 64
RING = 1 << 64


def ring_point(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


def place(cells: np.ndarray, subs: np.ndarray, sizes: np.ndarray, shards: int, slack: float = SLACK,
          vnodes: int = VNODES) -> np.ndarray:
    """Shard of every cell: clockwise to the first shard with room, large cells first.

    sub -1 marks an unsplit cell, whose ring position is its arc. A cell too large for every
    shard's room goes to the least loaded shard.
    """
    nodes = sorted((ring_point("node", s, v), s) for s in range(shards) for v in range(vnodes))
    points, owners = [p for p, _ in nodes], [s for _, s in nodes]
    room = [int(np.ceil(int(sizes.sum()) / shards * (1 + slack)))] * shards
    out = np.zeros(len(cells), np.int32)
    for i in np.lexsort((subs, cells, -sizes)):
        cell, sub, size = int(cells[i]), int(subs[i]), int(sizes[i])
        point = cell << (64 - CELL_BITS) if sub < 0 else ring_point("cell", cell, sub)
        at = bisect.bisect_left(points, point)
        for step in range(len(owners)):
            shard = owners[(at + step) % len(owners)]
            if room[shard] >= size:
                break
        else:
            shard = max(range(shards), key=lambda s: (room[s], -s))
        room[shard] -= size
        out[i] = shard
    return out


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                    slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless in each shard) of every row.

    Null texts have no bytes; null ids are kept. Repeated rows are placed like any other rows.
    Rows that agree in id and text (no id, no text) cannot be told apart and are numbered in one lot.
    An empty table gives an empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int"))
    load = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")]
    whole = rows.groupBy("cell").agg(*load).toPandas()
    limit = HEAVY * whole.bytes.sum() / shards
    marked = whole.assign(heavy=whole.bytes > limit, many=whole.n > max(LOTS, MANY * whole.n.sum()))
    marked = marked[marked.heavy | marked.many]
    cells = whole[~whole.cell.isin(marked.cell)].assign(sub=-1, lot=0)
    rows = rows.withColumns({"sub": F.lit(-1), "lot": F.lit(0)})
    if len(marked):
        mark = small_table(spark, cell=pa.array(marked.cell, pa.int32()), heavy=pa.array(marked.heavy, pa.bool_()),
                           many=pa.array(marked.many, pa.bool_()))
        rows = rows.drop("sub", "lot").join(F.broadcast(mark), "cell", "left")
        # at most as many texts as there are shards are larger than one
        hot = rows.where("heavy").groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit).select("h").toPandas()
        rows = rows.join(F.broadcast(small_table(spark, h=pa.array(hot.h, pa.int64()), hot=pa.array([True] * len(hot), pa.bool_()))),
                         "h", "left")
        by_row = lambda seed, n: F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(seed)), F.lit(n)).cast("int")
        by_text = (F.pmod(F.xxhash64("h", F.lit(11)), F.lit(SPLIT)) + SPLIT).cast("int")
        rows = rows.select("doc_id", "size", "text_crc32", "cell", "heavy",
                           F.when(F.col("hot"), by_row(7, SPLIT)).when(F.col("heavy"), by_text).otherwise(-1).alias("sub"),
                           F.when(F.col("many") & F.col("hot").isNull(), by_row(13, LOTS)).otherwise(0).alias("lot"))
        parts = rows.where(F.col("heavy").isNotNull()).groupBy("cell", "sub", "lot").agg(*load).toPandas()
        cells = pd.concat([cells, parts[cells.columns]])
    cells = cells.sort_values(["cell", "sub", "lot"]).reset_index(drop=True)
    places = cells.groupby(["cell", "sub"], as_index=False).bytes.sum()
    places["shard"] = place(places.cell.to_numpy(np.int64), places["sub"].to_numpy(np.int64), places.bytes.to_numpy(np.int64), shards, slack)
    cells = cells.merge(places.drop(columns="bytes"), on=["cell", "sub"])
    first = cells.groupby("shard").n.cumsum() - cells.n
    placed = small_table(spark, **{c: pa.array(cells[c], pa.int32()) for c in ("cell", "sub", "lot", "shard")}, first=pa.array(first, pa.int64()))
    keys = ["cell", "sub", "lot"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "text_crc32")) - 1
    return (rows.select(*keys, "doc_id", "size", "text_crc32").withColumn("rank", rank).join(F.broadcast(placed), keys)
            .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).alias("slot")))
