"""Exact k best candidates of every query vector by distributed histogram selection.

Vectors become blocks of integers. Query blocks meet candidate blocks; a task multiplies two blocks at
a time and only ever sends on counts or final candidates:

1. Every score falls into one of BINS equal bins of the query's score interval, at first all scores
   its length allows; scores above the interval count in its top bin. Spark adds up the counts of all tasks,
   and the bin that holds the k-th best score becomes the query's next interval. Queries whose bin is one integer wide, or holds few scores, are
   done; the others score again, in that bin alone. The range shrinks by BINS each round, so two or
   three rounds do for any data.
2. All queries score once more and keep what reaches the lower end of their bin. From one pair of
   blocks at most k rows leave per query, the best by (score, id), so a bin full of equal scores stays
   bounded.
3. Ranks by (score, id) over what is left, a few times k rows per query.

Candidates are read in blocks and never shuffled while the query blocks are small enough to be
broadcast (their size is counted); above that, candidate blocks are dealt into lanes and query blocks
repeated per lane, an equi-join on the lane.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.durable import BROADCAST_BYTES

from .common import stage

BINS = 1024
FEW = 8             # times k: a bin with no more scores than this needs no further round
CANDIDATES, QUERIES = 2048, 256
LANE_BYTES = 256 << 20
COMPONENTS = 1 << 20
MOST_SCORE = 2.0 ** 63 - 2048

BLOCK = "n int, dim int, ids binary, vectors binary, longest double"
ASKED = "n int, dim int, numbers binary, ids binary, vectors binary, low binary, width binary"


def scaled(vectors: list, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(kept, matrix): which vectors take part, and floor(scale * x) of those, zero-filled to one length."""
    kept = np.array([v is not None and all(x is not None and math.isfinite(x) for x in v) for v in vectors], bool)
    used = [v for v, k in zip(vectors, kept) if k]
    out = np.zeros((len(used), max(map(len, used), default=0)))
    for row, v in zip(out, used):
        row[:len(v)] = v
    return kept, np.floor(out * scale).astype(np.int64)


def _rows(batch: pa.RecordBatch, scale: float):
    """Ids and integer vectors of a batch; the usual case of equal lengths without nulls stays in Arrow."""
    column = batch.column("vector")
    ids = batch.column("id")
    flat = column.flatten()
    lengths = column.value_lengths()
    if not column.null_count and not ids.null_count and not flat.null_count and len(lengths):
        size = lengths.to_numpy()
        if size.min() == size.max() and size[0]:
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), -1)
            good = np.isfinite(x).all(1)
            return ids.to_numpy()[good], np.floor(x[good] * scale).astype(np.int64)
    named = [(i, v) for i, v in zip(ids.to_pylist(), column.to_pylist()) if i is not None]
    kept, matrix = scaled([v for _, v in named], scale)
    return np.array([i for i, _ in named], np.int64)[kept], matrix


def _pack(scale: float, size: int):
    """Blocks of at most `size` vectors and COMPONENTS numbers."""
    def run(batches):
        for batch in batches:
            ids, matrix = _rows(batch, scale)
            step = max(1, min(size, COMPONENTS // max(matrix.shape[1], 1)))
            for at in range(0, len(ids), step):
                part = np.ascontiguousarray(matrix[at:at + step])
                longest = float(np.sqrt((part.astype(np.float64) ** 2).sum(1).max(initial=0)))
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([len(part)], pa.int32()), "dim": pa.array([part.shape[1]], pa.int32()),
                    "ids": pa.array([ids[at:at + step].astype(np.int64).tobytes()], pa.binary()),
                    "vectors": pa.array([_small(part).tobytes()], pa.binary()), "longest": pa.array([longest])})
    return run


def _small(matrix: np.ndarray) -> np.ndarray:
    """Half the bytes where 32 bits are enough."""
    return matrix.astype(np.int32) if np.abs(matrix).max(initial=0) < 1 << 31 else matrix


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = np.int32 if n * dim * 4 == len(data) else np.int64
    return np.frombuffer(data, kind).reshape(n, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products as 64-bit integers; missing components of the shorter vectors are 0.

    Floating-point multiplication is exact while every partial sum stays below 2**53.
    """
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(d, 1)
    if top < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _pairs(batches):
    """Block pairs as (query numbers, query low ends, widths, candidate ids, scores)."""
    kept_key = kept = None
    for batch in batches:
        for r in batch.to_pylist():
            if kept_key != (r["ids"], r["vectors"], r["dim"]):  # blocks of copies differ in their ids only
                kept_key, kept = (r["ids"], r["vectors"], r["dim"]), (np.frombuffer(r["ids"], np.int64), _matrix(r["vectors"], r["n"], r["dim"]))
            ids, matrix = kept
            asked = _matrix(r["q_vectors"], r["q_n"], r["q_dim"])
            scores = products(matrix, asked)
            own = np.frombuffer(r["q_ids"], np.int64)
            yield (np.frombuffer(r["numbers"], np.int64), np.frombuffer(r["low"], np.int64),
                   np.frombuffer(r["width"], np.int64), ids, scores, ids[:, None] != own[None, :])


def _histogram(batches):
    """(number, bin, n): scores of each query by bin of its interval, added up over a task's block pairs."""
    total: dict = {}

    def flush():
        for numbers, counts in total.values():
            q, b = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"number": numbers[q], "bin": pa.array(b, pa.int32()), "n": counts[q, b]})
        total.clear()

    for numbers, low, width, _, scores, other in _pairs(batches):
        key = numbers.tobytes()
        if key not in total:
            if len(total) >= 16:
                yield from flush()
            total[key] = numbers, np.zeros((len(numbers), BINS), np.int64)
        # as unsigned numbers, as the difference of two scores may exceed 63 bits
        at = np.minimum((scores - low).view(np.uint64) // width.view(np.uint64), np.uint64(BINS - 1)).astype(np.int64)
        valid = other & (scores >= low)
        flat = (at + np.arange(len(numbers)) * BINS)[valid]
        total[key][1][...] += np.bincount(flat, minlength=len(numbers) * BINS).reshape(-1, BINS)
    yield from flush()


def _reach(k: int):
    """(number, id, score) of the k best of each block pair that reach the query's low end."""
    def run(batches):
        for numbers, low, _, ids, scores, other in _pairs(batches):
            c, q = np.nonzero(other & (scores >= low))
            value, name = scores[c, q], ids[c]
            order = np.lexsort((name, -value, q))
            q, value, name = q[order], value[order], name[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            best = place < k
            if best.any():
                yield pa.RecordBatch.from_pydict({"number": numbers[q[best]], "id": name[best], "score": value[best]})
    return run


def _ask(batches):
    """Blocks of queries with the low end and bin width of each."""
    for batch in batches:
        dims = np.array(batch.column("dim").to_pylist(), np.int64)
        for dim in np.unique(dims):  # mostly one
            part = batch.filter(pa.array(dims == dim))
            size = max(1, min(QUERIES, COMPONENTS // max(int(dim), 1)))
            for at in range(0, part.num_rows, size):
                some = part.slice(at, size)
                matrix = np.array([np.frombuffer(v, np.int64) for v in some.column("vector").to_pylist()], np.int64)
                matrix = matrix.reshape(some.num_rows, int(dim))
                numbers = {c: some.column(c).to_numpy().astype(np.int64).tobytes() for c in ("number", "id", "low", "width")}
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([some.num_rows], pa.int32()), "dim": pa.array([int(dim)], pa.int32()),
                    "numbers": pa.array([numbers["number"]], pa.binary()), "ids": pa.array([numbers["id"]], pa.binary()),
                    "vectors": pa.array([_small(matrix).tobytes()], pa.binary()),
                    "low": pa.array([numbers["low"]], pa.binary()), "width": pa.array([numbers["width"]], pa.binary())})


def _unpack(batches):
    """One row per query: its number within the block, id, integer vector and length."""
    for batch in batches:
        for r in batch.to_pylist():
            matrix = _matrix(r["vectors"], r["n"], r["dim"]).astype(np.int64)
            length = np.sqrt((matrix.astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_pydict({
                "at": pa.array(np.arange(r["n"]), pa.int32()), "id": np.frombuffer(r["ids"], np.int64),
                "dim": pa.array([r["dim"]] * r["n"], pa.int32()),
                "vector": pa.array([row.tobytes() for row in matrix], pa.binary()), "length": length})


def _met(candidates: DataFrame, queries: DataFrame, n_queries: int, dim: int, lanes: int) -> DataFrame:
    """Every candidate block with every query block."""
    asked = queries.select("number", "id", "dim", "vector", "low", "width").mapInArrow(_ask, ASKED)
    asked = asked.withColumnsRenamed({"n": "q_n", "dim": "q_dim", "ids": "q_ids", "vectors": "q_vectors"})
    if n_queries * (dim * 8 + 32) <= BROADCAST_BYTES:
        return candidates.crossJoin(F.broadcast(asked))  # the stated query set, in blocks
    lane = F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int")
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return candidates.withColumn("lane", lane).join(asked.hint("shuffle_merge"), "lane").drop("lane")


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id",
          vector_col: str = "embedding", lanes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest integer inner products.

    is_query: condition on the id, as a column expression of `id`. Components become floor(scale * x); every row but
    those with the query's own id is a candidate; equal scores go by the smaller id. Vectors that are
    null or hold null or non-finite components, and rows without an id, take no part. A shorter vector counts as
    filled up with zeros, an empty one scores 0. Repeated rows are candidates each, and as queries each get
    their own rows. With fewer than k candidates all are listed; without any, or in an empty table, none.
    Scores must fit 64 bits. Further columns are not read.
    """
    named = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    candidates = stage(named.mapInArrow(_pack(scale, CANDIDATES), BLOCK), "vectors")
    about = candidates.agg(F.sum("n").alias("n"), F.max("longest").alias("longest"), F.max("dim").alias("dim"),
                           F.sum(F.octet_length("vectors")).alias("bytes")).first()
    if not about["n"]:
        return _ranked(candidates.select(F.lit(0).cast("bigint").alias("number"), F.lit(0).cast("bigint").alias("query_id"),
                                         F.lit(0).cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("score")).where("false"), k)
    lanes = lanes or max(1, math.ceil(about["bytes"] / LANE_BYTES))
    blocks = named.where(F.coalesce(is_query, F.lit(False))).mapInArrow(_pack(scale, QUERIES), BLOCK)
    rows = blocks.mapInArrow(_unpack, "at int, id bigint, dim int, vector binary, length double")
    # the Cauchy-Schwarz bound on a query's scores, rounded up; scores themselves fit 64 bits
    bound = F.least(F.col("length") * F.lit(about["longest"] * (1 + 1e-9)), F.lit(MOST_SCORE))
    reach = F.ceil(bound).cast("bigint") + 1
    queries = stage(rows.select(F.monotonically_increasing_id().alias("number"), "id", "dim", "vector", (-reach).alias("low"),
                                (F.floor(reach / (BINS / 2)) + 2).cast("bigint").alias("width")), "queries")
    n_queries = queries.count()
    state = queries.select("number", "low", "width", F.lit(False).alias("done"))
    located = None
    for _ in range(8):  # 1024**7 exceeds 64 bits
        left = state.where("not done").drop("done")
        n_left = left.count()
        if not n_left:
            break
        open_queries = queries.drop("low", "width").join(left, "number")
        counts = stage(_met(candidates, open_queries, n_left, about["dim"], lanes)
                       .mapInArrow(_histogram, "number bigint, bin int, n bigint")
                       .groupBy("number", "bin").agg(F.sum("n").alias("n")), "histograms")
        state = stage(_narrowed(counts, left, k), "intervals")
        done = state.where("done").select("number", "low", "width")
        located = done if located is None else located.unionByName(done)
    if located is None:
        located = state.select("number", "low", "width")
    final = queries.drop("low", "width").join(located, "number")
    found = _met(candidates, final, n_queries, about["dim"], lanes).mapInArrow(_reach(k), "number bigint, id bigint, score bigint")
    best = found.withColumnRenamed("id", "vec_id").join(queries.select("number", F.col("id").alias("query_id")), "number")
    return _ranked(best, k)


def _narrowed(counts: DataFrame, left: DataFrame, k: int) -> DataFrame:
    """The bin of each query that holds its k-th best score, as the next interval.

    Counts hold every score from the interval's low end up, so none is known from an earlier round. A query with
    fewer than k scores keeps its interval. The window holds one query's bins.
    """
    down = Window.partitionBy("number").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("upto", F.sum("n").over(down))
    hit = upto.where(F.col("upto") >= k).groupBy("number").agg(F.max_by(F.struct("bin", "n"), "bin").alias("hit"))
    at = left.join(hit, "number", "left")
    half = F.shiftright("hit.bin", 1)  # bins times width may exceed 64 bits, their halves do not
    low = F.coalesce(F.col("low") + half * F.col("width") + (F.col("hit.bin") - half) * F.col("width"), F.col("low"))
    done = F.col("hit").isNull() | (F.col("width") == 1) | (F.col("hit.n") <= FEW * k)
    width = F.when(done, F.col("width")).otherwise(F.floor((F.col("width") - 1) / BINS).cast("bigint") + 1)
    return at.select("number", low.alias("low"), width.alias("width"), done.alias("done"))


def _ranked(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
