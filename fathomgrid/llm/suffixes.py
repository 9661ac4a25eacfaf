"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if some string of 100 bytes that covers it also starts earlier, in a document with a
smaller id or earlier in the same document. Matches never cross documents.

Ranking every position of a corpus at every doubling would move the corpus many times over. Here
the positions that enter the doubling are chosen by content: the anchor of a 100-byte window is its
least 32-byte string, so equal windows have equal anchors at equal places, and about one position
in 35 is an anchor. The ranks then grow in length, and what is unique at a length leaves:

1. 32 bytes: anchors are grouped by name; a unique anchor means that all its windows are unique.
2. The whole run of windows that share an anchor (100 to 168 bytes): runs with equal rank pairs
   (name of the first window, name of the last) are equal, and all but the first occurrence are
   past the threshold, so their windows go.
3. First occurrences whose anchor also stands in other runs: ranks of 66 bytes, anchor and the
   34 bytes on one side, one of which every window contains; unique halves leave.
4. 100 bytes: windows that share a 66-byte string are ranked; all but the first occurrence go.

A rank is the name of a string: pairs of 64-bit names, doubled from 8 bytes up. Groups are counted
with map-side combination; joins back to the rows are plain equi-joins whose hot keys adaptive
execution splits. Only half-runs with few sharers are brought together in one task; the windows of
hot ones are ranked by aggregation. Texts are shuffled by document, never by match.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, free_names, rows_in, stage, text_hash, to_arrow
from .substrings import THRESHOLD, buffers, halves, runs

NO_ID = -(1 << 63)     # null ids come first, as this number
TOGETHER = 4096        # sharers of a half-run that one task may hold; more are ranked by aggregation

RUNS = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("d", pa.int64()), ("h", pa.int64()),
                  ("s", pa.int32()), ("n", pa.int32()), ("a", pa.int32())])
HALVES = pa.schema([("half", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("s", pa.int32()), ("windows", pa.binary())])
SPANS = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the document's identity (d, h)."""
    rows = documents(docs, id_col, text_col)
    return rows.withColumns({"d": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), "h": text_hash(F.col("text"))})


def _runs(batches):
    texts = (((d, h), text.encode()) for d, h, text in rows_in(batches, "d", "h", "text"))
    for owners, data, lo, hi, base in buffers(texts):
        text, first, count, at, key, context = runs(data, lo, hi)
        d, h = np.array([o[0] for o in owners], np.int64), np.array([o[1] for o in owners], np.int64)
        yield to_arrow(RUNS, [key, context, d[text], h[text], first + base[text], count, at + base[text]])


def _halves(batches):
    for d, h, text, found in rows_in(batches, "d", "h", "text", "runs"):
        data, out = text.encode(), []
        found.sort(key=lambda r: r["s"])
        for part in _near(found):
            lo, hi = part[0]["s"], part[-1]["s"] + part[-1]["n"] + THRESHOLD - 1
            s, n, a = (np.array([r[c] for r in part]) for c in "sna")
            out += [(half, d, h, lo + at, names) for half, at, names in halves(data[lo:hi], s - lo, n, a - lo)]
        for at in range(0, len(out), 4096):
            yield to_arrow(HALVES, [list(c) for c in zip(*out[at:at + 4096])])


def _near(found: list) -> list[list]:
    """Runs in order, in groups that lie close together."""
    parts: list[list] = []
    for r in found:
        last = parts[-1][-1] if parts else None
        if last and r["s"] - last["s"] < 1000 and r["s"] - parts[-1][0]["s"] < 1 << 20:
            parts[-1].append(r)
        else:
            parts.append([r])
    return parts


def _later(batches):
    """Spans of windows seen before, from rows ordered by half and position."""
    rows = rows_in(batches, "half", "d", "h", "s", "windows")
    out = []
    for _, group in groupby(rows, key=lambda r: r[0]):
        seen: set[int] = set()
        for _, d, h, s, windows in group:
            names = np.frombuffer(windows, "<u8").tolist()
            known = np.array([w in seen for w in names])
            seen.update(names)
            at = np.flatnonzero(known)
            for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                out.append((d, h, s + int(part[0]), s + int(part[-1]) + THRESHOLD))
        if len(out) > 4096:
            yield to_arrow(SPANS, [list(c) for c in zip(*out)])
            out = []
    if out:
        yield to_arrow(SPANS, [list(c) for c in zip(*out)])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, h, spans): byte spans [lo, hi) to remove, unmerged, of every document that has any.

    d is the id (null: the least long), h the hash of the text. An empty table, or one without
    repeats, gives no rows. Rows with equal id and text are one document.
    """
    rows = keyed(docs, id_col, text_col).select("d", "h", "text")
    schema = "key bigint, context bigint, d bigint, h bigint, s int, n int, a int"
    every = rows.mapInArrow(_runs, schema)
    shared = stage(every.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("context").alias("x"),
                                            F.max("context").alias("y"))
                   .where("rows > 1").select("key", (F.col("x") != F.col("y")).alias("varied")), "shared-anchors")
    hits = stage(every.join(shared, "key"), "runs")
    here = F.struct("d", "h", "s")
    first = hits.groupBy("key", "context").agg(F.min(here).alias("first"))
    marked = stage(hits.join(first, ["key", "context"])
                   .select("d", "h", "s", "n", "a", (F.col("first") != here).alias("later"), "varied"), "marked")
    spans = marked.where("later").select("d", "h", F.col("s").alias("lo"), (F.col("s") + F.col("n") + (THRESHOLD - 1)).alias("hi"))
    open_runs = (marked.where("varied and not later").groupBy("d", "h")
                 .agg(F.collect_set(F.struct("s", "n", "a")).alias("runs")))
    parts = stage(rows.join(open_runs, ["d", "h"]).mapInArrow(_halves, "half bigint, d bigint, h bigint, s int, windows binary")
                  .dropDuplicates(["half", "d", "h", "s"]), "halves")
    count = parts.groupBy("half").agg(F.count(F.lit(1)).alias("sharers")).where("sharers > 1")
    parts = stage(parts.join(count, "half"), "shared-halves")
    few = (parts.where(F.col("sharers") <= TOGETHER).select("half", "d", "h", "s", "windows")
           .repartition("half").sortWithinPartitions("half", "d", "h", "s")
           .mapInArrow(_later, "d bigint, h bigint, lo int, hi int"))
    window = F.expr("transform(sequence(0, cast(length(windows) / 8 as int) - 1), i -> substring(windows, i * 8 + 1, 8))")
    many = (parts.where(F.col("sharers") > TOGETHER)
            .select("half", "d", "h", "s", F.posexplode(window).alias("i", "w")).withColumn("s", F.col("s") + F.col("i")))
    earliest = many.groupBy("half", "w").agg(F.min(here).alias("first"))
    many = (many.join(earliest, ["half", "w"]).where(F.col("first") != here)
            .select("d", "h", F.col("s").alias("lo"), (F.col("s") + THRESHOLD).alias("hi")))
    return (spans.unionByName(few).unionByName(many).groupBy("d", "h")
            .agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))


def merge_spans(spans) -> list[tuple[int, int]]:
    """Disjoint maximal spans in order."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in (spans if spans is not None else ())):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(data[at:lo])
        at = hi
    return b"".join([*kept, data[at:]])


def cut_text(text: Column, spans: Column) -> Column:
    """Text without its spans; a character that a span covers in part stays whole."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, found):
            merged = merge_spans(s)
            if not merged:
                out.append(t)
                continue
            data = t.encode()
            whole = []
            for lo, hi in merged:
                while lo < hi and lo < len(data) and data[lo] & 0xC0 == 0x80:
                    lo += 1
                while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
                    hi -= 1
                whole.append((lo, hi))
            out.append(cut(data, whole).decode())
        return pd.Series(out, dtype=object)

    return run.asNondeterministic()(text, spans)  # evaluated once, however often the result is used


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: str = "_spans") -> DataFrame:
    """All columns of docs, and the byte spans to remove (null: none) under the given name, which docs must not have."""
    d, h = free_names(docs, "_d", "_h")
    found = repeated_spans(docs, id_col, text_col).toDF(d, h, spans)
    me = {d: F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)), h: text_hash(F.coalesce(F.col(text_col), F.lit("")))}
    return docs.withColumns(me).join(found, [d, h], "left").drop(d, h)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept_sha256", pa.string())])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(batches):
        out = []
        for doc_id, text, spans in rows_in(batches, "doc_id", "text", "_spans"):
            data, merged = text.encode(), merge_spans(spans)
            out.append((doc_id, len(data), sum(b - a for a, b in merged), len(merged), hashlib.sha256(cut(data, merged)).hexdigest()))
            if len(out) == 1000:
                yield to_arrow(DIGEST, [list(c) for c in zip(*out)])
                out = []
        if out:
            yield to_arrow(DIGEST, [list(c) for c in zip(*out)])

    rows = documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return with_spans(rows).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
