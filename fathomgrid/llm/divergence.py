"""How far the word use of every source is from that of the other sources of its language.

Every (language, source) group gives each kept term a smoothed share p; the distance of two groups
is the sum over terms of (p - q)**2 / q, in exact integers. With S sources and V terms, almost all
shares are those of terms a group lacks, so the sum is put together from

* its value if neither group had any term, V times one number,
* a correction per term of one group, from the counts of its terms by share, and
* a correction per term that both have, by Gustavson's row accumulation: the index lists for
  each term the groups that have it; a task takes a part of the index, and for each group walks
  the lists of the group's terms and scatters into an array over its peers. What leaves the
  task is one number per pair of groups, never the pairs of postings.

Texts are read once. Words are counted in the task that reads them, then by Spark; all later tables
have a row per (group, term) at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.durable import join_checked, small_enough

from .common import stage, to_arrow
from .words import slices, words_of

SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
POSTINGS, GATHER = 1 << 19, 1 << 18   # postings of an index part, and of a step of the walk

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                    ("n", pa.int64()), ("docs", pa.int64())])
PARTIAL = pa.schema([("no", pa.int64()), ("peer", pa.int64()), ("value", pa.int64())])


def _count(batches):
    """Occurrences and documents of every term of every group in a part of a batch."""
    for batch in batches:
        for part in slices(batch):
            words = words_of(part.column("text"), SEPARATORS)
            if not len(words.code):
                continue
            number: dict = {}
            of_row = np.array([number.setdefault(k, len(number)) for k in zip(
                part.column("lang").to_pylist(), part.column("source").to_pylist())], np.int64)
            terms = len(words.names)
            # (document, term) once each, with the number of occurrences
            seen, times = np.unique(words.doc * terms + words.code, return_counts=True)
            doc, code = np.divmod(seen, terms)
            cell, at = np.unique(of_row[doc] * terms + code, return_inverse=True)
            n = np.bincount(at, times, len(cell)).astype(np.int64)
            docs = np.bincount(at, minlength=len(cell))
            group, code = np.divmod(cell, terms)
            columns = [pc.take(pa.array(names, pa.string()), pa.array(group)) for names in zip(*number)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pc.take(words.names, pa.array(code)), pa.array(n), pa.array(docs)], schema=COUNTS)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                          for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    rows = named.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / total), exact for counts of any size."""
    wide = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    small = F.call_function("div", F.lit(UNIT) * (n + 1), total)
    return F.lit(1) + F.when(n < F.lit(1 << 32), small).otherwise(
        F.call_function("div", wide, total.cast("decimal(20,0)")))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p, q):
    d = p - q
    return d * d // q


def walk(term: np.ndarray, group: np.ndarray, p: np.ndarray, zero: np.ndarray):
    """Corrections of all pairs of groups that share terms: (groups, for each its peers and sums).

    Postings are sorted by term; zero is the share a group gives a term it lacks. Row by row: the lists of
    a group's terms are gathered a bounded number at a time and summed into an array over all peers.
    """
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    ends = np.append(starts[1:], len(term))
    row = np.repeat(np.arange(len(starts)), ends - starts)
    groups, peer = np.unique(group, return_inverse=True)
    zeros = np.zeros(len(groups), np.int64)
    zeros[peer] = zero
    order = np.argsort(peer, kind="stable")
    bounds = np.searchsorted(peer[order], np.arange(len(groups) + 1))
    for g in range(len(groups)):
        mine = order[bounds[g]:bounds[g + 1]]
        first, size = starts[row[mine]], (ends - starts)[row[mine]]
        total = np.zeros(len(groups), np.int64)
        cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // GATHER)) + 1
        for some in np.split(np.arange(len(mine)), cut):
            length = size[some]
            at = np.arange(length.sum()) + np.repeat(first[some] - (np.cumsum(length) - length), length)
            mine_p, theirs = np.repeat(p[mine[some]], length), peer[at]
            q, q0 = p[at], zeros[theirs]
            value = _gap(mine_p, q) - _gap(mine_p, q0) - _gap(zeros[g], q) + _gap(zeros[g], q0)
            np.add.at(total, theirs, value)
        total[g] = 0
        to = np.flatnonzero(total)
        if len(to):
            yield groups[g], groups[to], total[to]


def _accumulate(batches):
    """Sums over parts of the index that hold whole terms."""
    def flush(columns):
        got = [x for x in walk(*columns)]
        if got:
            yield to_arrow(PARTIAL, [np.repeat([g for g, _, _ in got], [len(t) for _, t, _ in got]),
                                     np.concatenate([t for _, t, _ in got]), np.concatenate([v for _, _, v in got])])

    held, size = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("term", "no", "p", "z")])
        size += batch.num_rows
        if size >= POSTINGS:
            columns = [np.concatenate(x) for x in zip(*held)]
            # the last term may go on in the next batch
            before_last = np.flatnonzero(columns[0] != columns[0][-1])
            whole = int(before_last[-1]) + 1 if len(before_last) else 0
            if whole:
                yield from flush([x[:whole] for x in columns])
            held, size = [[x[whole:] for x in columns]], size - whole
    if size:
        yield from flush([np.concatenate(x) for x in zip(*held)])


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): peers and telling terms of every group.

    part 'pair' has every other source of the language, with the summed distance of the group's shares to
    that source's; part 'term' the group's terms whose share is above the language's, the `top` first.
    Ranks go by value, ties by item. A term counts where at least LEAST_DOCUMENTS rows of its language
    have it. Null texts, languages and sources are ''; repeated rows count each; groups
    without terms are listed with their peers, at 0 in a language without kept terms. An empty table
    gives no rows. Only the three named columns are read.
    """
    counts = stage(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    # the term-major index: as many entries per term as sources of the language have it
    index = stage(counts.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"),
        F.collect_list(F.struct("source", "n")).alias("postings"))
        .where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "term-index")
    groups = _groups(docs, index, lang_col, source_col)
    n_groups = groups.count()
    postings = index.withColumn("row", F.monotonically_increasing_id()).select("row", "lang", "term", "total", F.inline("postings"))
    postings = join_checked(postings, groups, ["lang", "source"], n_groups).withColumn("p", share(F.col("n"), F.col("size")))
    pairs = _pair_values(postings, groups, n_groups)
    by_value = Window.partitionBy("no").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(by_value).alias("rank")
    peers = groups.select(F.col("no").alias("peer"), F.col("source").alias("item"))
    pair_rows = (join_checked(join_checked(pairs, groups.select("no", "lang", "source"), ["no"], n_groups), peers, ["peer"], n_groups)
                 .select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank))
    q = share(F.col("total"), F.col("lang_size"))
    terms = postings.withColumn("q", q).where("p > q").select(
        "no", "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    term_rows = terms.select("*", rank).where(F.col("rank") <= top).drop("no")
    return pair_rows.unionByName(term_rows)


def _groups(docs: DataFrame, index: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """Every occurring group: number, size (occurrences and terms), its language's size, and the share of an absent term."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    own = index.select("lang", F.inline("postings")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    whole = index.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    zero = F.lit(0).cast("bigint")
    v, size = F.coalesce("v", zero), F.coalesce("n", zero) + F.coalesce("v", zero)
    return stage(docs.select(*named).distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left").select(
        F.monotonically_increasing_id().alias("no"), "lang", "source", v.alias("v"), size.alias("size"),
        (F.coalesce("lang_n", zero) + v).alias("lang_size"),
        F.when(v > 0, share(zero, size)).alias("z")), "groups")


def _pair_values(postings: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(no, peer, value) of all ordered pairs of groups of a language; their number is that of the result."""
    others = groups.select("lang", F.col("no").alias("peer"), F.col("z").alias("peer_z"))
    own = groups.select("lang", "no", "z", "v")
    base = join_checked(own, others, ["lang"], n_groups).where("no != peer").select(
        "no", "peer", F.coalesce(F.col("v") * distance(F.col("z"), F.col("peer_z")), F.lit(0).cast("bigint")).alias("value"))
    # terms of one group against a peer that lacks them, by distinct share
    levels = stage(postings.groupBy("lang", "no", "p", "z").agg(F.count(F.lit(1)).alias("m")), "levels")
    p, z, z2 = F.col("p"), F.col("z"), F.col("peer_z")
    one, two = F.col("no"), F.col("peer")
    single = join_checked(levels, others, ["lang"], n_groups).where("no != peer").select(F.inline(F.array(
        F.struct(one.alias("no"), two.alias("peer"), (F.col("m") * (distance(p, z2) - distance(z, z2))).alias("value")),
        F.struct(two.alias("no"), one.alias("peer"), (F.col("m") * (distance(z2, p) - distance(z2, z))).alias("value")))))
    walked = postings.select(F.col("row").alias("term"), "no", "p", "z")
    if not small_enough(groups, n_groups):  # the join above was not a broadcast and has torn terms apart
        walked = walked.repartition("term").sortWithinPartitions("term")
    both = walked.mapInArrow(_accumulate, "no bigint, peer bigint, value bigint")
    return base.unionByName(single).unionByName(both).groupBy("no", "peer").agg(F.sum("value").alias("value"))
