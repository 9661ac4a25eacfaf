"""Ordered cells of a population's values, with counts that merge.

A population is a long table (keys..., side, v), with side 'obs' or 'true'. Each key's span of values is
cut into FINE equal cells; a cell that is too full is cut again over the span it really has. A cell's
number follows from a value and the small tables of spans, so any pass over the rows can find it
again: nothing is sorted or sampled to cut values into ranges, and a task that is run again comes to
the same cells.

Populations may be nested: with depths, each row names in `depth_class` the shallowest depth it
belongs to, and belongs to all deeper ones too. Counts are kept per class and added up over classes,
so that several depths share every pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import join_checked, recorded

SIDES = ("obs", "true")
FINE = 4096
DEEPEST_SPLIT = 4        # cell numbers of five levels fit 64 bits
FINAL_ROWS = 200_000     # rows of a cell that may be ordered at once
RANGE_BYTES = 8 << 20    # of a range that is ordered at once


def cell_in(v: Column, lo: Column, hi: Column) -> Column:
    """0 to FINE - 1, never falling with v; halves keep the span of any two doubles finite."""
    part = F.try_divide(v * 0.5 - lo * 0.5, hi * 0.5 - lo * 0.5)
    return F.least(F.floor(F.coalesce(part, F.lit(0.0)) * FINE), F.lit(FINE - 1)).cast("bigint")


def by_depth(population: DataFrame, depths) -> DataFrame:
    """One row per nested population a row belongs to, under max_depth: for aggregates combined map-side."""
    if not depths:
        return population
    names = F.array(*[F.lit(d) for d in depths])
    return population.withColumn("max_depth", F.explode(F.slice(names, F.col("depth_class") + 1, len(depths))))


def moment_columns() -> list[Column]:
    """Mean, standard deviation (population) and biased skewness of each side."""
    return [f(F.when(F.col("side") == s, F.col("v"))).alias(f"{s}_{n}")
            for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("skew", F.skewness)) for s in SIDES]


@dataclass(frozen=True)
class Ranks:
    """A population (keys..., side, v[, depth_class]) and its value cells, counted on first use.

    depths: names of the nested populations, shallow to deep; results then have a row for each, under
    max_depth. extra: further aggregates over the population's rows, for the first pass to take along.
    """

    population: DataFrame
    keys: tuple[str, ...]
    depths: tuple = ()
    extra: tuple = ()

    @property
    def classes(self) -> range:
        return range(max(1, len(self.depths)))

    @property
    def count_names(self) -> list[str]:
        return [f"n_{s}_{c}" for c in self.classes for s in SIDES]

    @cached_property
    def rows(self) -> DataFrame:
        cls = F.col("depth_class") if self.depths else F.lit(0)
        return self.population.select(*self.keys, "side", "v", cls.cast("int").alias("cls"))

    def counted(self, rows: DataFrame, *by: str) -> DataFrame:
        """Counts per class and side, first and last value."""
        return rows.groupBy(*self.keys, *by).agg(
            *[F.count_if((F.col("side") == s) & (F.col("cls") == c)).alias(f"n_{s}_{c}") for c in self.classes for s in SIDES],
            F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))

    @cached_property
    def _summary(self) -> tuple[DataFrame, int]:
        rows = by_depth(self.population, self.depths)
        table, size = recorded(rows.groupBy(*self.result_keys).agg(
            F.min("v").alias("lo"), F.max("v").alias("hi"), *moment_columns(), *self.extra), "summary")
        return table, size["n"]

    @property
    def summary(self) -> DataFrame:
        """(keys..., [max_depth,] lo, hi, moments), from the first pass over the rows."""
        return self._summary[0]

    @property
    def spans(self) -> tuple[DataFrame, int]:
        """(keys..., lo, hi) and a bound on the number of keys."""
        table, n = self._summary
        return table.groupBy(*self.keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")) if self.depths else \
            table.select(*self.keys, "lo", "hi"), n

    @cached_property
    def placed(self) -> DataFrame:
        """rows with the number of their cell."""
        spans, n = self.spans
        found = join_checked(self.rows, spans, self.keys, n)
        return found.withColumn("node", cell_in(F.col("v"), F.col("lo"), F.col("hi")) + 1).drop("lo", "hi")

    @property
    def cells(self) -> DataFrame:
        """(keys..., node, counts, first, last): every cell that holds values."""
        return self._cells[0]

    @cached_property
    def _cells(self) -> tuple[DataFrame, int]:
        """cells, and the rows of the fullest one that holds several values."""
        return self.written(self.placed)

    def written(self, placed: DataFrame) -> tuple[DataFrame, int]:
        table, size = recorded(self.counted(placed, "node"), "value-cells",
                               most=F.max(F.when(F.col("first") < F.col("last"), F.col("n"))))
        return table, size["most"] or 0

    def inside(self, placed: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
        """Placed rows in the given cells, placed anew in their parts. nodes: (keys..., node, first, last)."""
        spans = nodes.select(*self.keys, "node", F.col("first").alias("lo"), F.col("last").alias("hi"))
        part = cell_in(F.col("v"), F.col("lo"), F.col("hi"))
        return (join_checked(placed, spans, [*self.keys, "node"], n)
                .withColumn("node", F.col("node") * FINE + part + 1).drop("lo", "hi"))

    def upto(self, side: str, depth: int) -> Column:
        """Rows of one side in a nested population, from the counts per class."""
        return sum((F.col(f"n_{side}_{c}") for c in range(1, depth + 1)), F.col(f"n_{side}_0"))

    def pooled(self, depth: int) -> Column:
        return self.upto("obs", depth) + self.upto("true", depth)

    def named_depth(self, column: str = "depth") -> list[Column]:
        """max_depth for the number of a nested population; nothing without depths."""
        if not self.depths:
            return []
        return [F.element_at(F.array(*[F.lit(d) for d in self.depths]), F.col(column) + 1).alias("max_depth")]

    @property
    def result_keys(self) -> list[str]:
        return [*self.keys, *(["max_depth"] if self.depths else [])]


# ---------------------------------------------------------------- percentiles

def _asked(ranks: Ranks, probs: dict) -> DataFrame:
    """The cell of every order statistic a percentile needs, and its place inside.

    (keys..., depth, name, end, t, node, place, n, first, last). The windows hold the cells of one key.
    """
    before = Window.partitionBy(*ranks.keys).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*ranks.keys)
    items = []
    for d in ranks.classes:
        size, zero = ranks.pooled(d), F.lit(0).cast("bigint")
        start, last = F.coalesce(F.sum(size).over(before), zero), F.sum(size).over(whole) - 1
        for name, p in probs.items():
            low = F.floor(last * F.lit(float(p)))
            for end, rank in ((0, low), (1, F.least(low + 1, last))):
                items.append(F.struct(F.lit(d).alias("depth"), F.lit(name).alias("name"), F.lit(end).alias("end"),
                                      (last * F.lit(float(p)) - low).alias("t"), (rank - start).alias("place"),
                                      (size).alias("size")))
    rows = ranks.cells.select(*ranks.keys, "node", "n", "first", "last", F.array(*items).alias("items"))
    return rows.select(*ranks.keys, "node", "n", "first", "last", F.inline(F.filter(
        "items", lambda x: (x["place"] >= 0) & (x["place"] < x["size"])))).drop("size")


def _narrowed(ranks: Ranks, asked: DataFrame, counts: DataFrame) -> DataFrame:
    """asked moved into the parts of its cells. counts: the parts, under (keys..., parent, node)."""
    before = Window.partitionBy(*ranks.keys, "parent").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.struct(F.coalesce(F.sum(ranks.pooled(d)).over(before), F.lit(0).cast("bigint")).alias("start"),
                     ranks.pooled(d).alias("size")) for d in ranks.classes]
    parts = counts.select(*ranks.keys, "parent", F.col("node").alias("part"), "n", "first", "last", F.array(*sums).alias("sums"))
    own = asked.select(*ranks.keys, F.col("node").alias("parent"), "depth", "name", "end", "t", "place")
    at = F.element_at("sums", F.col("depth") + 1)
    return (own.join(parts, [*ranks.keys, "parent"])
            .where((F.col("place") >= at["start"]) & (F.col("place") < at["start"] + at["size"]))
            .select(*ranks.keys, F.col("part").alias("node"), "n", "first", "last", "depth", "name", "end", "t",
                    (F.col("place") - at["start"]).alias("place")))


def percentiles(ranks: Ranks, probs: dict) -> DataFrame:
    """Exact linear-interpolated percentiles of the pooled values: (keys..., [max_depth,] <name>...).

    Two passes of mergeable counts (span, cells) find the cells that hold the order statistics; cells with
    more than FINAL_ROWS rows are cut again, and only the rows of the last cells are ordered.
    """
    keys, placed, found = ranks.keys, ranks.placed, None
    open_cell = F.col("first") < F.col("last")
    watched = {"open": F.count_if(open_cell), "most": F.max(F.when(open_cell, F.col("n")))}
    asked, size = recorded(_asked(ranks, probs), "asked", **watched)
    for depth in range(DEEPEST_SPLIT + 1):
        settled = asked.where(~open_cell).withColumn("value", F.col("first"))
        found = settled if found is None else found.unionByName(settled)
        if not size["open"]:
            break
        nodes = asked.where(open_cell).select(*keys, "node", "first", "last").distinct()
        if size["most"] <= FINAL_ROWS or depth == DEEPEST_SPLIT:
            found = found.unionByName(_ordered(ranks, placed, asked.where(open_cell), nodes, size["open"]))
            break
        placed = ranks.inside(placed, nodes, size["open"])
        counts = ranks.counted(placed, "node").withColumn("parent", F.floor((F.col("node") - 1) / FINE))
        asked, size = recorded(_narrowed(ranks, asked.where(open_cell), counts), "asked", **watched)

    def of(name, end, value):
        return F.max(F.when((F.col("name") == name) & (F.col("end") == end), F.col(value)))

    def percentile(name):
        a, b = of(name, 0, "value"), of(name, 1, "value")
        return (a + (b - a) * of(name, 0, "t")).alias(name)

    done = found.groupBy(*keys, "depth").agg(*[percentile(name) for name in probs])
    return done.select(*keys, *ranks.named_depth(), *probs)


def _ordered(ranks: Ranks, placed: DataFrame, asked: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """asked with its value, from the ordered distinct values of the given cells."""
    keys = [*ranks.keys, "node"]
    rows = join_checked(placed, nodes.select(*keys), keys, n, "left_semi")
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = ranks.counted(rows, "node", "v").select(
        *keys, "v", F.array(*[F.sum(ranks.pooled(d)).over(upto) for d in ranks.classes]).alias("past"),
        F.array(*[ranks.pooled(d) for d in ranks.classes]).alias("own"))
    past, own = F.element_at("past", F.col("depth") + 1), F.element_at("own", F.col("depth") + 1)
    hits = asked.join(values, keys).where((F.col("place") < past) & (F.col("place") >= past - own))
    return hits.withColumnRenamed("v", "value").select(*asked.columns, "value")


# ---------------------------------------------------------------- ranges in order

def ranges(ranks: Ranks) -> tuple[DataFrame, DataFrame, int]:
    """Values in ranges of about RANGE_BYTES, each with what lies before it.

    (rows, table, n): rows (keys..., range, v, counts) of distinct values; table (keys..., range, before_*, all_*,
    next_first), one row per range; n the number of ranges that the counted rows call for.
    """
    keys, names = list(ranks.keys), ranks.count_names
    width = 8 * (2 + len(names)) + 16 * len(keys)
    per_range = max(1, RANGE_BYTES // width)
    placed, leaves, (cells, most) = ranks.placed, None, ranks._cells
    for depth in range(DEEPEST_SPLIT + 1):
        full = (F.col("first") < F.col("last")) & (F.col("n") * 4 > per_range)
        done = depth == DEEPEST_SPLIT or most * 4 <= per_range
        kept = cells if done else cells.where(~full)
        leaves = kept if leaves is None else leaves.unionByName(kept)
        if done:
            break
        n_nodes = cells.where(full).count()
        nodes = cells.where(full).select(*keys, "node", "first", "last")
        fresh = ranks.inside(placed, nodes, n_nodes)
        placed = join_checked(placed, nodes.select(*keys, "node"), [*keys, "node"], n_nodes, "left_anti").unionByName(fresh)
        cells, most = ranks.written(fresh)
    # a cell of one value makes one row however often it occurs
    weight = F.when(F.col("first") == F.col("last"), F.lit(1)).otherwise(F.col("n"))
    order = Window.partitionBy(*keys).orderBy("first")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    zero = F.lit(0).cast("bigint")
    cut, about = recorded(leaves.withColumn("range", F.floor(F.coalesce(F.sum(weight).over(before), zero) / per_range))
                  .select(*keys, "node", "range", "first", weight.alias("weight"), *names,
                          *[F.coalesce(F.sum(c).over(before), zero).alias(f"before_{c}") for c in names],
                          *[F.sum(c).over(whole).alias(f"all_{c}") for c in names]), "ranges", rows=F.sum("weight"))
    n = max(1, -(-(about["rows"] or 0) // per_range))
    per = cut.groupBy(*keys, "range").agg(
        F.min("first").alias("first"), *[F.min(f"before_{c}").alias(f"before_{c}") for c in names],
        *[F.max(f"all_{c}").alias(f"all_{c}") for c in names])
    table = per.withColumn("next_first", F.lead("first").over(Window.partitionBy(*keys).orderBy("range"))).drop("first")
    named = join_checked(placed, cut.select(*keys, "node", "range"), [*keys, "node"], about["n"])
    values = ranks.counted(named, "range", "v").drop("n", "first", "last").repartition(n, *keys, "range")
    return values, table, n


def ordered_values(ranks: Ranks) -> DataFrame:
    """(keys..., v, next_v, past_*, all_*): every distinct value with the rows up to it, per class and side.

    One shuffle merges equal values, one deals ranges; the counts before a range come from the cells, so the running
    sums need no further one.
    """
    keys, names = list(ranks.keys), ranks.count_names
    values, table, n = ranges(ranks)
    in_range = Window.partitionBy(*keys, "range").orderBy("v")
    upto = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = values.select(*keys, "range", "v", F.lead("v").over(in_range).alias("lead_v"),
                          *[F.sum(c).over(upto).alias(f"past_{c}") for c in names])
    # a range holds RANGE_BYTES or ends its key
    return join_checked(local, table, [*keys, "range"], n + ranks.spans[1]).select(
        *keys, "v", F.coalesce("lead_v", "next_first").alias("next_v"),
        *[(F.col(f"before_{c}") + F.col(f"past_{c}")).alias(f"past_{c}") for c in names], *[f"all_{c}" for c in names])
