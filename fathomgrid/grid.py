"""The staggered model grid: one-dimensional axes and two-dimensional cell metrics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from threading import RLock

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable, small_enough


@dataclass
class Grid:
    """axes: (axis, idx, pos), any order within an axis; metrics: (iy, ix, dyG, dxG, rA).

    Neighbouring nodes of each axis form spans. Spans are filed under strips as wide as
    the axis' mean spacing, so finding the span around a coordinate is an equi-join on
    (axis, strip) rather than a range join. The span table is written once per grid.
    """

    axes: DataFrame
    metrics: DataFrame | None = None
    _tables: dict = field(default_factory=dict, repr=False)
    _lock: RLock = field(default_factory=RLock, repr=False)

    def once(self, key, make):
        """A small result that depends on the grid alone, made on first use."""
        with self._lock:  # threads of one plan share a grid
            if key not in self._tables:
                self._tables[key] = make()
            return self._tables[key]

    @cached_property
    def extents(self) -> dict[str, tuple[float, float, float]]:
        """First node, last node and mean spacing of each of the (at most six) axes."""
        rows = self.axes.groupBy("axis").agg(
            F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("pos").alias("n")).collect()
        return {r["axis"]: (r["lo"], r["hi"], (r["hi"] - r["lo"]) / max(r["n"] - 1, 1) or 1.0) for r in rows}

    def strip(self, axis: str, pos: Column) -> Column:
        """Number of the strip a coordinate falls into."""
        if axis not in self.extents:
            return F.lit(None).cast("int")
        lo, _, step = self.extents[axis]
        return F.floor((pos - F.lit(lo)) / F.lit(step)).cast("int")

    def strip_by(self, axis: Column, pos: Column) -> Column:
        """Same, for rows that name their axis in a column."""
        found = F.lit(None).cast("int")
        for name in sorted(self.extents):
            found = F.when(axis == name, self.strip(name, pos)).otherwise(found)
        return found

    @cached_property
    def spans(self) -> DataFrame:
        """(s_axis, s_strip, i0, x0, i1, x1, last): each span once per strip it touches."""
        order = Window.partitionBy("axis").orderBy("pos")  # one axis: at most its node count
        nodes = self.axes.select(
            "axis", F.col("idx").alias("i0"), F.col("pos").alias("x0"),
            F.lead("idx").over(order).alias("i1"), F.lead("pos").over(order).alias("x1"))
        high = F.lit(None).cast("double")
        for name, (_, hi, _) in sorted(self.extents.items()):
            high = F.when(F.col("axis") == name, F.lit(hi)).otherwise(high)
        a = F.col("axis")
        spans = nodes.filter(F.col("x1").isNotNull()).select(
            a.alias("s_axis"),
            F.explode(F.sequence(self.strip_by(a, F.col("x0")), self.strip_by(a, F.col("x1")))).alias("s_strip"),
            "i0", "x0", "i1", "x1", (F.col("x1") == high).alias("last"))
        return durable(spans, "spans")

    @cached_property
    def _spans_side(self) -> DataFrame:
        return F.broadcast(self.spans) if small_enough(self.spans, self.spans.count()) else self.spans

    def around(self, df: DataFrame, axis: str, strip: str, pos: str) -> DataFrame:
        """df with the span around each coordinate; rows outside the axis are dropped.

        axis, strip and pos are column names of df.
        """
        x = F.col(pos)
        here = (x >= F.col("x0")) & ((x < F.col("x1")) | (F.col("last") & (x == F.col("x1"))))
        return (df.join(self._spans_side, (F.col(axis) == F.col("s_axis")) & (F.col(strip) == F.col("s_strip")))
                .filter(here).drop("s_axis", "s_strip", "last"))

    def interpolated(self, df: DataFrame, axis: str, strip: str, pos: str, idx: str, w: str, n: str) -> DataFrame:
        """df with one row per contributing node: its index, linear weight, and how many there are.

        A coordinate on a node uses that node alone.
        """
        part = (F.col(pos) - F.col("x0")) / (F.col("x1") - F.col("x0"))
        pair = F.array(F.struct(F.col("i0").alias(idx), (F.lit(1.0) - F.col("_p")).alias(w)),
                       F.struct(F.col("i1").alias(idx), F.col("_p").alias(w)))
        number = (F.col("_p") != 1).cast("int") + (F.col("_p") != 0).cast("int")
        spans = self.around(df, axis, strip, pos).withColumn("_p", part)
        return (spans.select(*df.columns, number.alias(n), F.inline(pair)).filter(F.col(w) != 0))

    def nodes(self, axis: str, idx: str, pos: str) -> DataFrame:
        """One axis as (idx, pos) under the given names."""
        return self.axes.filter(F.col("axis") == axis).select(F.col("idx").alias(idx), F.col("pos").alias(pos))
