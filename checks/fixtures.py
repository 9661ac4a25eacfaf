"""Inputs of the registered queries, derived from the driver's tables.

No measured fields exist among them, so a cell table is gridded from lineitem: a snapshot
per thousand order keys, seven levels and an 8 x 8 grid, each cell the average of its
lines. The number of snapshots, and with it all work, grows with the table. A few cells
get the fill value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.grid import Grid
from fathomgrid.model import EARTH_RADIUS_M
from fathomgrid.sources.arrays import hexagon_positions
from fathomgrid.sources.cells import load_model

MAX_DEPTH, DZ = 10, 2
SHALLOW = 6
DEEP = 14  # below the deepest level
DIGITS = 9  # decimals of the values in histograms of fields
GRID_N, LEVELS = 8, 7
CELL_EDGE = EARTH_RADIUS_M * math.radians(1) / 24

RAW_CELLS = """
select cast(36 * (floor(l_orderkey / 1000) + 1) as int) as iter,
       cast(1 + (l_orderkey + l_linenumber) % 7 as int) as iz,
       cast(l_partkey % 8 as int) as iy, cast(l_suppkey % 8 as int) as ix,
       avg(l_quantity) / 50e0 - 0.5e0 as UVEL, avg(l_discount) * 10e0 - 0.5e0 as VVEL,
       avg(l_extendedprice) / 10000e0 + 20e0 as THETA, 34e0 + avg(l_tax) * 20e0 as SALT,
       avg(cast(l_orderkey % 1000 as double)) / 1000e0 - 0.5e0 as WVEL
from lineitem group by 1, 2, 3, 4
"""

FILLED_CELLS = """
select iter, iz, iy, ix,
       case when (7 * iter + 5 * iz + 3 * iy + ix) % 211 = 0 then -999e0 else UVEL end as UVEL,
       VVEL,
       case when (5 * iter + 7 * iz + iy + 3 * ix) % 223 = 0 then -999e0 else THETA end as THETA,
       SALT,
       case when (3 * iter + iz + 5 * iy + 7 * ix) % 227 = 0 then -999e0 else WVEL end as WVEL
from raw_cells
"""

# A second gridding without fill values, coarse enough in time to have no empty cell.
FULL_CELLS = RAW_CELLS.replace("/ 1000) + 1", "/ 1250) + 1")

# One array per customer: a circle of sensors somewhere in a 2 x 2 degree area.
CENTERS = """
select 'c' || c_custkey as config, (c_custkey * 37 % 1000) / 1000e0 * 2 - 1 as lat,
       219 + (c_custkey * 91 % 2000) / 1000e0 as lon, 0.25e0 * (1 + c_nationkey % 4) as diameter
from customer
"""

# One irregular array per customer: a sensor per order.
SCATTERED = """
select 'c' || o_custkey as config, cast(o_orderkey as int) as glider,
       (o_orderkey * 7919 % 10007) / 10007e0 - 0.5e0 as lat,
       220 + (o_orderkey * 104729 % 10009) / 10009e0 - 0.5e0 as lon
from orders
"""

# The same for customers with three orders or more, which span an area.
IRREGULAR = """
select 'c' || o_custkey as config, cast(o_orderkey as int) as glider,
       (o_orderkey * 7919 % 10007) / 10007e0 - 0.5e0 as lat,
       220 + (o_orderkey * 104729 % 10009) / 10009e0 - 0.5e0 as lon
from (select o_custkey, o_orderkey, count(*) over (partition by o_custkey) as n from orders) as o
where n >= 3
"""

# Depth requests: one per part.
DEPTHS = """
select p_partkey as part, cast(10 + p_size % 50 as double) as max_depth,
       cast(1 + p_partkey % 4 as double) as dz from part
"""

# Coordinates to look up: one per order, on one of the six axes, some outside it.
TARGETS = """
select o_orderkey, axis, case when axis in ('Z', 'Zl') then -14 * u + 1
                              when axis in ('XC', 'XG') then 220 + 0.4e0 * (u - 0.5e0)
                              else 0.4e0 * (u - 0.5e0) end as pos
from (select o_orderkey, case o_orderkey % 6 when 0 then 'XC' when 1 then 'XG' when 2 then 'YC'
                                             when 3 then 'YG' when 4 then 'Z' else 'Zl' end as axis,
             (o_orderkey * 7919 % 10007) / 10007e0 as u from orders) as o
"""

# Sensor samples from events: day, sensor and level, complete from 10,000 events on.
EVENT_SAMPLES = """
select 'circle' as config, date_trunc('day', ts) as time, cast(user_id % 6 as int) as glider,
       cast(case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2
                            when 'signup' then 3 else 4 end as int) as k,
       avg(value) / 100e0 as U, avg(cast(event_id % 97 as double)) / 97e0 as V
from events group by 1, 2, 3, 4
"""

# The same with many levels per day and sensor, some of whose values are missing.
EVENT_SERIES = """
select 'circle' as config, date_trunc('day', ts) as time, cast(user_id % 6 as int) as glider,
       cast(extract(hour from ts) as int) as k,
       avg(case when event_id % 7 < 6 or extract(hour from ts) < 12 then value end) / 100e0 as U,
       max(case when event_id % 7 < 6 or extract(hour from ts) < 12 then value end) / 500e0 as V
from events group by 1, 2, 3, 4
"""

# Values that are missing, not a number or infinite among ordinary ones.
MESSY = """
select event_id, case when event_id % 17 = 0 then cast('NaN' as double) when event_id % 19 = 0 then null else value end as x,
       case when event_id % 23 = 0 then cast('Infinity' as double) when event_id % 29 = 0 then cast('-Infinity' as double)
            else value * 2 end as y
from events
"""

# Two populations per line status; T is nearly continuous, S, U and V are full of ties.
POPULATIONS = """
select l_linestatus as config, case when l_returnflag = 'R' then 'obs' else 'true' end as side,
       l_extendedprice as T, l_quantity as S, l_discount as U, l_tax as V,
       l_orderkey, l_linenumber, cast(l_linenumber * 2 as double) as depth
from lineitem
"""


def sql(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    """Run one of the texts above over a table of the test data."""
    return spark.sql(text.replace(f"from {name}", "from {src}"), src=table(spark, sf_dir, name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = sql(spark, sf_dir, RAW_CELLS, "lineitem")
    return spark.sql(FILLED_CELLS.replace("from raw_cells", "from {raw_cells}"), raw_cells=raw)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with time stamps and fill values turned into NULL."""
    return load_model(raw_cells(spark, sf_dir)).drop("iter")


def full_raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, FULL_CELLS, "lineitem")


def full_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_model(full_raw_cells(spark, sf_dir)).drop("iter")


def wide_grid(spark: SparkSession) -> Grid:
    """Tracer axes of a 4 x 4 degree area, for the many arrays of CENTERS."""
    i = F.col("id").cast("int")
    return Grid(spark.range(96).select(F.inline(F.array(
        F.struct(F.lit("XC").alias("axis"), i.alias("idx"), (F.lit(218.0) + (i + 0.5) / 24).alias("pos")),
        F.struct(F.lit("YC").alias("axis"), i.alias("idx"), ((i + 0.5) / 24 - 2.0).alias("pos"))))))


def circle(spark: SparkSession) -> DataFrame:
    """Sensors of the event samples."""
    return hexagon_positions(spark.sql(
        "select 'circle' as config, 0e0 as lat, 220e0 as lon, 0.25e0 as diameter"))


def axes(spark: SparkSession) -> DataFrame:
    i = F.col("id").cast("int")

    def lines(**pos):
        return F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), i.alias("idx"), p.alias("pos"))
                                  for a, p in pos.items()]))

    centre, edge = (i - 3.5) / 24, (i - 4.0) / 24
    across = spark.range(GRID_N).select(
        lines(XC=F.lit(220.0) + centre, XG=F.lit(220.0) + edge, YC=centre, YG=edge))
    down = spark.range(1, LEVELS + 1).select(lines(Z=F.lit(0.9) - i * 1.7, Zl=(F.lit(1.0) - i) * 1.7))
    return across.unionByName(down)


def metrics(spark: SparkSession) -> DataFrame:
    edge = F.lit(CELL_EDGE)
    iy, ix = F.floor(F.col("id") / GRID_N).cast("int"), (F.col("id") % GRID_N).cast("int")
    return (spark.range(GRID_N * GRID_N).select(iy.alias("iy"), ix.alias("ix"))
            .withColumns({"dxG": edge * F.cos(F.radians((F.col("iy") - 4) / 24)), "dyG": edge + 0,
                          "rA": edge * edge * F.cos(F.radians((F.col("iy") - 3.5) / 24))}))


def grid(spark: SparkSession) -> Grid:
    """The grid of the cell table, made anew for every query."""
    return Grid(axes(spark), metrics(spark))


def positions(spark: SparkSession) -> DataFrame:
    """Two arrays: a hexagon, and a rectangle with two sensors halfway along its sides."""
    hexagon = hexagon_positions(spark.sql(
        "select 'hexagon' as config, 0e0 as lat, 220e0 as lon, 0.2e0 as diameter"))
    rect = spark.sql("""select 'rect' as config, cast(glider as int) as glider, lat, lon from values
        (0, 0e0, 219.9e0), (1, 0e0, 220.1e0), (2, -0.1e0, 219.9e0),
        (3, -0.1e0, 220.1e0), (4, 0.1e0, 219.9e0), (5, 0.1e0, 220.1e0) as p(glider, lat, lon)""")
    return hexagon.unionByName(rect)


def wide_positions(spark: SparkSession) -> DataFrame:
    """The two arrays, one that reaches over the edge of the grid, and one beyond it."""
    more = spark.sql("""select config, cast(glider as int) as glider, lat, lon from values
        ('edge', 0, 0.1e0, 220.1e0), ('edge', 1, 0.1e0, 220.3e0), ('edge', 2, -0.05e0, 220.05e0),
        ('far', 0, 5.0e0, 225.0e0), ('far', 1, 5.1e0, 225.2e0), ('far', 2, 4.9e0, 225.1e0) as p(config, glider, lat, lon)""")
    return positions(spark).unionByName(more)
