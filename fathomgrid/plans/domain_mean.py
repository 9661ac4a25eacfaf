"""Time- and depth-mean velocity maps of the whole domain or around arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..grid import Grid
from ..operators.geometry import hull_bbox
from ..operators.summaries import abs_limit, domain_mean, map_rows
from ..sources.cells import crop, time_slice


def domain_maps(cells: DataFrame, grid: Grid, max_depth: float, time_range=None,
                window: dict | None = None) -> dict[str, DataFrame]:
    """Mean U, V, W maps and their symmetric limits; window crops by lon and lat."""
    if time_range is not None:
        cells = time_slice(cells, *time_range)
    rows = durable(map_rows(domain_mean(cells, grid, max_depth), grid), "domain-mean")
    if window:
        rows = crop(rows, **window)
    return {"maps": rows, "limits": abs_limit(rows.withColumnRenamed("value", "v"), ["variable"])}


def velocity_map(cells: DataFrame, grid: Grid, positions: DataFrame, max_depth: float = 70,
                 time_range=None, margin: float = 0.25) -> DataFrame:
    """The part of the mean maps around each array: (config, variable, iy, ix, lat, lon, value, bound).

    bound is the symmetric limit of the variable's whole map.
    """
    tables = domain_maps(cells, grid, max_depth, time_range)
    box = hull_bbox(positions, margin)
    near = (F.col("lon").between(F.col("lon_min"), F.col("lon_max"))
            & F.col("lat").between(F.col("lat_min"), F.col("lat_max")))
    lines = _boxed(tables["maps"], box)
    return (lines.filter(near).join(tables["limits"], "variable")
            .select("config", "variable", "iy", "ix", "lat", "lon", "value", "bound"))


def _boxed(maps: DataFrame, box: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Map points and array boxes that share a one-degree tile: an equi-join instead of a range join."""
    def tile(c):
        return F.floor(F.col(c) / cell_deg).cast("int")
    tiles = (box.withColumn("ty", F.explode(F.sequence(tile("lat_min"), tile("lat_max"))))
             .withColumn("tx", F.explode(F.sequence(tile("lon_min"), tile("lon_max")))))
    return maps.withColumns({"ty": tile("lat"), "tx": tile("lon")}).join(tiles, ["ty", "tx"])
