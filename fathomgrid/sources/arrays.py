"""Sensor array configurations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARRAY_SCHEMA = (
    "name STRING, description STRING, center STRUCT<lat: DOUBLE, lon: DOUBLE>, "
    "x_deg DOUBLE, diameter_deg DOUBLE, positions ARRAY<ARRAY<DOUBLE>>"
)


def read_arrays(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """All array configurations below a folder, one row each, key column `config`."""
    return (spark.read.schema(ARRAY_SCHEMA)
            .option("multiLine", multi_line)
            .option("recursiveFileLookup", True)
            .json(path)
            .withColumnRenamed("name", "config"))


def positions(arrays: DataFrame, *more: Column) -> DataFrame:
    """(config, glider, lat, lon): one row per sensor, numbered as listed; more: further columns of its array."""
    at = F.get("p", 0).alias("lat"), F.get("p", 1).alias("lon")
    listed = arrays.select("config", *more, F.posexplode("positions").alias("glider", "p"))
    return listed.select("config", "glider", *at, *listed.columns[1:-2])


def load_positions(spark: SparkSession, path) -> DataFrame:
    """Sensor positions of every configuration file below path."""
    return positions(read_arrays(spark, path))


def hexagon_positions(centers: DataFrame) -> DataFrame:
    """Six sensors on a circle around each centre.

    centers: (config, lat, lon, diameter), degrees. The first sensor is due east.
    """
    return centers.select("config", F.inline(hexagon()))


def hexagon() -> Column:
    """The six sensors (glider, lat, lon) of a centre, as an array."""
    radius = F.col("diameter") / 2

    def sensor(glider: Column) -> Column:
        angle = glider * F.lit(2 * math.pi / 6)
        return F.struct(glider.alias("glider"), (F.col("lat") + radius * F.sin(angle)).alias("lat"),
                        (F.col("lon") + radius * F.cos(angle)).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(5)), sensor)
