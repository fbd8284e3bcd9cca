"""A landscape over the driver tables: 40 by 40 cells from lineitem, hourly weather from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fuels import COLUMNS, fuel_models, model_rows, wui_synonyms

NUMBERS = [r[0] for r in model_rows()]

#: The same landscape as CTEs for the oracle.
CELLS = f"""
cells AS (
 SELECT i, j, elevation, slope, aspect, canopy_cover, canopy_height, canopy_height * 0.25e0 AS canopy_base_height,
  canopy_cover * 0.0001e0 AS bulk_density, list_extract([{", ".join(map(str, NUMBERS))}], fuel_ix + 1) AS model
 FROM (SELECT CAST(l_orderkey % 40 AS INT) AS i, CAST(l_partkey % 40 AS INT) AS j,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 10000e0) AS elevation,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100e0) AS slope,
  CAST(sum(CAST(round(l_quantity) AS BIGINT)) % 360 AS DOUBLE) AS aspect,
  CAST(sum(CAST(round(l_quantity) AS BIGINT)) * 2 AS DOUBLE) / count(*) AS canopy_cover,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) * 10 AS DOUBLE) / count(*) AS canopy_height,
  CAST((max(l_suppkey) * 7 + min(l_suppkey) * 13 + count(*)) % 58 AS INT) AS fuel_ix
  FROM lineitem GROUP BY 1, 2))"""
WEATHER = """
weather AS (
 SELECT b, bi, bj, temperature, relative_humidity, wind_speed_20ft, wind_from FROM (
  SELECT CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS INT) AS b, CAST((user_id % 16) // 4 AS INT) AS bi, CAST(user_id % 4 AS INT) AS bj,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) % 60 + 40 AS DOUBLE) AS temperature, CAST(sum(CAST(round(value * 100) AS BIGINT)) % 90 + 5 AS DOUBLE) AS relative_humidity,
  CAST(count(*) * 3 AS DOUBLE) AS wind_speed_20ft, CAST(sum(CAST(round(value * 100) AS BIGINT)) % 360 AS DOUBLE) AS wind_from
  FROM events GROUP BY 1, 2, 3))"""
#: The fuel dimension as CTE.
FUELS = "fuels AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}" if isinstance(v, int) else f"{v!r}e0" for v in r) + ")" for r in model_rows()) + ") AS t(" + ", ".join(COLUMNS) + "))"
#: Two ensembles: every line number is a simulation, its cells burn at times and lengths from the order line.
SIMS = """
sims AS (
 SELECT CAST(l_linenumber AS INT) AS sim, CAST(l_orderkey % 40 AS INT) AS i, CAST(l_partkey % 40 AS INT) AS j, CAST(min(l_suppkey) * 7 AS DOUBLE) AS burn_time,
  CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS flame_length, CAST(max(CAST(round(l_extendedprice) AS BIGINT)) AS DOUBLE) AS fire_line_intensity,
  CAST(min(l_suppkey) % 3 + 1 AS INT) AS fire_type
 FROM lineitem GROUP BY 1, 2, 3)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str, factor: int = 100):
    """Sums are taken over integers, so that no order of summing shows."""
    return F.sum(F.round(F.col(column) * factor).cast("bigint"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    base = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 40).cast("int").alias("i"), (F.col("l_partkey") % 40).cast("int").alias("j"))
    quantity = cents("l_quantity", 1)
    out = base.agg(
        (cents("l_extendedprice").cast("double") / (n * 10000.0)).alias("elevation"),
        (cents("l_discount").cast("double") / (n * 100.0)).alias("slope"),
        (quantity % 360).cast("double").alias("aspect"),
        ((quantity * 2).cast("double") / n).alias("canopy_cover"),
        ((cents("l_tax") * 10).cast("double") / n).alias("canopy_height"),
        ((F.max("l_suppkey") * 7 + F.min("l_suppkey") * 13 + n) % 58).cast("int").alias("_ix"),
    )
    numbers = F.array(*map(F.lit, NUMBERS))
    return out.select("*", (F.col("canopy_height") * 0.25).alias("canopy_base_height"), (F.col("canopy_cover") * 0.0001).alias("bulk_density"), F.element_at(numbers, F.col("_ix") + 1).alias("model")).drop("_ix")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 3.6e9).cast("int")
    grouped = table(spark, sf_dir, "events").groupBy(hour.alias("b"), F.floor((F.col("user_id") % 16) / 4).cast("int").alias("bi"), (F.col("user_id") % 4).cast("int").alias("bj"))
    total = cents("value")
    return grouped.agg(
        (total % 60 + 40).cast("double").alias("temperature"), (total % 90 + 5).cast("double").alias("relative_humidity"), (F.count("*") * 3).cast("double").alias("wind_speed_20ft"), (total % 360).cast("double").alias("wind_from")
    )


def fueled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with their fuel model's columns: a dimension of fixed size, joined by broadcast."""
    return cells(spark, sf_dir).join(F.broadcast(fuel_models(spark)), "model")


def sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("sim"), (F.col("l_orderkey") % 40).cast("int").alias("i"), (F.col("l_partkey") % 40).cast("int").alias("j"))
    return grouped.agg(
        (F.min("l_suppkey") * 7).cast("double").alias("burn_time"), cents("l_quantity", 1).cast("double").alias("flame_length"),
        F.max(F.round("l_extendedprice").cast("bigint")).cast("double").alias("fire_line_intensity"), (F.min("l_suppkey") % 3 + 1).cast("int").alias("fire_type"),
    )


def synonym_rows() -> str:
    return ", ".join(f"({v}, {o})" for v, o in wui_synonyms().items())
