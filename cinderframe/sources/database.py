"""Rasters kept as rows in a database: read in parallel by row ranges, filters and columns pushed down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid


def read_raster(spark: SparkSession, url: str, table: str, n_rows: int, parts: int = 8, rescale: int | None = None, threshold: float | None = None, **options: str) -> DataFrame:
    """(b, i, j, v) of a table with these columns. ``parts`` connections read a range of rows each.

    ``threshold``: smaller values count as 0, as a mask has them. ``rescale``: cells to a side of a coarser one, which
    takes the mean. ``options`` go to the reader (driver, user, password, fetchsize).
    """
    cells = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="i", lowerBound="0", upperBound=str(max(n_rows, 1)), numPartitions=str(parts), **options).load()
    cells = cells.select(*(F.col(c).alias(c.lower()) for c in cells.columns)).select(F.col("b").cast("int"), F.col("i").cast("int"), F.col("j").cast("int"), F.col("v").cast("double"))
    if threshold is not None:
        cells = cells.withColumn("v", F.when(F.col("v") >= threshold, F.col("v")).otherwise(0.0))
    return cells if rescale is None else grid.rescaled(cells, "v", rescale, ["b"])


def metadata(cells: DataFrame) -> DataFrame:
    """(b, rows, cols, low, high) of each band."""
    return cells.groupBy("b").agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"), F.min("v").alias("low"), F.max("v").alias("high"))
