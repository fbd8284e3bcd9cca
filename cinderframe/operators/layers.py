"""Layers of a run as rows (layer, b, i, j, v) in internal units, whatever source each comes from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units


def layer(cells: DataFrame, name: str, value: str, unit: str | None = None, multiplier: float = 1.0, rotate: float | None = None) -> DataFrame:
    """One layer of a table with i, j and perhaps b (the band, else 0), converted to internal units."""
    band = F.col("b").cast("int") if "b" in cells.columns else F.lit(0)
    kind = next((k for k in ("temperature", "relative_humidity", "fuel_moisture", "foliar_moisture") if name.startswith(k)), name)
    v = units.layer_value(F.col(value).cast("double"), kind, unit, multiplier, rotate)
    return cells.select(F.lit(name).alias("layer"), band.alias("b"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), v.alias("v"))


def stacked(*layers: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, layers)


def ignition_mask(cells: DataFrame, value: str, burned: float = 1.0, unburned: float = 0.0) -> DataFrame:
    """A layer that says where fire starts, from whatever numbers stand for it: 1 there, 0 elsewhere, others left out."""
    mark = F.when(F.col(value) == burned, 1.0).when(F.col(value) == unburned, 0.0)
    return cells.select("i", "j", mark.alias("v")).where("v IS NOT NULL")


def per_simulation(fixed: DataFrame, draws: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Each simulation's own value of each parameter: that of the layer at its ignition cell and hour where there is one
    (``fixed``: param, b, i, j, v), else its draw. ``draws``: sim, i, j, b and what ``columns`` are worked out from."""
    names = list(columns)
    long = draws.select("sim", "i", "j", "b", *(c.alias(n) for n, c in columns.items())).unpivot(["sim", "i", "j", "b"], names, "param", "drawn")
    both = long.join(fixed, ["param", "b", "i", "j"], "left")
    return both.select("sim", "param", F.coalesce("v", "drawn").alias("v"))


def planar(n_rows: int, n_cols: int, degrees: float, cell: float, spark) -> DataFrame:
    """A plane that rises to the east at an angle: an elevation layer for trials."""
    n = spark.range(n_rows * n_cols)
    j = F.col("id") % n_cols
    return n.select(F.expr(f"id div {n_cols}").cast("int").alias("i"), j.cast("int").alias("j"), (j * cell * F.tan(F.radians(F.lit(degrees)))).alias("v"))
