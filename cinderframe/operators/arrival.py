"""When fronts reach the cells beside those that burn: one step of spread, as joins.

A front crosses half the way at the source cell's rate and half at the target's. Stepping on and on through time is the
work of a simulator, which this library is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import surface
from . import grid

#: Headings of the eight moves, clockwise from north; rows grow to the south.
HEADINGS = {(-1, 0): 0, (-1, 1): 45, (0, 1): 90, (1, 1): 135, (1, 0): 180, (1, -1): 225, (0, -1): 270, (-1, -1): 315}


def moves(cells: DataFrame, cell_size: float) -> DataFrame:
    """(i, j, to_i, to_j, minutes) between burnable neighbours. ``cells``: elevation and the columns of the maximum spread."""
    rates = {"elevation": "z", "max_rate": "r", "max_direction": "d", "eccentricity": "e"}
    own = cells.select("i", "j", *(F.col(c).alias(n) for c, n in rates.items())).where("r > 0")
    pairs = grid.neighbours(own, own, {"z": "z2", "r": "r2", "d": "d2", "e": "e2"})
    heading = F.lit(0)
    for (di, dj), degrees in HEADINGS.items():
        heading = F.when((F.col("di") == di) & (F.col("dj") == dj), degrees).otherwise(heading)
    rise = F.col("z2") - F.col("z")
    distance = F.sqrt((F.col("di") * F.col("di") + F.col("dj") * F.col("dj")) * F.lit(cell_size * cell_size) + rise * rise)
    out = pairs.withColumns({"_h": heading.cast("double"), "_d": distance})
    first = surface.rate_towards(F.col("r"), F.col("d"), F.col("e"), F.col("_h"))
    second = surface.rate_towards(F.col("r2"), F.col("d2"), F.col("e2"), F.col("_h"))
    minutes = F.col("_d") * 0.5 / first + F.col("_d") * 0.5 / second
    return out.select("i", "j", (F.col("i") + F.col("di")).alias("to_i"), (F.col("j") + F.col("dj")).alias("to_j"), minutes.alias("minutes"))


def next_arrivals(burned: DataFrame, edges: DataFrame) -> DataFrame:
    """(sim, i, j, arrives): the earliest time at which a front from burned cells (sim, i, j, burn_time) enters each neighbour."""
    reached = burned.select("sim", "i", "j", "burn_time").join(edges, ["i", "j"])
    return reached.groupBy("sim", F.col("to_i").alias("i"), F.col("to_j").alias("j")).agg(F.min(F.col("burn_time") + F.col("minutes")).alias("arrives"))
