"""Suppression of fire fronts: angular slices around each fire's centre and the stretches of front between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import containment


def centroids(cells: DataFrame) -> DataFrame:
    """(sim, ci, cj): the mean of each fire's distinct cells, cut off to a cell."""
    return cells.select("sim", "i", "j").distinct().groupBy("sim").agg(F.avg("i").cast("long").alias("ci"), F.avg("j").cast("long").alias("cj"))


def slices(vectors: DataFrame, size: float = 5.0) -> DataFrame:
    """(sim, slice, rate, n): mean spread rate and number of distinct cells of burn vectors (sim, i, j, spread_rate).

    Every slice of the circle is there, those without vectors with 0 and 0. Slice 0 begins in the east, clockwise.
    """
    centre = centroids(vectors)
    theta = containment.bearing(F.col("i"), F.col("j"), F.col("ci"), F.col("cj"))
    placed = vectors.join(centre, "sim").withColumn("slice", containment.slice_of(theta, size).cast("int"))
    # distinct cells in two steps, so that a fire's vectors never meet in one place
    per = placed.groupBy("sim", "slice", "i", "j").agg(F.sum("spread_rate").alias("s"), F.count("*").alias("m")).groupBy("sim", "slice").agg(F.sum("s").alias("s"), F.sum("m").alias("m"), F.count("*").alias("n"))
    every = centre.select("sim", F.explode(F.sequence(F.lit(0), F.lit(round(360.0 / size) - 1))).alias("slice"))
    out = every.join(per, ["sim", "slice"], "left")
    return out.select("sim", "slice", F.coalesce(F.col("s") / F.col("m"), F.lit(0.0)).alias("rate"), F.coalesce("n", F.lit(0)).alias("n"))


def segments(slices_: DataFrame, needed: int, size: float = 5.0) -> DataFrame:
    """(sim, first, length, rate, n): for each slice with cells the shortest stretch from there on, clockwise around, that
    holds ``needed`` cells; it ends earlier where a slice without cells follows, and never goes round more than once.

    ``rate``: the mean over its cells. A fire has as many slices as the circle, so windows hold few rows each.
    """
    around = round(360.0 / size)
    twice = slices_.select("*", F.explode(F.array(F.lit(0), F.lit(around))).alias("turn")).withColumn("at", F.col("slice") + F.col("turn"))
    ahead = F.collect_list(F.struct("n", "rate")).over(Window.partitionBy("sim").orderBy("at").rowsBetween(0, around - 1))
    start = F.struct(F.lit(0).alias("length"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(False).alias("done"))

    def step(acc, x):
        done = acc["done"] | (acc["n"] >= needed) | (x["n"] == 0)
        grown = F.struct((acc["length"] + 1).alias("length"), (acc["n"] + x["n"]).alias("n"), (acc["total"] + x["n"] * x["rate"]).alias("total"), F.lit(False).alias("done"))
        return F.when(done, F.struct(acc["length"].alias("length"), acc["n"].alias("n"), acc["total"].alias("total"), F.lit(True).alias("done"))).otherwise(grown)

    found = twice.withColumn("s", F.aggregate(ahead, start, step)).where("turn = 0 AND n > 0")
    return found.select("sim", F.col("slice").alias("first"), F.col("s.length").alias("length"), (F.col("s.total") / F.col("s.n")).alias("rate"), F.col("s.n").alias("n"))


def chosen(slices_: DataFrame, needed: int, size: float = 5.0) -> DataFrame:
    """(sim, slice): slices to suppress. Stretches go by rate, the slowest first (of equal ones the first around), until
    their slices hold ``needed`` cells; of the last one only the slices from its beginning on that are still needed.

    Each fire's stretches are as few as the circle's slices; running sums over them replace a loop.
    """
    around = round(360.0 / size)
    order = Window.partitionBy("sim").orderBy("rate", "first")
    ranked = segments(slices_, needed, size).withColumn("place", F.row_number().over(order))
    each = ranked.select("sim", "place", "first", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("k"))
    each = each.withColumn("slice", (F.col("first") + F.col("k")) % around)
    once = each.groupBy("sim", "slice").agg(F.min(F.struct("place", "k")).alias("m")).select("sim", "slice", "m.place", "m.k")
    counted = once.join(slices_.select("sim", "slice", "n"), ["sim", "slice"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sim").orderBy("place", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("before", before).where(F.col("before") < needed).select("sim", "slice")


def mean_index(burned: DataFrame, index: DataFrame, value: str) -> DataFrame:
    """(sim, mean): the mean difficulty of the cells that each fire burned, by the layer's own (i, j, value)."""
    return burned.select("sim", "i", "j").join(index.select("i", "j", value), ["i", "j"]).groupBy("sim").agg(F.avg(value).alias("mean"))
