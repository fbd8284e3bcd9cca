"""Aggregates over simulations (sim, i, j, burn_time, flame_length, ...): all partial and final, no windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import ACRE_SQUARE_FEET


def burn_counts(sim_cells: DataFrame, band_minutes: float | None = None, last_minute: float | None = None) -> DataFrame:
    """How many simulations had burned each cell; with a width, by the clock of each band from 0 to ``last_minute``.

    Bands are cumulative: band k counts what burned up to minute k * width. Cells that no simulation reached are absent.
    Bands per cell are as many as the run has, whatever the number of simulations, which are counted before they meet.
    """
    burned = sim_cells.where("burn_time >= 0")
    if band_minutes is None:
        return burned.groupBy("i", "j").agg(F.count("*").alias("burn_count"))
    last = int(last_minute // band_minutes)
    at = F.ceil(F.col("burn_time") / band_minutes).alias("band")
    new = burned.where(F.col("burn_time") <= last * band_minutes).groupBy("i", "j", at).agg(F.count("*").alias("n"))
    return new.select("i", "j", "n", F.explode(F.sequence("band", F.lit(last).cast("long"))).alias("band")).groupBy("band", "i", "j").agg(F.sum("n").alias("burn_count"))


def burn_probability(sim_cells: DataFrame, n_sims: int | Column) -> DataFrame:
    n = n_sims if isinstance(n_sims, Column) else F.lit(float(n_sims))
    return burn_counts(sim_cells).withColumn("burn_probability", F.col("burn_count") / n)


def flame_sum_max(sim_cells: DataFrame) -> DataFrame:
    return sim_cells.groupBy("i", "j").agg(F.sum("flame_length").alias("flame_length_sum"), F.max("flame_length").alias("flame_length_max"))


def spot_counts(spots: DataFrame) -> DataFrame:
    return spots.groupBy("i", "j").agg(F.count("*").alias("spot_count"))


def snapshot(sim_cells: DataFrame, minute: float, value: str) -> DataFrame:
    """A layer as of a moment: 0 where the cell had not burned yet."""
    return sim_cells.withColumn(value, F.when(F.col("burn_time").between(0.0, minute), F.col(value)).otherwise(0.0))


def summary(sim_cells: DataFrame, cell_size: float, spots: DataFrame | None = None) -> DataFrame:
    """A row each simulation: sizes in acres by fire type, mean and population deviation of flame length and intensity, spots.

    fire_type: 1 surface, 2 and 3 crown. Means are over positive values, the number of positive flame lengths being what
    both sums are divided by; null if there are none. ``spots``: a row (sim, ...) for each spot ignition.
    """
    acres = cell_size * cell_size / ACRE_SQUARE_FEET

    def size(kind: Column) -> Column:
        return F.count_if(kind) * acres

    parts = {}
    for c in ("flame_length", "fire_line_intensity"):
        v = F.when(F.col(c) > 0, F.col(c))
        parts |= {f"{c}_n": F.count(v), f"{c}_avg": F.avg(v), f"{c}_var": F.var_pop(v)}
    sizes = {"surface_fire_size": size(F.col("fire_type") == 1), "crown_fire_size": size(F.col("fire_type") >= 2)}
    out = sim_cells.where("burn_time >= 0").groupBy("sim").agg(*(x.alias(n) for n, x in (sizes | parts).items()))
    n, stats = F.col("flame_length_n"), []
    for c in ("flame_length", "fire_line_intensity"):
        own = F.col(f"{c}_n")
        mean = F.try_divide(F.col(f"{c}_avg") * own, n)
        shift = F.col(f"{c}_avg") - mean
        stats += [mean.alias(f"{c}_mean"), F.sqrt(F.try_divide(own * (F.col(f"{c}_var") + shift * shift), n)).alias(f"{c}_stddev")]
    out = out.select("sim", (F.col("surface_fire_size") + F.col("crown_fire_size")).alias("fire_size"), *sizes, *stats)
    if spots is None:
        return out
    counts = spots.groupBy("sim").agg(F.count("*").alias("spot_count"))
    return out.join(counts, "sim", "left").withColumn("spot_count", F.coalesce("spot_count", F.lit(0)))


def first_of_best(spots: DataFrame) -> DataFrame:
    """Spot ignitions (sim, i, j, t, p) of one cell merged: the highest probability, of equal ones the earliest time."""
    best = F.max(F.struct("p", (-F.col("t")).alias("before"))).alias("m")
    return spots.groupBy("sim", "i", "j").agg(best).select("sim", "i", "j", (-F.col("m.before")).alias("t"), F.col("m.p").alias("p"))


def ignited_since(burn_time: Column, clock: Column) -> Column:
    """Whether a cell ignited after the clock's last step."""
    return clock < burn_time


def overtaken(probability_here: Column, probability: Column) -> Column:
    """Whether a fire of a probability goes over a cell that has only burned with a lower one."""
    return probability > probability_here
