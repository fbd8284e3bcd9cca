"""Scoring simulated against observed burns: pairs of snapshots, confusion counts, quantiles, weighted scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_pairs(snapshots: DataFrame, least_minutes: float, most_minutes: float) -> DataFrame:
    """Consecutive snapshots (fire, t) of one fire whose lapse lies within bounds."""
    w = Window.partitionBy("fire").orderBy("t")
    pairs = snapshots.select("fire", F.col("t").alias("t0"), F.lead("t").over(w).alias("t1")).where("t1 IS NOT NULL")
    lapse = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 60e6
    return pairs.withColumn("lapse", lapse).where(F.col("lapse").between(least_minutes, most_minutes))


def confusion(cells: DataFrame, keys: list[str], simulated: Column, observed: Column) -> DataFrame:
    """Counts of cells burned in both, only simulated, only observed."""
    return cells.groupBy(*keys).agg(
        F.count_if(simulated & observed).alias("both"), F.count_if(simulated & ~observed).alias("sim_minus_real"), F.count_if(~simulated & observed).alias("real_minus_sim")
    )


def quantiles(cells: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Percentiles without nulls and NaNs, between the values at place p / 100 * (n + 1) and its neighbours, kept inside.

    Values are counted before they are ordered, so a group meets as its distinct values.
    """
    counted = cells.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    upto = counted.withColumns({"_upto": F.sum("_c").over(w.orderBy("_v")), "_n": F.sum("_c").over(w)})
    out = []
    for p in percents:
        place = F.greatest(F.lit(1.0), F.least(F.col("_n").cast("double"), F.lit(p / 100.0) * (F.col("_n") + 1)))
        low = F.floor(place)
        out += [F.min(F.when(F.col("_upto") >= low, F.col("_v"))).alias(f"_a{p}"), F.min(F.when(F.col("_upto") >= F.least(low + 1, F.col("_n")), F.col("_v"))).alias(f"_b{p}"), F.first(place - low).alias(f"_f{p}")]
    found = upto.groupBy(*keys).agg(*out)
    return found.select(*keys, *((F.col(f"_a{p}") + F.col(f"_f{p}") * (F.col(f"_b{p}") - F.col(f"_a{p}"))).alias(f"p{p}") for p in percents))


def arrival_ratios(cells: DataFrame, keys: list[str], simulated: Column, observed: Column, lapse: Column) -> DataFrame:
    """Mean and percentiles of time of arrival over the lapse, on cells burned in both whose time is positive."""
    ratio = F.when(simulated & observed & (F.col("burn_time") > 0), F.col("burn_time") / lapse)
    rated = cells.withColumn("_ratio", ratio)
    return rated.groupBy(*keys).agg(F.avg("_ratio").alias("mean")).join(quantiles(rated, keys, "_ratio", [50, 75, 90, 95]), keys, "left")


def smallest_hashes(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """A stable sample: the k rows of smallest hash of their keys, the same in any order and on any cluster."""
    return rows.withColumn("pair_hash", F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in keys)))).orderBy("pair_hash").limit(k)


def variations(scores: DataFrame, preferred_hours: float) -> DataFrame:
    """(variation, n, failed, over, under): replays counted, failed ignitions, and shares of the really burned cells that
    were burned too much and too little, weighted in favour of a lapse. Needs variation, hours, real, both, sim_minus_real, real_minus_sim."""
    weight = lapse_weight(F.lit(preferred_hours), F.col("hours"))
    share = {c: F.when(F.col("real") == 0, 0.0).otherwise(F.col(c) / F.nullif("real", F.lit(0))) for c in ("sim_minus_real", "real_minus_sim")}
    failed = F.count_if(F.col("both") + F.col("sim_minus_real") == 0)
    avg = lambda c: F.try_divide(F.sum(weight * share[c]), F.sum(weight))
    return scores.groupBy("variation").agg(F.count("*").alias("n"), failed.alias("failed"), avg("sim_minus_real").alias("over"), avg("real_minus_sim").alias("under"))


def lapse_weight(preferred: Column, lapse: Column) -> Column:
    """A gamma density of shape 3 with its mode at the preferred lapse, up to a factor."""
    x = lapse / (preferred / 2.0)
    return x * x * F.exp(-x)


def weighted_scores(rows: DataFrame, keys: list[str], weight: Column, values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.try_divide(F.sum(weight * F.col(v)), F.sum(weight)).alias(v) for v in values))


def merged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of the same replays from two runs beside each other; ``second`` fills in and goes before where both have one."""
    a, b = (x.select(*keys, F.struct(*(F.col(c) for c in x.columns if c not in keys)).alias(n)) for x, n in ((first, "_a"), (second, "_b")))
    names = [c for c in dict.fromkeys([*first.columns, *second.columns]) if c not in keys]
    pick = lambda c: [F.col(f"{n}.{c}") for x, n in ((second, "_b"), (first, "_a")) if c in x.columns]
    return a.join(b, keys, "full").select(*keys, *(F.coalesce(*pick(c)).alias(c) for c in names))
