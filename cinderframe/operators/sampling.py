"""Reproducible samples: every draw is a hash of its keys, so results do not depend on partitions, order or retries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) fixed by the seed and keys: the first 52 bits of their text's MD5, the same in any SQL engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def from_range(seed: int, low: float, high: float, *keys: Column) -> Column:
    return F.lit(low) + uniform(seed, *keys) * F.lit(high - low)


def from_list(seed: int, values: list, *keys: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.floor(uniform(seed, *keys) * len(values)).cast("int") + 1)


def drawn(seed: int, spec, *keys: Column) -> Column:
    """A parameter's sample: a tuple is a range, a list is chosen from, anything else is constant."""
    if isinstance(spec, tuple):
        return from_range(seed, *spec, *keys)
    return from_list(seed, spec, *keys) if isinstance(spec, list) else F.lit(spec)


def normal(seed: int, mean: float, deviation: float, *keys: Column) -> Column:
    """Box and Muller's transform of two uniform draws."""
    u, v = uniform(seed, *keys), uniform(seed + 1, *keys)
    return F.lit(mean) + deviation * F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(v * F.lit(6.283185307179586))


def lognormal(seed: int, mu: Column, sigma: Column, *keys: Column) -> Column:
    return F.exp(mu + sigma * normal(seed, 0.0, 1.0, *keys))


def poisson(seed: int, mean: float, *keys: Column) -> Column:
    """A Poisson count by inversion: how many of its cumulative probabilities one uniform draw reaches.

    The sum ends where the rest is below 1e-12, about mean + 8 deviations + 12: beyond what a double's draw can reach.
    """
    top, p, total, steps = int(mean + 8 * mean**0.5 + 12), math.exp(-mean), 0.0, []
    for k in range(top + 1):
        total += p
        steps.append(total)
        p *= mean / (k + 1)
    # The draw is an array of one, so that it is not taken again for every step.
    reached = F.transform(F.array(uniform(seed, *keys)), lambda u: F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= u)))
    return F.element_at(reached, 1).cast("int")


def between_draws(seed: int, low, high, *keys: Column) -> Column:
    """A draw between bounds that may be ranges (tuples) themselves."""
    lo, hi = (from_range(seed + k, *x, *keys) if isinstance(x, tuple) else F.lit(float(x)) for k, x in ((1, low), (2, high)))
    return lo + uniform(seed, *keys) * (hi - lo)


def start_time(ignited: Column, weather_began: Column) -> Column:
    """Minutes from the weather's first hour to ignition."""
    return (F.unix_micros(ignited.cast("timestamp")) - F.unix_micros(weather_began.cast("timestamp"))) / 1000.0 * 0.000016667


def started_at(minutes: Column, weather_began: Column) -> Column:
    """The time of ignition; minutes are cut off to milliseconds."""
    return F.timestamp_micros(F.unix_micros(weather_began.cast("timestamp")) + (minutes * 60000.0).cast("bigint") * 1000)


def bucket(*keys: Column) -> Column:
    """An arithmetic hash of coordinates into 1024 buckets, the same in any SQL engine."""
    total = F.lit(0).cast("bigint")
    for k, prime in zip(keys, (73856093, 19349663, 83492791)):
        total = total + k.cast("bigint") * prime
    return F.pmod(total, F.lit(BUCKETS))


def pixel_perturbation(low: float, high: float, *keys: Column) -> Column:
    """One value for each cell (and band); give constants as coordinates for one value a band."""
    return F.lit(low) + bucket(*keys) / float(BUCKETS - 1) * (high - low)


def smoothed_perturbation(low: float, high: float, step: float, i: Column, j: Column) -> Column:
    """Bilinear interpolation of perturbations on a coarser grid of ``step`` cells."""
    a, b = F.floor(i / step), F.floor(j / step)
    u, v = i / step - a, j / step - b
    at = lambda x, y: pixel_perturbation(low, high, a + x, b + y)
    return at(0, 0) * (1 - u) * (1 - v) + at(1, 0) * u * (1 - v) + at(0, 1) * (1 - u) * v + at(1, 1) * u * v


def ignition_sites(cells: DataFrame, n: int, ignitable: Column, seed: int) -> DataFrame:
    """n sites, one a simulation: the ignitable cells of the smallest draws. Fewer cells than n are used in turns.

    n is the number of simulations: the top-k and its one window hold as many rows.
    """
    found = cells.where(ignitable).select("i", "j", uniform(seed, F.col("i"), F.col("j")).alias("_h"))
    few = found.orderBy("_h", "i", "j").limit(n)
    ranked = few.withColumns({"_r": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", "i", "j")) - 1, "_n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    turns = ranked.select("i", "j", F.explode(F.sequence(F.col("_r"), F.lit(n - 1), F.col("_n").cast("int"))).alias("sim"))
    return turns.select(F.col("sim").cast("int").alias("sim"), "i", "j")


def firebrands(sources: DataFrame, seed: int, mean_brands: float, keys: list[str]) -> DataFrame:
    """Sources (keys, mu, sigma, sigma_across in feet) once for each of their firebrands: brand, along and across (feet).

    Their number is a Poisson draw, the distance along the wind lognormal (metres to feet), that across it normal.
    """
    own = [F.col(k) for k in keys]
    # Sources without firebrands go with their null: a filter on the draw would move below an aggregate by the keys, to each of its rows.
    brands = F.when(F.col("_n") > 0, F.sequence(F.lit(1), F.col("_n")))
    thrown = sources.withColumn("_n", poisson(seed, mean_brands, *own)).withColumn("brand", F.explode(brands)).drop("_n")
    own.append(F.col("brand"))
    along = lognormal(seed + 10, F.col("mu"), F.col("sigma"), *own) * 3.281
    across = normal(seed + 20, 0.0, 1.0, *own) * F.col("sigma_across") * 3.281
    return thrown.withColumns({"along": along, "across": across})
