"""Maps from ranges of integers (lo, hi inclusive, v, pos) to values: lookup, overlap, merging and filling.

Ranges and keys meet by an equi-join on bins of ``width`` numbers: a range lies in every bin it touches, a key in one.
Spark picks how to join from the tables' sizes; the result is the same whatever it picks. Keys may be fractions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(x: Column, width: int) -> Column:
    return F.floor(x / width).cast("long")


def binned(intervals: DataFrame, width: int, lo: str = "lo", hi: str = "hi", name: str = "_bin") -> DataFrame:
    """Ranges once for every bin they touch; those with hi below lo touch none."""
    ranges = intervals.where(F.col(lo) <= F.col(hi))
    return ranges.withColumn(name, F.explode(F.sequence(bin_of(F.col(lo), width), bin_of(F.col(hi), width))))


def lookup(rows: DataFrame, key: str, intervals: DataFrame, value: str = "v", width: int = 64) -> DataFrame:
    """The value of the first interval, by pos and then lo, hi and value, that holds the key; null if none does."""
    keys = rows.select(F.col(key).alias("_key")).distinct().withColumn("_bin", bin_of(F.col("_key"), width))
    hit = keys.join(binned(intervals, width), "_bin").where(F.col("_key").between(F.col("lo"), F.col("hi")))
    first = hit.groupBy("_key").agg(F.min(F.struct("pos", "lo", "hi", value)).alias("_first")).select("_key", F.col(f"_first.{value}").alias(value))
    return rows.join(first, rows[key] == first["_key"], "left").drop("_key")


def combine(a: DataFrame, b: DataFrame, width: int = 64) -> DataFrame:
    """Overlaps of two interval maps, with both values. Ranges that share several bins meet in the first of them."""
    x, y = a.select("lo", "hi", F.col("v").alias("v1")), b.select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("v").alias("v2"))
    hit = binned(x, width).join(binned(y, width, "lo2", "hi2"), "_bin").where((F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi")))
    hit = hit.where(F.col("_bin") == bin_of(F.greatest("lo", "lo2"), width))
    return hit.select(F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi"), "v1", "v2")


def merge_adjacent(intervals: DataFrame) -> DataFrame:
    """Runs of touching intervals of one value become one."""
    w = Window.partitionBy("v").orderBy("lo")
    new = F.when(F.lag("hi").over(w) + 1 == F.col("lo"), 0).otherwise(1)
    run = intervals.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return run.groupBy("v", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi", "v")


def fill_gaps(intervals: DataFrame, lo: int, hi: int, default: float) -> DataFrame:
    """Add intervals of the default value wherever none lies between lo and hi.

    Intervals do not overlap, so there are at most hi - lo + 1 of them: that bounds the one window that orders them.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("lo")
    edged = intervals.select("lo", "hi", "v", F.coalesce(F.lead("lo").over(w), F.lit(hi + 1)).alias("next"), F.lag("hi").over(w).alias("prev"))
    after = edged.where(F.col("next") > F.col("hi") + 1).select((F.col("hi") + 1).alias("lo"), (F.col("next") - 1).alias("hi"), F.lit(default).alias("v"))
    before = edged.where(F.col("prev").isNull() & (F.col("lo") > lo)).select(F.lit(lo).alias("lo"), (F.col("lo") - 1).alias("hi"), F.lit(default).alias("v"))
    return edged.select("lo", "hi", "v").union(after).union(before)


def unfolded(settings: DataFrame, lo: int, hi: int) -> DataFrame:
    """Settings (lo, hi, value) as one-number intervals: a list's values go to the numbers from lo on, one value to all.

    ``value`` is text; a comma parts a list. Missing bounds are ``lo`` and ``hi``.
    """
    bounded = settings.select(F.coalesce("lo", F.lit(lo)).alias("lo"), F.coalesce("hi", F.lit(hi)).alias("hi"), F.split(F.regexp_replace("value", r"[,\s]+$", ""), r"\s*,\s*").alias("list"))
    each = bounded.withColumn("n", F.explode(F.sequence("lo", "hi")))
    at = F.when(F.size("list") > 1, F.try_element_at("list", (F.col("n") - F.col("lo") + 1).cast("int"))).otherwise(F.col("list")[0])
    return each.select(F.col("n").alias("lo"), F.col("n").alias("hi"), at.cast("double").alias("v")).where("v IS NOT NULL")
