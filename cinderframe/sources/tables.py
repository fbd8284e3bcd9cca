"""Tabular inputs and outputs: ignition sites, summary statistics, name = value decks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNITIONS = "row long, col long, start_time double, max_runtime double"
SUMMARY_ORDER = ["ignition_row", "ignition_col"]


def read_ignitions(spark: SparkSession, path: str) -> DataFrame:
    """Sites with a header line, in a fixed schema: nothing is inferred."""
    return spark.read.schema(IGNITIONS).option("header", True).option("enforceSchema", True).csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Range-partitioned and sorted by ignition site, as CSV parts with headers."""
    present = [c for c in SUMMARY_ORDER if c in summary.columns]
    (summary.orderBy(*present) if present else summary).write.mode("overwrite").option("header", True).csv(path)


#: What stands before a comment or the end of a group: quoted texts whole, all else up to the first mark.
BEFORE_COMMENT = r"""^((?:[^'"!&/]|'[^']*'|"[^"]*")*)[!&/].*$"""


def namelist(texts: DataFrame, column: str = "value") -> DataFrame:
    """(name, lo, hi, value) of ``NAME = v``, ``NAME(i) = v``, ``NAME(a:b) = v``, ``NAME(a:) = v`` and ``NAME(:b) = v`` lines.

    Comments, group marks and quotes go, but not what quotes hold; a missing bound is null.
    """
    line = F.trim(F.regexp_replace(F.col(column), BEFORE_COMMENT, "$1"))
    head, value = F.trim(F.split(line, "=", 2)[0]), F.trim(F.split(line, "=", 2)[1])
    inside = F.regexp_extract(head, r"\(([^)]*)\)", 1)
    lo, hi = (F.try_element_at(F.split(inside, ":"), F.lit(k)).try_cast("int") for k in (1, 2))
    name = F.lower(F.trim(F.regexp_replace(head, r"\(.*$", "")))
    rows = texts.where(F.contains(line, F.lit("=")))
    whole = F.contains(inside, F.lit(":"))
    return rows.select(name.alias("name"), lo.alias("lo"), F.when(whole, hi).otherwise(lo).alias("hi"), F.regexp_replace(value, r"""^'(.*)'$|^"(.*)"$""", "$1$2").alias("value"))


def namelist_value(value):
    """(kind, number, list): what a value is: boolean, number (Fortran's 1., 3.E+02 and .5 too), list of numbers, or text."""
    number = F.regexp_replace(F.upper(F.trim(value)), "D", "E").try_cast("double")
    flag = F.upper(F.trim(value))
    listed = F.transform(F.split(F.regexp_replace(value, r"[,\s]+$", ""), r"\s*,\s*"), lambda x: F.trim(x).try_cast("double"))
    is_list = F.contains(value, F.lit(",")) & F.forall(listed, lambda x: x.isNotNull())
    kind = F.when(flag.isin(".TRUE.", ".FALSE."), "boolean").when(number.isNotNull(), "number").when(is_list, "list").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(kind == "boolean", (flag == ".TRUE.").cast("double")).otherwise(F.when(kind == "number", number)).alias("number"), F.when(kind == "list", listed).alias("list"))


FIRE_STATS = "icase string, metband string, x string, y string, tstop string, runtime string, a_total string, a_crown string, firevol string, pop string, rev string, lv string, nembers string, pyrome string, containfrac string"


def fire_stats(rows: DataFrame, cell: float, x_lower: float, y_lower: float, height: float, keep: list[str] | None = None) -> DataFrame:
    """Simulation inputs from a summary's rows (columns of FIRE_STATS as text): ignition cell, start and runtime in minutes, pyrome.

    ``keep``: columns that stay before them."""
    number = {c: F.trim(c).try_cast("double") for c in ("x", "y", "tstop", "metband", "pyrome")}
    row = F.abs(number["y"] - y_lower - height) / cell
    return rows.select(
        *(keep or []), row.cast("int").alias("ignition_row"), ((number["x"] - x_lower) / cell).cast("int").alias("ignition_col"),
        (number["metband"] * 60.0).alias("ignition_start_time"), (number["tstop"] * 60.0).alias("max_runtime"), number["pyrome"].cast("long").alias("pyrome"),
    )


def lookup_rows(wide: DataFrame, key: str) -> DataFrame:
    """(key, name, value) of a wide table of parameters: a column each name, its values as doubles."""
    names = [c for c in wide.columns if c != key]
    return wide.select(F.col(key).cast("long").alias(key), *(F.col(f"`{c}`").cast("double").alias(c) for c in names)).unpivot([key], names, "name", "value")


def output_name(name, suffix, sim, minute, extension: str):
    """name_suffix_sim_tTIME.ext with blank and null parts left out."""
    return F.concat(F.concat_ws("_", F.nullif(name, F.lit("")), F.nullif(suffix, F.lit("")), F.lpad(sim.cast("string"), 4, "0"), F.concat(F.lit("t"), minute.cast("string"))), F.lit("." + extension))
