"""Names, dates and messages as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reformat_date(value: Column, given: str, wanted: str) -> Column:
    """A date's text from one pattern to another, in the session's zone; null if it does not fit."""
    return F.date_format(F.try_to_timestamp(value, F.lit(given)), wanted)


def camel_to_kebab(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "(?<=[a-z])(?=[A-Z])", "-"))


def kebab_to_camel(value: Column) -> Column:
    """The first word in lower case, the others with a capital; other signs than letters, digits, _ and - go."""
    words = F.split(F.regexp_replace(F.lower(value), r"^[^a-z_$]|[^\w-]", ""), "-")
    return F.concat(words[0], F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.initcap), ""))


def snake_to_kebab(value: Column) -> Column:
    return F.replace(value, F.lit("_"), F.lit("-"))


def kebab_to_snake(value: Column) -> Column:
    return F.replace(value, F.lit("-"), F.lit("_"))


SNAPSHOT = r"^(.+)_(\d{8})_(\d{6})_(\d{3})\.tar\.gz$"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def parse_snapshot(path: Column) -> Column:
    """struct(fire, subnumber, at) of a snapshot archive's name; null if it is none."""
    name = file_name(path)
    at = F.try_to_timestamp(F.concat(F.regexp_extract(name, SNAPSHOT, 2), F.regexp_extract(name, SNAPSHOT, 3)), F.lit("yyyyMMddHHmmss"))
    found = F.struct(F.regexp_extract(name, SNAPSHOT, 1).alias("fire"), F.regexp_extract(name, SNAPSHOT, 4).try_cast("int").alias("subnumber"), at.alias("at"))
    return F.when(F.rlike(name, F.lit(SNAPSHOT)), found)


def useful_file(entry: Column, endings: dict[str, str]) -> Column:
    """What an archive's entry is to a replay, by the ending of its path; null if it is of no use."""
    out = F.lit(None).cast("string")
    for ending, kind in endings.items():
        out = F.when(F.endswith(entry, F.lit(ending)), kind).otherwise(out)
    return out


def hours_between(t0: Column, t1: Column) -> Column:
    """``+NNhr``, the number padded to two places, half hours up."""
    hours = F.floor((F.unix_micros(t1.cast("timestamp")) - F.unix_micros(t0.cast("timestamp"))) / 3.6e9 + 0.5)
    return F.format_string("+%2dhr", hours)


def job_of(path: Column) -> Column:
    """struct(fire_name, type, ignition_time) of a deck's path ``.../name_yyyyMMdd_HHmmss_001.tar``; null parts where it lacks them."""
    name = file_name(path)
    stamp = F.nullif(F.regexp_extract(name, r"(\d{8}_\d{6})", 1), F.lit(""))
    fire = F.nullif(F.regexp_extract(name, r"^(.+?)_\d{8}_\d{6}", 1), F.lit(""))
    at = reformat_date(stamp, "yyyyMMdd_HHmmss", "yyyy-MM-dd HH:mm")
    return F.struct(fire.alias("fire_name"), F.lit("active-fire").alias("type"), F.concat(at, F.lit(" UTC")).alias("ignition_time"))


def deck_name(fire: Column, ignition: Column, given: str = "yyyy-MM-dd HH:mm", suffix: str = "001") -> Column:
    return F.concat_ws("_", fire, reformat_date(ignition, given, "yyyyMMdd_HHmmss"), F.lit(suffix))


def weather_start(ignition: Column) -> Column:
    """The hour in which a fire starts: weather is hourly."""
    return F.date_trunc("hour", ignition)


def camel(name: str) -> str:
    first, *rest = name.split("-")
    return first + "".join(w.capitalize() for w in rest)


def response(fields: dict[str, Column]) -> Column:
    """A message's JSON text; names with dashes become camel case, null fields stay out."""
    return F.to_json(F.struct(*(c.alias(camel(n)) for n, c in fields.items())))


def request(message: Column, fields: dict[str, str]) -> Column:
    """A request's fields (names with dashes: type) from its JSON text, which has them in camel case."""
    got = F.from_json(message, ", ".join(f"`{camel(n)}` {t}" for n, t in fields.items()))
    return F.struct(*(got[camel(n)].alias(n.replace("-", "_")) for n in fields))
