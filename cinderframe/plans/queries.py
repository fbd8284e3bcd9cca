"""Queries over the driver tables, one or more to an operator, each with SQL for the comparison where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import containment, crown, fuels, spotting, surface, units, weather as wx
from ..operators import arrival, ensemble, grid, intervals, replay, sampling, suppression
from ..sources import sparse_binary, tables
from . import landscape as land

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def near(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits})"


# --- projections -----------------------------------------------------------------------------------------------

_affine = ", ".join(f"round(l_quantity * {a!r}e0 + {b!r}e0, 6) AS {n}" if "e" not in repr(a) + repr(b) else f"round(l_quantity * CAST('{a!r}' AS DOUBLE) + CAST('{b!r}' AS DOUBLE), 6) AS {n}" for n, (a, b) in units.AFFINE.items())


@query(f"SELECT l_orderkey, l_linenumber, {_affine}, round(radians(l_quantity), 6) AS deg_to_rad, round(degrees(l_quantity), 6) AS rad_to_deg, round(tan(radians(l_quantity)), 6) AS deg_to_ratio, round(degrees(atan(l_quantity)), 6) AS ratio_to_deg, CAST(trunc(l_quantity * 60000) AS BIGINT) AS min_to_ms, CAST(trunc(l_quantity / 60) AS BIGINT) AS min_to_hour FROM lineitem")
def unit_convert_all(spark, sf_dir):
    names = [*units.AFFINE, "deg_to_rad", "rad_to_deg", "deg_to_ratio", "ratio_to_deg", "min_to_ms", "min_to_hour"]
    value = F.col("l_quantity")
    done = {n: units.convert(value, n) if n in ("min_to_ms", "min_to_hour") else F.round(units.convert(value, n), 6) for n in names}
    return land.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in done.items()))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS ignited, CASE WHEN l_extendedprice >= 20000 THEN l_extendedprice ELSE 0.0e0 END AS kept FROM lineitem")
def recode_threshold(spark, sf_dir):
    """An ignition mask and a layer with small values zeroed."""
    big = F.when(F.col("l_extendedprice") >= 20000, F.col("l_extendedprice")).otherwise(0.0)
    return land.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("ignited"), big.alias("kept"))


@query(f"WITH {land.CELLS} SELECT i, j, elevation * 3.281e0 AS elevation, (aspect + 90) % 360 AS aspect, canopy_cover * 435.6e0 / 43560e0 AS acres FROM cells")
def layer_conversion(spark, sf_dir):
    """Layer converters chosen by layer and units, an angle correction, cell counts to acres."""
    c = land.cells(spark, sf_dir)
    acres = F.col("canopy_cover") * 435.6 / units.ACRE_SQUARE_FEET
    return c.select("i", "j", units.layer_value(F.col("elevation"), "elevation", "metric").alias("elevation"), units.layer_value(F.col("aspect"), "aspect", None, rotate=90.0).alias("aspect"), acres.alias("acres"))


# --- filters and dimension joins ----------------------------------------------------------------------------------


@query(f"WITH {land.CELLS} SELECT i, j, model, model > 100 AS dynamic, (model BETWEEN 101 AND 109 OR model BETWEEN 211 AND 219) AS grass FROM cells WHERE model > 0 AND (model < 91 OR model > 99)")
def burnable_cells(spark, sf_dir):
    m = F.col("model")
    return land.cells(spark, sf_dir).where(fuels.burnable(m)).select("i", "j", "model", fuels.dynamic(m).alias("dynamic"), fuels.dynamic_grass(m).alias("grass"))


@query(f"WITH {land.CELLS}, {land.FUELS} SELECT i, j, model, name, depth, round(load_1h + load_10h + load_100h, 6) AS dead_load, sav_1h FROM cells JOIN fuels USING (model)")
def fuel_dimension_join(spark, sf_dir):
    load = F.col("load_1h") + F.col("load_10h") + F.col("load_100h")
    return land.fueled(spark, sf_dir).select("i", "j", "model", "name", "depth", F.round(load, 6).alias("dead_load"), "sav_1h")


@query(f"WITH {land.CELLS}, {land.FUELS}, syn AS (SELECT * FROM (VALUES {land.synonym_rows()}) AS t(variant, original)) SELECT variant, original AS base, name, count(i) AS n_cells FROM syn JOIN fuels ON model = original LEFT JOIN cells c ON c.model = original GROUP BY ALL")
def wui_synonyms(spark, sf_dir):
    """Interface variants carry their original's values."""
    models = fuels.fuel_models(spark).where("model != base").select(F.col("model").alias("variant"), "base", "name")
    n = land.cells(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n_cells"))
    return models.join(n, models["base"] == n["model"], "left").select("variant", "base", "name", F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


# --- intervals ------------------------------------------------------------------------------------------------------

_RANGES = [(1, 100, 0.1, 0), (91, 150, 0.2, 1), (151, 180, 0.3, 2), (190, 256, 0.4, 3)]
_OTHERS = [(50, 120, 1.0), (140, 160, 2.0), (200, 220, 3.0)]
_ranges = "ranges AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {v}e0, {p})" for a, b, v, p in _RANGES) + ") AS t(lo, hi, v, pos))"


def _interval_table(spark, rows, names="lo int, hi int, v double, pos int"):
    return spark.createDataFrame(rows, names)


@query(f"WITH {land.CELLS}, {_ranges} SELECT i, j, model, (SELECT arg_min(v, pos) FROM ranges WHERE c.model BETWEEN lo AND hi) AS v FROM cells c")
def interval_lookup(spark, sf_dir):
    """First range that holds a fuel number."""
    return intervals.lookup(land.cells(spark, sf_dir), "model", _interval_table(spark, _RANGES)).select("i", "j", "model", "v")


@query("WITH a AS (SELECT p_size AS lo, p_size + 9 AS hi, count(*) AS v1 FROM part GROUP BY p_size), b AS (SELECT min(s_suppkey % 50) AS lo, min(s_suppkey % 50) + 70 AS hi, CAST(s_nationkey AS INT) AS v2 FROM supplier GROUP BY s_nationkey) SELECT CAST(greatest(a.lo, b.lo) AS INT) AS lo, CAST(least(a.hi, b.hi) AS INT) AS hi, v1, v2 FROM a JOIN b ON a.lo <= b.hi AND b.lo <= a.hi")
def interval_overlap(spark, sf_dir):
    a = land.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("lo")).agg((F.max("p_size") + 9).alias("hi"), F.count("*").alias("v"))
    b = land.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("v")).agg(F.min(F.col("s_suppkey") % 50).alias("lo"), (F.min(F.col("s_suppkey") % 50) + 70).alias("hi"))
    return intervals.combine(a, b).select(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), "v1", "v2")


@query("WITH a AS (SELECT DISTINCT p_size AS lo, p_size AS hi, p_size // 7 AS v FROM part WHERE p_size % 11 != 0), m AS (SELECT *, CASE WHEN lag(hi) OVER (PARTITION BY v ORDER BY lo) + 1 = lo THEN 0 ELSE 1 END AS new FROM a), r AS (SELECT *, sum(new) OVER (PARTITION BY v ORDER BY lo) AS run FROM m) SELECT min(lo) AS lo, max(hi) AS hi, v FROM r GROUP BY v, run")
def interval_merge(spark, sf_dir):
    a = land.table(spark, sf_dir, "part").where("p_size % 11 != 0").select(F.col("p_size").alias("lo"), F.col("p_size").alias("hi"), F.expr("CAST(p_size div 7 AS INT)").alias("v")).distinct()
    return intervals.merge_adjacent(a)


@query("WITH a AS (SELECT DISTINCT CAST(p_size AS INT) AS lo, CAST(p_size // 7 AS DOUBLE) AS v FROM part WHERE p_size % 3 != 0), n AS (SELECT lo, lo AS hi, v, COALESCE(lead(lo) OVER (ORDER BY lo), 61) AS nxt, lag(lo) OVER (ORDER BY lo) AS prv FROM a) SELECT lo, hi, v FROM n UNION ALL SELECT hi + 1, nxt - 1, -1e0 FROM n WHERE nxt > hi + 1 UNION ALL SELECT 0, lo - 1, -1e0 FROM n WHERE prv IS NULL AND lo > 0")
def interval_fill(spark, sf_dir):
    """Sizes that occur, and what lies between them from 0 to 60 at a default value."""
    a = land.table(spark, sf_dir, "part").where("p_size % 3 != 0").select(F.col("p_size").cast("int").alias("lo"), F.col("p_size").cast("int").alias("hi"), F.expr("CAST(p_size div 7 AS DOUBLE)").alias("v")).distinct()
    return intervals.fill_gaps(a, 0, 60, -1.0)


# --- rasters ----------------------------------------------------------------------------------------------------------


@query(f"WITH {land.CELLS}, {land.WEATHER} SELECT c.i, c.j, b, temperature, wind_speed_20ft FROM cells c JOIN weather w ON CAST(floor(c.i * 0.1e0) AS INT) = bi AND CAST(floor(c.j * 0.1e0) AS INT) = bj")
def weather_multires_join(spark, sf_dir):
    """Hourly weather of a tenth of the resolution for every cell."""
    coarse = land.weather(spark, sf_dir).select(F.col("bi").alias("i"), F.col("bj").alias("j"), "b", "temperature", "wind_speed_20ft")
    return grid.align(land.cells(spark, sf_dir).select("i", "j"), coarse, 0.1, how="inner").select("i", "j", "b", "temperature", "wind_speed_20ft")


@query(f"WITH {land.WEATHER} SELECT o_orderkey, o.bi, o.bj, CAST(floor(m / 60) AS INT) AS b, temperature FROM (SELECT o_orderkey, (o_orderkey * 37) % 43200 AS m, CAST((o_custkey % 16) // 4 AS INT) AS bi, CAST(o_custkey % 4 AS INT) AS bj FROM orders) o LEFT JOIN weather w ON w.b = CAST(floor(m / 60) AS INT) AND w.bi = o.bi AND w.bj = o.bj")
def weather_band_join(spark, sf_dir):
    """The weather band in force at a minute, in each order's own weather cell."""
    cell = [F.floor((F.col("o_custkey") % 16) / 4).cast("int").alias("bi"), (F.col("o_custkey") % 4).cast("int").alias("bj")]
    o = land.table(spark, sf_dir, "orders").select("o_orderkey", *cell, grid.hour_band((F.col("o_orderkey") * 37) % 43200).cast("int").alias("b"))
    return o.join(land.weather(spark, sf_dir).select("b", "bi", "bj", "temperature"), ["b", "bi", "bj"], "left").select("o_orderkey", "bi", "bj", "b", "temperature")


_PAIRS = "JOIN cells n ON abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 AND (n.i != c.i OR n.j != c.j)"


@query(f"WITH {land.CELLS} SELECT c.i, c.j, CAST(n.i - c.i AS INT) AS di, CAST(n.j - c.j AS INT) AS dj, round(sqrt(98.425e0 * 98.425e0 * ((n.i - c.i) * (n.i - c.i) + (n.j - c.j) * (n.j - c.j)) + (n.elevation - c.elevation) * (n.elevation - c.elevation)), 6) AS distance FROM cells c {_PAIRS}")
def terrain_distance(spark, sf_dir):
    return rounded(grid.terrain_distances(land.cells(spark, sf_dir), 98.425), "distance").select("i", "j", "di", "dj", "distance")


_OPEN = "(model > 0 AND (model < 91 OR model > 99))"


@query(f"WITH {land.CELLS} SELECT i, j FROM cells c WHERE NOT {_OPEN} AND EXISTS (SELECT 1 FROM cells n WHERE abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 AND (n.i != c.i OR n.j != c.j) AND n.model > 0 AND (n.model < 91 OR n.model > 99))")
def burnable_neighbours(spark, sf_dir):
    """Cells that don't burn beside ones that do."""
    c, open_cell = land.cells(spark, sf_dir), fuels.burnable(F.col("model"))
    return grid.near_matching(c.where(~open_cell), c.where(open_cell)).select("i", "j")


@query(f"WITH {land.CELLS}, o AS (SELECT i, j, model % 2 = 1 AS open FROM cells) SELECT c.i, c.j, CAST(n.i - c.i AS INT) AS di, CAST(n.j - c.j AS INT) AS dj FROM o c JOIN o n ON abs(n.i - c.i) = 1 AND abs(n.j - c.j) = 1 JOIN o a ON a.i = n.i AND a.j = c.j JOIN o b ON b.i = c.i AND b.j = n.j WHERE c.open AND n.open AND NOT a.open AND NOT b.open")
def diagonal_barriers(spark, sf_dir):
    return grid.blocked_diagonals(land.cells(spark, sf_dir), F.col("model") % 2 == 1)


@query(f"WITH {land.CELLS} SELECT c.i, c.j, COALESCE((d.elevation - u.elevation) / 2, d.elevation - c.elevation, c.elevation - u.elevation) AS d_di, COALESCE((r.elevation - l.elevation) / 2, r.elevation - c.elevation, c.elevation - l.elevation) AS d_dj FROM cells c LEFT JOIN cells u ON u.i = c.i - 1 AND u.j = c.j LEFT JOIN cells d ON d.i = c.i + 1 AND d.j = c.j LEFT JOIN cells l ON l.i = c.i AND l.j = c.j - 1 LEFT JOIN cells r ON r.i = c.i AND r.j = c.j + 1")
def elevation_gradient(spark, sf_dir):
    return grid.gradient(land.cells(spark, sf_dir).select("i", "j", "elevation"), "elevation").select("i", "j", "d_di", "d_dj")


@query(f"WITH {land.CELLS} SELECT CAST(min(i) AS INT) AS min_i, CAST(max(i) AS INT) AS max_i, CAST(min(j) AS INT) AS min_j, CAST(max(j) AS INT) AS max_j FROM cells WHERE slope > 0.058")
def data_bounds(spark, sf_dir):
    return grid.bounding_box(land.cells(spark, sf_dir), F.col("slope") > 0.058)


@query(f"WITH {land.CELLS} SELECT CAST(COALESCE(min(i) FILTER (v >= 0), 0) AS INT) AS first_row, CAST(COALESCE(max(i) FILTER (v >= 0) + 1, 0) AS INT) AS end_row FROM (SELECT i, aspect - 350 AS v FROM cells)")
def data_row_range(spark, sf_dir):
    return grid.data_rows(land.cells(spark, sf_dir).select("i", (F.col("aspect") - 350).alias("v")), "v").select(F.col("first_row").cast("int").alias("first_row"), F.col("end_row").cast("int").alias("end_row"))


_TILES = "tiles AS (SELECT CAST(p_partkey // 40 AS INT) AS tile_row, CAST(p_partkey % 40 AS INT) AS tile_col, CAST(40 + p_partkey // 40 % 3 AS BIGINT) AS height, CAST(20 + p_partkey % 40 * 7 % 11 AS BIGINT) AS width FROM part)"


@query(f"WITH {_TILES}, r AS (SELECT tile_row, sum(h) OVER (ORDER BY tile_row) - h AS row0 FROM (SELECT tile_row, max(height) AS h FROM tiles GROUP BY 1)), c AS (SELECT tile_col, sum(w) OVER (ORDER BY tile_col) - w AS col0 FROM (SELECT tile_col, max(width) AS w FROM tiles GROUP BY 1)) SELECT tile_row, tile_col, height, width, CAST(row0 AS BIGINT) AS row0, CAST(col0 AS BIGINT) AS col0 FROM tiles JOIN r USING (tile_row) JOIN c USING (tile_col)")
def tile_stitching(spark, sf_dir):
    """Every part a tile of a grid of 40 columns, with as many rows as there are parts for."""
    row, col = F.expr("p_partkey div 40"), F.col("p_partkey") % 40
    tiles = land.table(spark, sf_dir, "part").select(row.cast("int").alias("tile_row"), col.cast("int").alias("tile_col"), (row % 3 + 40).cast("bigint").alias("height"), (col * 7 % 11 + 20).cast("bigint").alias("width"))
    return grid.tile_offsets(tiles).select("tile_row", "tile_col", "height", "width", "row0", "col0")


_A, _B = "SELECT DISTINCT i, j FROM sims WHERE burn_time <= 50", "SELECT DISTINCT i, j FROM sims WHERE flame_length > 120"


def _two_areas(spark, sf_dir):
    """Cells that any simulation burned early, and those that any burned high."""
    sims = land.sims(spark, sf_dir)
    return sims.where("burn_time <= 50"), sims.where("flame_length > 120")


@query(f"WITH {land.SIMS} {_A} UNION {_B}")
def union_burned(spark, sf_dir):
    return grid.union_cells(*_two_areas(spark, sf_dir))


@query(f"WITH {land.SIMS} {_A} INTERSECT {_B}")
def intersect_burned(spark, sf_dir):
    return grid.common_cells(*_two_areas(spark, sf_dir))


@query(f"WITH {land.SIMS} {_A} EXCEPT {_B}")
def except_burned(spark, sf_dir):
    return grid.except_cells(*_two_areas(spark, sf_dir))


@query(f"WITH {land.CELLS} SELECT CAST(i AS BIGINT) * 40 + j AS cell, slope FROM cells WHERE slope > 0")
def sparse_cells(spark, sf_dir):
    return grid.sparse(land.cells(spark, sf_dir), "slope", 40)


# --- moisture, sun ------------------------------------------------------------------------------------------------------

_EMC = "(CASE WHEN rh < 10 THEN 0.03229e0 + 0.281073e0 * rh - 0.000578e0 * rh * t WHEN rh < 50 THEN 2.22749e0 + 0.160107e0 * rh - 0.01478e0 * t ELSE 21.0606e0 + 0.005565e0 * rh * rh - 0.00035e0 * rh * t - 0.483199e0 * rh END / 30)"


@query(f"WITH {land.WEATHER}, e AS (SELECT b, bi, bj, {_EMC} AS emc FROM (SELECT *, relative_humidity AS rh, temperature AS t FROM weather)) SELECT b, bi, bj, {near('emc + 0.002e0', 8)} AS fm_1h, {near('emc + 0.015e0', 8)} AS fm_10h, {near('emc + 0.025e0', 8)} AS fm_100h, {near('emc * 2', 8)} AS fm_herb, {near('emc * 0.5e0', 8)} AS fm_woody FROM e")
def fuel_moisture(spark, sf_dir):
    m = wx.fuel_moistures(F.col("relative_humidity"), F.col("temperature"))
    return land.weather(spark, sf_dir).select("b", "bi", "bj", *(F.round(c, 8).alias(n) for n, c in m.items()))


_SUN = """
s AS (SELECT o_orderkey, o_orderdate, radians(30e0 + o_custkey % 20) AS phi, -120e0 + o_custkey % 40 AS lon, 2 * pi() * epoch(o_orderdate - date_trunc('year', o_orderdate)) / epoch(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - date_trunc('year', o_orderdate)) AS g FROM orders),
d AS (SELECT *, 229.18e0 * (0.000075e0 + 0.001868e0 * cos(g) - 0.032077e0 * sin(g) - 0.014615e0 * cos(2 * g) - 0.040849e0 * sin(2 * g)) AS eq,
 0.006918e0 - 0.399912e0 * cos(g) + 0.070257e0 * sin(g) - 0.006758e0 * cos(2 * g) + 0.000907e0 * sin(2 * g) - 0.002697e0 * cos(3 * g) + 0.00148e0 * sin(3 * g) AS decl FROM s),
h AS (SELECT *, acos(cos(radians(90.833e0)) / (cos(phi) * cos(decl)) - tan(phi) * tan(decl)) AS ha FROM d)"""


@query(f"WITH {_SUN} SELECT o_orderkey, round(12 - eq / 60 + (-lon - degrees(ha)) / 15, 6) AS sunrise, round(12 - eq / 60 + (-lon + degrees(ha)) / 15, 6) AS sunset FROM h")
def sunrise_sunset(spark, sf_dir):
    o = land.table(spark, sf_dir, "orders")
    rise, fall = wx.sun_hours(F.col("o_custkey") % 20 + 30.0, F.col("o_custkey") % 40 - 120.0, wx.year_angle(F.col("o_orderdate")))
    return o.select("o_orderkey", F.round(rise, 6).alias("sunrise"), F.round(fall, 6).alias("sunset"))


@query(f"WITH {_SUN}, c AS (SELECT o_orderkey, 12 - eq / 60 - lon / 15 - 4 AS a FROM h) SELECT o_orderkey, printf('%02d:%02d', CAST(((floor(a) % 24) + 24) % 24 AS INT), CAST(floor((a - trunc(a)) * 60 + 0.5e0) AS INT)) AS starts FROM c")
def burn_periods(spark, sf_dir):
    """Start of an eight-hour burn period around solar noon."""
    o = land.table(spark, sf_dir, "orders")
    start, _ = wx.burn_period(F.col("o_custkey") % 20 + 30.0, F.col("o_custkey") % 40 - 120.0, F.col("o_orderdate"), F.lit(8.0))
    return o.select("o_orderkey", start.alias("starts"))


# --- surface and crown fire -----------------------------------------------------------------------------------------------

#: Moistures that vary over the landscape.
_MOIST = {"fm_1h": "0.03e0 + slope * 0.5e0", "fm_10h": "0.04e0 + slope * 0.5e0", "fm_100h": "0.05e0 + slope * 0.5e0", "fm_herb": "0.3e0 + slope * 6", "fm_woody": "0.7e0 + slope * 6"}
_w = {"1h": "load_1h", "10h": "load_10h", "100h": "load_100h", "cured": "CASE WHEN model > 100 AND load_herb > 0 THEN load_herb * (1 - green) ELSE 0e0 END", "herb": "CASE WHEN model > 100 AND load_herb > 0 THEN load_herb * green ELSE load_herb END", "woody": "load_woody"}
_s = {c: f"sav_{c}" for c in ("1h", "10h", "100h", "herb", "woody")} | {"cured": "CASE WHEN model > 100 AND load_herb > 0 THEN sav_herb ELSE 0e0 END"}
_m = {c: f"fm_{c}" for c in ("1h", "10h", "100h", "herb", "woody")} | {"cured": "CASE WHEN model > 100 AND load_herb > 0 THEN fm_1h ELSE 0e0 END"}


def _plus(f, group):
    return "(" + " + ".join(f(c) for c in group) + ")"


def _over(a, b):
    return f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0e0 END"


def _rothermel() -> str:
    C, D, L = surface.CLASSES, surface.DEAD, surface.LIVE
    g = {**dict.fromkeys(D, D), **dict.fromkeys(L, L)}
    k = {**dict.fromkeys(D, "dead"), **dict.fromkeys(L, "live")}
    sel = lambda d: ", ".join(f"{v} AS {n}" for n, v in d.items())
    steps = [
        ("r0", "cells JOIN fuels USING (model)", {n: v for n, v in _MOIST.items()}),
        ("r1", "r0", {"green": "greatest(0e0, least(1e0, fm_herb / 0.9e0 - 0.3333333333333333e0))"}),
        ("r2", "r1", {f"{p}_{c}": t[c] for p, t in (("w", _w), ("s", _s), ("m", _m)) for c in C}),
        ("r3", "r2", {f"a_{c}": f"s_{c} * w_{c} / 32" for c in C} | {f"z_{c}": f"CASE WHEN s_{c} >= 1200 THEN 0 WHEN s_{c} >= 192 THEN 1 WHEN s_{c} >= 96 THEN 2 WHEN s_{c} >= 48 THEN 3 WHEN s_{c} >= 16 THEN 4 ELSE 5 END" for c in C} | {f"l_{c}": f"CASE WHEN s_{c} > 0 THEN w_{c} * exp({-138 if c in D else -500} / s_{c}) ELSE 0e0 END" for c in C}),
        ("r4", "r3", {"a_dead": _plus(lambda c: f"a_{c}", D), "a_live": _plus(lambda c: f"a_{c}", L), "l_dead": _plus(lambda c: f"l_{c}", D), "l_live": _plus(lambda c: f"l_{c}", L), "lm": _plus(lambda c: f"l_{c} * m_{c}", D)}),
        ("r5", "r4", {f"f_{c}": _over(f"a_{c}", f"a_{k[c]}") for c in C} | {"f_dead": _over("a_dead", "(a_dead + a_live)"), "f_live": _over("a_live", "(a_dead + a_live)"), "mx_live": f"CASE WHEN l_live > 0 THEN greatest(mx_dead, 2.9e0 * (l_dead / l_live) * (1 - {_over('lm', 'l_dead')} / mx_dead) - 0.226e0) ELSE mx_dead END"}),
        ("r6", "r5", {f"g_{c}": _plus(lambda o: f"CASE WHEN z_{c} = z_{o} THEN f_{o} ELSE 0e0 END", g[c]) for c in C}),
        ("r7", "r6", {
            "sigma": " + ".join(f"f_{x} * " + _plus(lambda c: f"f_{c} * s_{c}", y) for x, y in (("dead", D), ("live", L))), "rho": _over(_plus(lambda c: f"w_{c}", C), "depth"),
            **{f"rm_{x}": f"CASE WHEN {_plus(lambda c: f'f_{c}', y)} * mx_{x} > 0 THEN least(1e0, {_plus(lambda c: f'f_{c} * m_{c}', y)} / ({_plus(lambda c: f'f_{c}', y)} * mx_{x})) ELSE 1e0 END" for x, y in (("dead", D), ("live", L))},
            **{f"net_{x}": _plus(lambda c: f"g_{c} * w_{c}", y) + " * (1 - 0.0555e0)" for x, y in (("dead", D), ("live", L))},
            **{f"fs_{x}": _plus(lambda c: f"f_{c}", y) for x, y in (("dead", D), ("live", L))},
            **{f"e_{x}": _plus(lambda c: f"CASE WHEN s_{c} > 0 THEN f_{c} * exp(-138 / s_{c}) * (250 + 1116 * m_{c}) ELSE 0e0 END", y) for x, y in (("dead", D), ("live", L))},
        }),
        ("r8", "(SELECT *, rho / 32 AS beta FROM r7) WHERE (model < 91 OR model > 99) AND sigma > 0 AND rho > 0", {
            "op": "beta / (3.348e0 / pow(sigma, 0.8189e0))", "eps": "f_dead * e_dead + f_live * e_live", "bend": "133 / pow(sigma, 0.7913e0)",
            "btus": " + ".join(f"net_{x} * fs_{x} * heat * (1 - 2.59e0 * rm_{x} + 5.11e0 * pow(rm_{x}, 2) - 3.52e0 * pow(rm_{x}, 3)) * CASE WHEN fs_{x} > 0 THEN 0.174e0 / pow(fs_{x} * 0.01e0, 0.19e0) ELSE 1e0 END" for x in ("dead", "live")),
        }),
        ("r9", "r8", {"ir": "pow(sigma, 1.5e0) / (495 + 0.0594e0 * pow(sigma, 1.5e0)) * pow(op, bend) * exp(bend * (1 - op)) * btus"}),
        ("spread", "r9", {"base_rate": "ir * exp((0.792e0 + 0.681e0 * sqrt(sigma)) * (beta + 0.1e0)) / (192 + 0.2595e0 * sigma) / (rho * eps)", "residence": "384 / sigma", "wb": "0.02526e0 * pow(sigma, 0.54e0)", "wc": "7.47e0 * exp(-0.133e0 * pow(sigma, 0.55e0))", "wf": "pow(op, 0.715e0 * exp(-3.59e0 * sigma / 10000))", "sk": "5.275e0 * pow(beta, -0.3e0)"}),
    ]
    return f"{land.CELLS}, {land.FUELS}, " + ", ".join(f"{n} AS (SELECT *, {sel(d)} FROM {src})" for n, src, d in steps)


_ROTHERMEL = _rothermel()


def _minimum(spark, sf_dir):
    slope = F.col("slope")
    base = {"fm_1h": 0.03 + slope * 0.5, "fm_10h": 0.04 + slope * 0.5, "fm_100h": 0.05 + slope * 0.5, "fm_herb": 0.3 + slope * 6.0, "fm_woody": 0.7 + slope * 6.0}
    return surface.with_minimum_spread(land.fueled(spark, sf_dir).where(fuels.burnable(F.col("model"))).withColumns(base))


@query(f"WITH {_ROTHERMEL} SELECT i, j, model, round(base_rate, 6) AS base_rate, round(ir, 4) AS reaction_intensity, round(residence, 6) AS residence_time FROM spread")
def surface_minimum_spread(spark, sf_dir):
    out = _minimum(spark, sf_dir).select("i", "j", "model", "base_rate", "reaction_intensity", "residence_time")
    return rounded(rounded(out, "base_rate", "residence_time"), "reaction_intensity", digits=4)


_MAXIMUM = f"""{_ROTHERMEL},
m0 AS (SELECT *, canopy_cover * 8 AS u, aspect * 0.5e0 AS wd, (aspect + 180) % 360 AS up, (aspect * 0.5e0 + 180) % 360 AS wt, 0.9e0 * ir AS cap FROM spread),
m1 AS (SELECT *, CASE WHEN slope > 0 THEN sk * slope * slope ELSE 0e0 END AS ps, CASE WHEN u > 0 THEN pow(u, wb) * (wc / wf) ELSE 0e0 END AS pw, pow(cap, wb) * (wc / wf) AS pc, CASE WHEN abs(wt - up) > 180 THEN 360 - abs(wt - up) ELSE abs(wt - up) END AS apart FROM m0),
m2 AS (SELECT *, base_rate * (ps + pw * cos(radians(wt - up))) AS x, base_rate * pw * sin(radians(wt - up)) AS y FROM m1),
m3 AS (SELECT *, CASE WHEN abs(slope) < 1e-6 THEN pw WHEN u < 1e-6 THEN ps WHEN apart < 15 THEN ps + pw ELSE sqrt(x * x + y * y) / base_rate END AS phi,
 CASE WHEN abs(slope) < 1e-6 THEN wt WHEN u < 1e-6 OR apart < 15 THEN up ELSE ((up + degrees(atan2(y, x))) % 360 + 360) % 360 END AS direction FROM m2),
m4 AS (SELECT *, CASE WHEN abs(slope) < 1e-6 THEN u WHEN phi > 0 THEN pow(phi * (wf / wc), 1 / wb) ELSE 0e0 END AS eff FROM m3),
m5 AS (SELECT *, base_rate * (1 + CASE WHEN eff > cap THEN pc ELSE phi END) AS max_rate, least(eff, cap) AS wind FROM m4),
fastest AS (SELECT *, 1 + 0.002840909e0 * wind AS lw, sqrt((1 + 0.002840909e0 * wind) * (1 + 0.002840909e0 * wind) - 1) / (1 + 0.002840909e0 * wind) AS ecc FROM m5)"""


def _maximum(spark, sf_dir):
    one = F.lit(1.0)
    return surface.with_maximum_spread(_minimum(spark, sf_dir), F.col("canopy_cover") * 8.0, F.col("aspect") * 0.5, F.col("slope"), F.col("aspect"), one, one).where("base_rate > 0")


@query(f"WITH {_MAXIMUM} SELECT i, j, round(max_rate, 4) AS max_rate, round(direction, 4) AS max_direction, round(wind, 3) AS effective_wind, round(ecc, 6) AS eccentricity FROM fastest WHERE base_rate > 0")
def surface_maximum_spread(spark, sf_dir):
    out = _maximum(spark, sf_dir).select("i", "j", "max_rate", "max_direction", "effective_wind", "eccentricity")
    return rounded(rounded(rounded(out, "max_rate", "max_direction", digits=4), "effective_wind", digits=3), "eccentricity")


@query(f"WITH {_MAXIMUM}, a AS (SELECT *, unnest([0, 45, 90, 135, 180, 225, 270, 315]) AS heading FROM fastest WHERE base_rate > 0), t AS (SELECT *, CASE WHEN abs(direction - heading) > 180 THEN 360 - abs(direction - heading) ELSE abs(direction - heading) END AS th FROM a) SELECT i, j, CAST(heading AS INT) AS heading, round(CASE WHEN ecc < 1e-6 OR th < 1e-6 THEN max_rate ELSE max_rate * (1 - ecc) / (1 - ecc * cos(radians(th))) END, 4) AS rate FROM t")
def spread_rate_8dirs(spark, sf_dir):
    heading = F.explode(F.array(*(F.lit(a) for a in range(0, 360, 45)))).alias("heading")
    out = _maximum(spark, sf_dir).select("i", "j", "max_rate", "max_direction", "eccentricity", heading)
    rate = surface.rate_towards(F.col("max_rate"), F.col("max_direction"), F.col("eccentricity"), F.col("heading"))
    return out.select("i", "j", "heading", F.round(rate, 4).alias("rate"))


@query(f"WITH {_MAXIMUM}, q AS (SELECT model, ir * max_rate * residence / 60 AS fli FROM fastest WHERE base_rate > 0) SELECT model, count(*) AS n, round(avg(0.45e0 * pow(fli, 0.46e0)), 4) AS flame_mean, round(stddev_pop(0.45e0 * pow(fli, 0.46e0)), 4) AS flame_stddev, round(max(fli), 2) AS intensity_max FROM q GROUP BY model")
def flame_stats_by_fuel(spark, sf_dir):
    """Flame length and intensity of the fastest spread by fuel model."""
    out = _maximum(spark, sf_dir).select("model", surface.fireline_intensity(F.col("reaction_intensity"), F.col("max_rate"), F.col("residence_time")).alias("fli")).withColumn("fl", surface.flame_length(F.col("fli")))
    return out.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("fl"), 4).alias("flame_mean"), F.round(F.stddev_pop("fl"), 4).alias("flame_stddev"), F.round(F.max("fli"), 2).alias("intensity_max"))


@query(f"WITH {land.CELLS}, {land.FUELS} SELECT i, j, round(CASE WHEN canopy_cover > 0 AND canopy_height > 0 THEN 0.555e0 / (sqrt(canopy_cover / 300 * canopy_height) * ln((20 + 0.36e0 * canopy_height) / (0.13e0 * canopy_height))) WHEN depth > 0 THEN 1.83e0 / ln((20 + 0.36e0 * depth) / (0.13e0 * depth)) ELSE 0e0 END, 6) AS waf FROM cells JOIN fuels USING (model)")
def wind_adjustment(spark, sf_dir):
    waf = surface.wind_adjustment(F.col("depth"), F.col("canopy_height"), F.col("canopy_cover"))
    return land.fueled(spark, sf_dir).select("i", "j", F.round(waf, 6).alias("waf"))


_CROWN = f"""{land.CELLS},
k0 AS (SELECT *, elevation * 10 AS fli, canopy_cover * 0.5e0 AS u20, 0.03e0 + slope * 0.5e0 AS m FROM cells),
k1 AS (SELECT *, canopy_cover > 40 AND fli > 0 AND canopy_base_height > 0 AND fli * 3.46165186e0 >= pow((460 + 26 * 90e0) * 0.01e0 * canopy_base_height * 0.30478512648582745e0, 1.5e0) AS crowns,
 11.02e0 * pow(u20 * 1.609344e0 / 0.87e0, 0.9e0) * pow(bulk_density * 16.025641025641026e0, 0.19e0) * exp(-0.17e0 * m * 100) AS active, 3 / (bulk_density * 16.025641025641026e0) AS critical FROM k0)"""


@query(f"WITH {_CROWN} SELECT i, j, crowns, round(3.281e0 * CASE WHEN active > critical THEN active ELSE -active * exp(-active / critical) END, 6) AS rate, fli * bulk_density * (canopy_height - canopy_base_height) * 8000 / 60 AS intensity, round(sqrt(pow(1 + 0.125e0 * u20, 2) - 1) / (1 + 0.125e0 * u20), 6) AS eccentricity FROM k1")
def crown_fire(spark, sf_dir):
    c = land.cells(spark, sf_dir).withColumns({"fli": F.col("elevation") * 10.0, "u20": F.col("canopy_cover") * 0.5, "m": 0.03 + F.col("slope") * 0.5})
    return c.select(
        "i", "j", crown.initiates(F.col("canopy_cover"), F.col("canopy_base_height"), F.lit(0.9), F.col("fli")).alias("crowns"),
        F.round(crown.spread(F.col("u20"), F.col("bulk_density"), F.col("m")), 6).alias("rate"),
        crown.intensity(F.col("fli"), F.col("bulk_density"), F.col("canopy_height") - F.col("canopy_base_height"), F.lit(8000.0)).alias("intensity"),
        F.round(crown.eccentricity(F.col("u20"), F.lit(1.0)), 6).alias("eccentricity"),
    )


# --- spotting, suppression ---------------------------------------------------------------------------------------------------


@query(f"WITH {land.CELLS}, p AS (SELECT i, j, 5 + aspect / 12 AS t, 0.03e0 + slope * 0.5e0 AS m, 1 + canopy_cover * 0.1e0 AS fl, 50 + elevation AS d FROM cells), q AS (SELECT *, 144.512e0 - 0.266e0 * t - 0.00058e0 * t * t - t * m + 18.54e0 * (1 - exp(-15.1e0 * m)) + 640 * m AS qig FROM p), z AS (SELECT *, greatest(0e0, least(1e0, 0.000048e0 * pow((400 - qig) / 10, 4.3e0) / 50)) AS pr FROM q) SELECT i, j, round(qig, 6) AS heat, round(pr, 6) AS probability, round(pr * exp(-0.005e0 * d), 6) AS at_distance, round(2 * (2 * (fl / (2.3e0 * sqrt(fl))) / 60 * (1.2e0 + 5.963e0 / 3 * (pow((4.563e0 + 117 / fl) / 5.963e0, 1.5e0) - 1))) + 20, 6) AS delay FROM z")
def spot_ignition(spark, sf_dir):
    c = land.cells(spark, sf_dir).select("i", "j", (F.col("aspect") / 12 + 5).alias("t"), (F.col("slope") * 0.5 + 0.03).alias("m"), (F.col("canopy_cover") * 0.1 + 1).alias("fl"), (F.col("elevation") + 50).alias("d"))
    p = spotting.ignition_probability(F.col("t"), F.col("m"))
    return c.select("i", "j", F.round(spotting.preignition_heat(F.col("t"), F.col("m")), 6).alias("heat"), F.round(p, 6).alias("probability"), F.round(spotting.spot_probability(p, F.lit(0.005), F.col("d")), 6).alias("at_distance"), F.round(spotting.spot_time(F.lit(0.0), F.col("fl")), 6).alias("delay"))


@query(f"WITH {land.CELLS}, e AS (SELECT i, j, aspect, 5 * pow(elevation, 0.3e0) * pow(1 + canopy_cover * 0.1e0, 0.7e0) AS mean FROM cells), v AS (SELECT *, ln(mean * mean / sqrt(mean * mean + 250 * mean)) AS mu, sqrt(ln(1 + 250 * mean / (mean * mean))) AS sd FROM e) SELECT i, j, round(mu, 6) AS mu, round(sd, 6) AS sd, round(3.281e0 * 0.92e0 * 0.47e0 / (0.88e0 * 0.88e0) * exp(mu) * exp(sd * sd / 2) * (exp(sd * sd / 2) + 1) * (exp(sd * sd / 2) - 1), 3) AS across, CAST(floor((-(mean * 10) * cos(radians(aspect)) + 30 * sin(radians(aspect))) / 98.425e0 + 0.5e0) AS BIGINT) AS rows_off, CAST(floor(((mean * 10) * sin(radians(aspect)) + 30 * cos(radians(aspect))) / 98.425e0 + 0.5e0) AS BIGINT) AS cols_off FROM v")
def spot_landing(spark, sf_dir):
    mean = spotting.mean_distance(F.col("elevation"), F.col("canopy_cover") * 0.1 + 1, 5.0, 0.3, 0.7)
    c = land.cells(spark, sf_dir).select("i", "j", "aspect", mean.alias("mean"))
    mu, sd = spotting.lognormal(F.col("mean"), F.col("mean") * 250)
    di, dj = spotting.landing(F.col("aspect"), F.col("mean") * 10, F.lit(30.0), 98.425)
    return c.select("i", "j", F.round(mu, 6).alias("mu"), F.round(sd, 6).alias("sd"), F.round(spotting.crosswind_sigma(mu, sd), 3).alias("across"), di.alias("rows_off"), dj.alias("cols_off"))


SLICES = f"""{land.SIMS}, centre AS (SELECT sim, CAST(trunc(avg(i)) AS INT) AS ci, CAST(trunc(avg(j)) AS INT) AS cj FROM (SELECT DISTINCT sim, i, j FROM sims) GROUP BY sim),
placed AS (SELECT s.sim, i, j, flame_length, CAST(floor((degrees(atan2(i - ci, j - cj)) + CASE WHEN i < ci THEN 360 ELSE 0 END) / 5) AS INT) AS slice FROM sims s JOIN centre USING (sim)),
slices AS (SELECT e.sim, e.slice, COALESCE(rate, 0e0) AS rate, COALESCE(n, 0) AS n FROM (SELECT sim, CAST(unnest(range(72)) AS INT) AS slice FROM centre) e LEFT JOIN (SELECT sim, slice, sum(flame_length) / count(*) AS rate, count(DISTINCT i * 1000 + j) AS n FROM placed GROUP BY 1, 2) g ON g.sim = e.sim AND g.slice = e.slice)"""


def front_slices(spark, sf_dir):
    return suppression.slices(land.sims(spark, sf_dir).withColumn("spread_rate", F.col("flame_length")))


@query(f"WITH {SLICES} SELECT sim, slice, n, round(rate, 6) AS rate FROM slices")
def suppression_slices(spark, sf_dir):
    """Burned cells in all 72 slices around each fire's centre cell."""
    return rounded(front_slices(spark, sf_dir), "rate").select("sim", "slice", "n", "rate")


_GROWTH = "n * 98.425e0 * 98.425e0 / 43560 / (60 / 1440e0)"


@query(f"WITH {land.SIMS}, n AS (SELECT sim, CAST(count(*) AS DOUBLE) AS n FROM sims GROUP BY sim), g AS (SELECT *, 1 - ln({_GROWTH}) / ln(5000 + sim * 1000e0) AS m FROM n), d AS (SELECT *, exp(CASE WHEN m >= 0 THEN -1 ELSE 1 END * 2e0 * 0.3e0) AS difficulty FROM g) SELECT sim, round(pow(2 * (sim / 8e0) / (1 + (sim / 8e0) * (sim / 8e0)), 2e0), 6) AS by_curve, round({_GROWTH}, 4) AS acres_a_day, round(difficulty, 6) AS difficulty, round(greatest(0e0, 0.2e0 + 100e0 * m * difficulty * 0.01e0 * (60 * 0.000694444e0)), 6) AS by_index FROM d")
def containment_curves(spark, sf_dir):
    """Fractions contained by a curve and by difficulty, over and under the growth that overwhelms suppression."""
    n = land.sims(spark, sf_dir).groupBy("sim").agg(F.count("*").cast("double").alias("n"))
    share, rate = F.col("sim") / 8.0, containment.growth_acres_per_day(F.col("n"), 98.425, 60.0)
    multiplier = containment.growth_multiplier(F.col("sim") * 1000.0 + 5000.0, rate)
    difficulty = containment.difficulty_factor(F.lit(2.0), multiplier, F.lit(0.3))
    index = containment.contained_by_index(F.lit(0.2), F.lit(100.0), multiplier, difficulty, 60.0)
    return n.select("sim", F.round(containment.contained_by_curve(share, F.lit(2.0)), 6).alias("by_curve"), F.round(rate, 4).alias("acres_a_day"), F.round(difficulty, 6).alias("difficulty"), F.round(index, 6).alias("by_index"))


# --- ensembles, replay -----------------------------------------------------------------------------------------------------------


@query(f"WITH {land.SIMS} SELECT k AS band, i, j, count(*) AS burn_count FROM sims, (SELECT unnest(range(7)) AS k) WHERE burn_time >= 0 AND burn_time <= k * 100 GROUP BY 1, 2, 3")
def burn_count_bands(spark, sf_dir):
    """How many simulations had burned a cell by the clock of each band."""
    return ensemble.burn_counts(land.sims(spark, sf_dir), 100.0, 600.0)


@query(f"WITH {land.SIMS} SELECT i, j, count(*) AS burn_count, count(*) / 7e0 AS burn_probability FROM sims GROUP BY 1, 2")
def burn_probability(spark, sf_dir):
    return ensemble.burn_probability(land.sims(spark, sf_dir), 7)


@query(f"WITH {land.SIMS} SELECT i, j, sum(flame_length) AS flame_length_sum, max(flame_length) AS flame_length_max FROM sims GROUP BY 1, 2")
def flame_sum_max(spark, sf_dir):
    return ensemble.flame_sum_max(land.sims(spark, sf_dir))


@query(f"WITH {land.SIMS} SELECT sim, i, j, CASE WHEN burn_time BETWEEN 0 AND 300 THEN flame_length ELSE 0e0 END AS flame_length FROM sims")
def layer_snapshot(spark, sf_dir):
    return ensemble.snapshot(land.sims(spark, sf_dir), 300.0, "flame_length").select("sim", "i", "j", "flame_length")


@query(f"""WITH {land.SIMS}, k AS (SELECT sim, i, j, fire_type, flame_length - 30 AS fl, fire_line_intensity - 20000 AS fli, CAST(flame_length AS BIGINT) % 5 = 0 AS spots, 98.425e0 * 98.425e0 / 43560e0 AS a FROM sims),
s AS (SELECT sim, max(a) AS a, count(*) FILTER (fire_type = 1) AS n1, count(*) FILTER (fire_type >= 2) AS n2, count(*) FILTER (fl > 0) AS n, sum(fl) FILTER (fl > 0) AS s_fl, sum(fli) FILTER (fli > 0) AS s_fli, count(*) FILTER (spots) AS spot_count FROM k GROUP BY sim),
d AS (SELECT k.sim, sqrt(sum((fl - s_fl / n) * (fl - s_fl / n)) FILTER (fl > 0) / max(n)) AS d_fl, sqrt(sum((fli - s_fli / n) * (fli - s_fli / n)) FILTER (fli > 0) / max(n)) AS d_fli FROM k JOIN s USING (sim) GROUP BY k.sim)
SELECT sim, round((n1 + n2) * a, 6) AS fire_size, round(n1 * a, 6) AS surface_fire_size, round(n2 * a, 6) AS crown_fire_size, round(s_fl / n, 6) AS flame_length_mean, round(d_fl, 6) AS flame_length_stddev, round(s_fli / n, 3) AS fire_line_intensity_mean, round(d_fli, 3) AS fire_line_intensity_stddev, spot_count FROM s JOIN d USING (sim)""")
def simulation_summary(spark, sf_dir):
    """Sizes, means over positive values and spots of each simulation."""
    sims = land.sims(spark, sf_dir)
    spots = sims.where(F.col("flame_length").cast("bigint") % 5 == 0)
    cells = sims.withColumns({"flame_length": F.col("flame_length") - 30, "fire_line_intensity": F.col("fire_line_intensity") - 20000})
    out = ensemble.summary(cells, 98.425, spots)
    return rounded(rounded(out, *(c for c in out.columns if c not in ("sim", "spot_count") and "line" not in c)), "fire_line_intensity_mean", "fire_line_intensity_stddev", digits=3)


@query(f"WITH {land.SIMS}, b AS (SELECT i, j, min(burn_time) AS burn_time FROM sims GROUP BY 1, 2), a AS (SELECT i, j, CASE WHEN burn_time > 400 THEN -1e0 ELSE burn_time END AS burn_time FROM b) SELECT i, j, CASE WHEN burn_time = -1 AND EXISTS (SELECT 1 FROM a n WHERE abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 AND (n.i != c.i OR n.j != c.j) AND n.burn_time > 0) THEN 201 WHEN burn_time = -1 THEN 200 WHEN floor((400 - burn_time) / 60) BETWEEN 0 AND 3 THEN CAST(floor((400 - burn_time) / 60) AS INT) + 1 WHEN floor((400 - burn_time) / 60) >= 4 THEN 5 ELSE 0 END AS class FROM a c")
def burn_color_map(spark, sf_dir):
    """Classes of burn history at a moment."""
    first = land.sims(spark, sf_dir).groupBy("i", "j").agg(F.min("burn_time").alias("burn_time")).withColumn("burn_time", F.when(F.col("burn_time") > 400, -1.0).otherwise(F.col("burn_time")))
    edge = grid.near_matching(first.where("burn_time = -1").select("i", "j"), first.where("burn_time > 0")).withColumn("beside", F.lit(True))
    return first.join(edge, ["i", "j"], "left").select("i", "j", units.burn_history_class(F.col("burn_time"), F.lit(400.0), F.coalesce("beside", F.lit(False))).alias("class"))


@query("WITH p AS (SELECT user_id AS fire, ts AS t0, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t1 FROM events) SELECT fire, t0, t1, round(epoch(t1 - t0) / 60, 4) AS lapse FROM p WHERE t1 IS NOT NULL AND epoch(t1 - t0) / 60 BETWEEN 60 AND 1440")
def replay_pairs(spark, sf_dir):
    e = land.table(spark, sf_dir, "events").select(F.col("user_id").alias("fire"), F.col("ts").alias("t"))
    return rounded(replay.snapshot_pairs(e, 60.0, 1440.0), "lapse", digits=4)


@query(f"WITH {land.SIMS} SELECT sim, count(*) FILTER (burn_time < 300 AND flame_length > 30) AS both, count(*) FILTER (burn_time < 300 AND flame_length <= 30) AS sim_minus_real, count(*) FILTER (burn_time >= 300 AND flame_length > 30) AS real_minus_sim FROM sims GROUP BY sim")
def confusion_counts(spark, sf_dir):
    return replay.confusion(land.sims(spark, sf_dir), ["sim"], F.col("burn_time") < 300, F.col("flame_length") > 30)


def _percentile(p: int) -> str:
    at = f"greatest(1e0, least(n, {p / 100!r}e0 * (n + 1)))"
    low = f"CAST(floor({at}) AS BIGINT)"
    return f"round(l[{low}] + ({at} - {low}) * (l[least({low} + 1, n)] - l[{low}]), 6) AS p{p}"


@query(f"WITH {land.SIMS}, q AS (SELECT sim, list_sort(list(burn_time / 240e0)) AS l, count(*) AS n, avg(burn_time / 240e0) AS mean FROM sims WHERE burn_time < 300 AND flame_length > 30 AND burn_time > 0 GROUP BY sim) SELECT sim, round(mean, 6) AS mean, {', '.join(map(_percentile, (50, 75, 90, 95)))} FROM (SELECT DISTINCT sim FROM sims) LEFT JOIN q USING (sim)")
def arrival_quantiles(spark, sf_dir):
    """Time of arrival over the lapse where simulation and observation both burned."""
    out = replay.arrival_ratios(land.sims(spark, sf_dir), ["sim"], F.col("burn_time") < 300, F.col("flame_length") > 30, F.lit(240.0))
    return rounded(out, "mean", "p50", "p75", "p90", "p95")


@query(f"WITH {land.SIMS}, w AS (SELECT sim, flame_length, pow(burn_time / 100, 2) * exp(-burn_time / 100) AS w FROM sims) SELECT sim, round(sum(w * flame_length) / sum(w), 6) AS flame_length FROM w GROUP BY sim")
def weighted_scores(spark, sf_dir):
    """Scores weighted in favour of a lapse of 200 minutes."""
    weight = replay.lapse_weight(F.lit(200.0), F.col("burn_time"))
    return rounded(replay.weighted_scores(land.sims(spark, sf_dir), ["sim"], weight, ["flame_length"]), "flame_length")


# --- samples, arrival times ------------------------------------------------------------------------------------------------------------

_BUCKET = "(((CAST({i} AS BIGINT) * 73856093 + CAST({j} AS BIGINT) * 19349663) % 1024 + 1024) % 1024)"


def _perturb(i, j):
    return "(-5 + " + _BUCKET.format(i=i, j=j) + " / 1023e0 * 10)"


@query(f"WITH {land.CELLS} SELECT i, j, round({_perturb('i', 'j')}, 6) AS by_pixel, round({_perturb('-1', '-1')}, 6) AS overall, round({_perturb('a', 'b')} * (1 - u) * (1 - v) + {_perturb('a + 1', 'b')} * u * (1 - v) + {_perturb('a', 'b + 1')} * (1 - u) * v + {_perturb('a + 1', 'b + 1')} * u * v, 6) AS smoothed FROM (SELECT *, CAST(floor(i / 7e0) AS BIGINT) AS a, CAST(floor(j / 7e0) AS BIGINT) AS b, i / 7e0 - floor(i / 7e0) AS u, j / 7e0 - floor(j / 7e0) AS v FROM cells)")
def perturbations(spark, sf_dir):
    """By pixel, for the whole layer, and interpolated on a coarser grid."""
    i, j = F.col("i"), F.col("j")
    three = {"by_pixel": sampling.pixel_perturbation(-5.0, 5.0, i, j), "overall": sampling.pixel_perturbation(-5.0, 5.0, F.lit(-1), F.lit(-1)), "smoothed": sampling.smoothed_perturbation(-5.0, 5.0, 7.0, i, j)}
    return land.cells(spark, sf_dir).select("i", "j", *(F.round(c, 6).alias(n) for n, c in three.items()))


def uniform_sql(seed: int, *keys: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {seed}, {', '.join(keys)})), 1, 13) AS BIGINT) / 4503599627370496e0)"


def normal_sql(seed: int, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform_sql(seed, *keys)})) * cos({uniform_sql(seed + 1, *keys)} * 6.283185307179586e0))"


@query(f"SELECT o_orderkey AS sim, round(0.5e0 + {uniform_sql(1, 'o_orderkey')} * 1.5e0, 9) AS ellipse, [60e0, 120e0, 240e0][CAST(floor({uniform_sql(2, 'o_orderkey')} * 3) AS INT) + 1] AS max_runtime, 90e0 AS foliar, round({normal_sql(4, 'o_orderkey')}, 6) AS gust FROM orders")
def draw_samples(spark, sf_dir):
    """A simulation for every order: a range, a list, a constant and a normal draw."""
    sim = F.col("o_orderkey")
    out = land.table(spark, sf_dir, "orders").select(sim.alias("sim"), sampling.drawn(1, (0.5, 2.0), sim).alias("ellipse"), sampling.drawn(2, [60.0, 120.0, 240.0], sim).alias("max_runtime"), sampling.drawn(3, 90.0, sim).alias("foliar"), sampling.normal(4, 0.0, 1.0, sim).alias("gust"))
    return rounded(rounded(out, "ellipse", digits=9), "gust")


@query(f"WITH {land.CELLS}, f AS (SELECT i, j, row_number() OVER (ORDER BY {uniform_sql(7, 'i', 'j')}, i, j) - 1 AS r, count(*) OVER () AS n FROM cells WHERE {_OPEN} AND i BETWEEN 3 AND 36 AND j BETWEEN 3 AND 36) SELECT CAST(sim AS INT) AS sim, i, j FROM (SELECT unnest(range(3000)) AS sim) s JOIN f ON s.sim % n = r")
def ignition_sites(spark, sf_dir):
    """Sites of 3,000 simulations among the burnable cells away from the edge, which they use in turns."""
    inside = F.col("i").between(3, 36) & F.col("j").between(3, 36)
    return sampling.ignition_sites(land.cells(spark, sf_dir), 3000, fuels.burnable(F.col("model")) & inside, 7)


_HEADING = "CASE " + " ".join(f"WHEN di = {di} AND dj = {dj} THEN {h}" for (di, dj), h in arrival.HEADINGS.items()) + " END"


def _towards(prefix: str) -> str:
    d, e, r = f"{prefix}direction", f"{prefix}ecc", f"{prefix}max_rate"
    th = f"CASE WHEN abs({d} - h) > 180 THEN 360 - abs({d} - h) ELSE abs({d} - h) END"
    return f"(CASE WHEN {e} < 1e-6 OR {th} < 1e-6 THEN {r} ELSE {r} * ((1 - {e}) / (1 - {e} * cos(radians({th})))) END)"


@query(f"""WITH {_MAXIMUM}, {land.SIMS}, f AS (SELECT i, j, elevation, max_rate, direction, ecc FROM fastest WHERE base_rate > 0 AND max_rate > 0),
p AS (SELECT a.*, b.i AS to_i, b.j AS to_j, b.i - a.i AS di, b.j - a.j AS dj, b.elevation AS z2, b.max_rate AS t_max_rate, b.direction AS t_direction, b.ecc AS t_ecc FROM f a JOIN f b ON abs(b.i - a.i) <= 1 AND abs(b.j - a.j) <= 1 AND (a.i != b.i OR a.j != b.j)),
m AS (SELECT *, {_HEADING} AS h, sqrt((di * di + dj * dj) * (98.425e0 * 98.425e0) + (z2 - elevation) * (z2 - elevation)) AS d FROM p),
e AS (SELECT i, j, to_i, to_j, d * 0.5e0 / {_towards('')} + d * 0.5e0 / {_towards('t_')} AS minutes FROM m)
SELECT sim, CAST(to_i AS INT) AS i, CAST(to_j AS INT) AS j, round(min(burn_time + minutes), 3) AS arrives FROM sims JOIN e USING (i, j) WHERE burn_time BETWEEN 0 AND 300 GROUP BY 1, 2, 3""")
def arrival_times(spark, sf_dir):
    """When the front of each simulation reaches the cells beside those burned by minute 300."""
    fast = _maximum(spark, sf_dir).select("i", "j", "elevation", "max_rate", "max_direction", "eccentricity")
    burned = land.sims(spark, sf_dir).where(F.col("burn_time").between(0, 300))
    return rounded(arrival.next_arrivals(burned, arrival.moves(fast, 98.425)), "arrives", digits=3)


@query(f"WITH {land.SIMS} SELECT sim, count(*) AS n_cells, 4 + 16 * count(*) AS n_bytes FROM sims WHERE burn_time > 0 GROUP BY sim")
def sparse_files(spark, sf_dir):
    """Sizes of sparse binary outputs, a file a simulation."""
    files = sparse_binary.encoded(land.sims(spark, sf_dir), 40, ["burn_time", "flame_length"])
    return files.select("sim", ((F.length("content") - 4) / 16).cast("bigint").alias("n_cells"), F.length("content").cast("bigint").alias("n_bytes"))


@query("SELECT lower(replace(p_type, ' ', '_')) AS name, CAST(p_partkey % 10 AS INT) AS lo, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE CAST(p_partkey % 10 + p_size AS INT) END AS hi, CASE p_partkey % 3 WHEN 0 THEN '/data/' || p_brand || ' & more!/x' WHEN 1 THEN CAST(p_size AS VARCHAR) || '.5' ELSE './it''s/' || p_brand END AS value FROM part")
def namelist_parse(spark, sf_dir):
    """Decks of NAME(a:b) = value lines: quoted paths with marks in them, numbers, comments, open bounds."""
    n, k = F.col("p_partkey") % 10, F.col("p_partkey") % 3
    bounds = F.when(k == 2, F.format_string("(%d:)", n)).otherwise(F.format_string("(%d:%d)", n, n + F.col("p_size")))
    value = F.when(k == 0, F.format_string("'/data/%s & more!/x'", "p_brand")).when(k == 1, F.format_string("%d.5", "p_size")).otherwise(F.format_string('"./it\'s/%s"', "p_brand"))
    line = F.concat(F.lit("  "), F.replace("p_type", F.lit(" "), F.lit("_")), bounds, F.lit(" = "), value, F.when(F.col("p_partkey") % 2 == 0, " ! note's & /").otherwise(" /"))
    return tables.namelist(land.table(spark, sf_dir, "part").select(line.alias("value")))


# --- text, sessions -------------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'event-' || replace(event_type, '_', '-') AS kebab FROM events")
def json_requests(spark, sf_dir):
    return land.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.concat(F.lit("event-"), F.replace("event_type", F.lit("_"), F.lit("-"))).alias("kebab"))


@query("WITH m AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m) SELECT user_id, min(ts) AS started, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, run")
def debounce_sessions(spark, sf_dir):
    """Changes of one path that follow one another within the quiet period are one: session windows, mergeable partially."""
    e = land.table(spark, sf_dir, "events").select("user_id", "ts")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return s.select("user_id", "started", "last", "n")


@query("SELECT event_type, event_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 10")
def priority_jobs(spark, sf_dir):
    """The ten jobs of highest priority in each queue: a top-k report."""
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return land.table(spark, sf_dir, "events").select("event_type", "event_id", F.row_number().over(w).alias("rank")).where("rank <= 10")


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
