"""More queries over the driver tables: layers, tiles, suppression, samples, replays and text, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spotting, surface, text, units
from ..operators import ensemble, grid, intervals, layers, replay, sampling, suppression
from ..sources import geotiff, tables
from ..streaming import watch
from . import landscape as land
from .queries import SLICES, front_slices, normal_sql, rounded, uniform_sql

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


# --- layers and tiles ------------------------------------------------------------------------------------------


def _layer_sql(source: str, band: str, i: str, j: str, **values: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS layer, {band} AS b, CAST({i} AS INT) AS i, CAST({j} AS INT) AS j, {v} AS v FROM {source}" for n, v in values.items())


_FIXED = _layer_sql("cells", "0", "i", "j", elevation="elevation * 3.281e0", slope="round(tan(radians(slope * 100)), 9)", aspect="(aspect + 45) % 360", canopy_cover="canopy_cover", crown_bulk_density="bulk_density * 0.0624e0")
_HOURLY = _layer_sql("weather", "b", "bi", "bj", temperature="temperature * 1.8e0 + 32", relative_humidity="relative_humidity * 0.01e0 * 100", wind_speed_20ft="wind_speed_20ft * 2.237045454545455e0")


@query(f"WITH {land.CELLS}, {land.WEATHER} {_FIXED} UNION ALL {_HOURLY}")
def layer_stack(spark, sf_dir):
    """Fixed and hourly layers of a run, from metric and other units, in one table."""
    cells, weather = land.cells(spark, sf_dir).withColumn("steep", F.col("slope") * 100), land.weather(spark, sf_dir).withColumnsRenamed({"bi": "i", "bj": "j"})
    slope = layers.layer(cells, "slope", "steep").withColumn("v", F.round("v", 9))
    return layers.stacked(
        layers.layer(cells, "elevation", "elevation", "metric"), slope, layers.layer(cells, "aspect", "aspect", rotate=45.0), layers.layer(cells, "canopy_cover", "canopy_cover"),
        layers.layer(cells, "crown_bulk_density", "bulk_density", "metric"), layers.layer(weather, "temperature", "temperature", "metric"),
        layers.layer(weather, "relative_humidity", "relative_humidity", "ratio", 0.01), layers.layer(weather, "wind_speed_20ft", "wind_speed_20ft", "metric"),
    )


@query(f"WITH {land.CELLS} SELECT i, j, CASE CAST(aspect AS INT) % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 END AS v FROM cells WHERE CAST(aspect AS INT) % 3 < 2")
def ignition_mask(spark, sf_dir):
    """An inverted ignition layer (-1 burned, 1 unburned, 0 unknown) as a mask."""
    code = F.when(F.col("aspect").cast("int") % 3 == 0, -1.0).when(F.col("aspect").cast("int") % 3 == 1, 1.0).otherwise(0.0)
    return layers.ignition_mask(land.cells(spark, sf_dir).withColumn("code", code), "code", -1.0, 1.0)


def _tiled(spark, sf_dir):
    """The landscape cut into three rows of tiles of 10, 12 and 18 cells and two columns of 15 and 25."""
    r = F.when(F.col("i") < 10, 0).when(F.col("i") < 22, 1).otherwise(2)
    c = F.when(F.col("j") < 15, 0).otherwise(1)
    i0, j0 = F.element_at(F.array(*map(F.lit, (0, 10, 22))), r + 1), F.element_at(F.array(*map(F.lit, (0, 15))), c + 1)
    cells = land.cells(spark, sf_dir).select(r.alias("tile_row"), c.alias("tile_col"), (F.col("i") - i0).alias("i"), (F.col("j") - j0).alias("j"), "elevation", "model")
    tiles = spark.createDataFrame([(a, b, h, w) for a, h in enumerate((10, 12, 18)) for b, w in enumerate((15, 25))], "tile_row int, tile_col int, height long, width long")
    return cells, tiles


@query(f"WITH {land.CELLS} SELECT i, j, elevation, model FROM cells")
def stitched_layer(spark, sf_dir):
    """Tiles of unequal sizes put together are the layer they were cut from."""
    return grid.stitched(*_tiled(spark, sf_dir)).select("i", "j", "elevation", "model")


_FAULTY = """t AS (SELECT CAST(p_partkey // 40 AS INT) AS tile_row, CAST(p_partkey % 40 AS INT) AS tile_col, 10 + CASE WHEN p_partkey % 97 = 5 THEN 1 ELSE 0 END AS height, 20 + CASE WHEN p_partkey % 89 = 7 THEN 1 ELSE 0 END AS width,
 CASE WHEN p_partkey % 83 = 3 THEN 2e0 ELSE 1e0 END AS scale, (p_partkey % 40) * 20e0 + CASE WHEN p_partkey % 79 = 11 THEN 5 ELSE 0 END AS x, -(p_partkey // 40) * 10e0 AS y FROM part WHERE p_partkey % 101 != 50),
w AS (SELECT *, min(height) OVER (PARTITION BY tile_row) AS h0, min(width) OVER (PARTITION BY tile_col) AS w0, min(scale) OVER () AS s0, count(*) OVER (PARTITION BY tile_row) AS have, (SELECT count(DISTINCT tile_col) FROM t) AS n,
 lead(x) OVER (PARTITION BY tile_row ORDER BY tile_col) AS nx, lead(y) OVER (PARTITION BY tile_col ORDER BY tile_row) AS ny FROM t)"""


@query(f"""WITH {_FAULTY} SELECT tile_row, tile_col, 'height' AS fault FROM w WHERE height != h0 UNION ALL SELECT tile_row, tile_col, 'width' FROM w WHERE width != w0 UNION ALL SELECT tile_row, tile_col, 'scale' FROM w WHERE abs(scale - s0) > 1e-6
UNION ALL SELECT tile_row, tile_col, 'missing' FROM w WHERE have != n UNION ALL SELECT tile_row, tile_col, 'right' FROM w WHERE abs(x + width * scale - nx) > 1e-6 UNION ALL SELECT tile_row, tile_col, 'below' FROM w WHERE abs(y - height * scale - ny) > 1e-6""")
def tile_faults(spark, sf_dir):
    """Every part a tile, some of wrong height, width, scale or place, some missing."""
    k, row, col = F.col("p_partkey"), F.expr("p_partkey div 40"), F.col("p_partkey") % 40
    odd = lambda n, at, much: F.when(k % n == at, much).otherwise(0)
    tiles = land.table(spark, sf_dir, "part").where(k % 101 != 50).select(
        row.cast("int").alias("tile_row"), col.cast("int").alias("tile_col"), (odd(97, 5, 1) + 10).alias("height"), (odd(89, 7, 1) + 20).alias("width"),
        (odd(83, 3, 1) + 1.0).alias("scale"), (col * 20.0 + odd(79, 11, 5)).alias("x"), (row * -10.0).alias("y"),
    )
    return grid.tile_faults(tiles)


@query(f"WITH {land.CELLS} SELECT CAST(i // 4 AS INT) AS i, CAST(j // 4 AS INT) AS j, round(avg(elevation), 6) AS elevation FROM cells GROUP BY 1, 2")
def rescaled_layer(spark, sf_dir):
    return rounded(grid.rescaled(land.cells(spark, sf_dir), "elevation", 4), "elevation")


@query(f"WITH {land.CELLS} SELECT 'slope' AS layer, 0 AS b, i, j, CAST(CAST(slope AS FLOAT) AS DOUBLE) AS v FROM cells UNION ALL SELECT 'elevation', 0, i, j, CAST(CAST(elevation AS FLOAT) AS DOUBLE) FROM cells")
def geotiff_layers(spark, sf_dir):
    """Layers encoded as GeoTIFF files of 32-bit floats and decoded again."""
    cells = land.cells(spark, sf_dir)
    files = geotiff.encoded(layers.stacked(layers.layer(cells, "slope", "slope", "ratio"), layers.layer(cells, "elevation", "elevation")), 40, 40, 98.425, 500000.0, 4000000.0)
    return geotiff.decoded(files.select(F.col("layer").alias("path"), "content")).where("v IS NOT NULL")


@query("SELECT CAST(x.i AS INT) AS i, CAST(y.j AS INT) AS j, round(y.j * 30 * tan(radians(20e0)), 9) AS v FROM (SELECT unnest(range(64)) AS i) x, (SELECT unnest(range(48)) AS j) y")
def planar_layer(spark, sf_dir):
    """A plane that rises at 20 degrees: made, not read."""
    return rounded(layers.planar(64, 48, 20.0, 30.0, spark), "v", digits=9)


_PLACED = "SELECT p_partkey, 500000e0 + p_size * 30 AS x, 4000000e0 - p_partkey * 10 AS y, p_size * 2 AS w, p_size AS h FROM part"


@query(f"SELECT p_partkey, x AS xmin, y - 30e0 * h AS ymin, x + 30e0 * w AS xmax, y AS ymax FROM ({_PLACED})")
def layer_bounds(spark, sf_dir):
    size = F.col("p_size")
    e = units.layer_envelope(size * 30 + 500000.0, F.lit(4000000.0) - F.col("p_partkey") * 10, size * 2, size, F.lit(30.0), F.lit(-30.0))
    return land.table(spark, sf_dir, "part").select("p_partkey", e.alias("e")).select("p_partkey", "e.*")


@query(f"WITH {land.CELLS}, box AS (SELECT min(i) AS a, max(i) AS z, min(j) AS l, max(j) AS r FROM cells WHERE slope > 0.058) SELECT CAST(i - a AS INT) AS i, CAST(j - l AS INT) AS j, elevation FROM cells, box WHERE i BETWEEN a AND z AND j BETWEEN l AND r")
def clipped_layer(spark, sf_dir):
    """The layer within the box around its steep cells."""
    cells = land.cells(spark, sf_dir)
    return grid.clipped(cells.select("i", "j", "elevation"), grid.bounding_box(cells, F.col("slope") > 0.058))


@query(f"WITH {land.SIMS} SELECT sim, i, j, CASE WHEN burn_time < 20 THEN 4e0 WHEN burn_time < 300 AND flame_length > 30 THEN 2.5e0 WHEN flame_length > 30 THEN 1e0 WHEN burn_time < 300 THEN 5e0 ELSE 0e0 END AS class FROM sims")
def venn_classes(spark, sf_dir):
    c = grid.venn_class(F.col("flame_length") > 30, F.col("burn_time") < 300, F.col("burn_time") < 20)
    return land.sims(spark, sf_dir).select("sim", "i", "j", c.alias("class"))


_D = {"gi": ("u", "d"), "gj": ("l", "r")}
_DIFF = ", ".join(f"COALESCE(({b}.burn_time - {a}.burn_time) * 0.5e0, {b}.burn_time - c.burn_time, c.burn_time - {a}.burn_time, 0) AS {n}" for n, (a, b) in _D.items())
_NEAR = " ".join(f"LEFT JOIN s {n} ON {n}.sim = q.sim AND {n}.i = q.i + {a} AND {n}.j = q.j + {b}" for n, (a, b) in {"c": (0, 0), "u": (-1, 0), "d": (1, 0), "l": (0, -1), "r": (0, 1)}.items())


@query(f"""WITH {land.SIMS}, s AS (SELECT * FROM sims WHERE burn_time <= 400), v AS (SELECT sim, i, j, flame_length % 360 AS direction, CAST(flame_length AS BIGINT) % 2 = 0 AS here FROM sims), q AS (SELECT sim, i AS vi, j AS vj, direction, CASE WHEN here THEN i ELSE i - 1 END AS i, CASE WHEN here THEN j ELSE j - 1 END AS j FROM v),
g AS (SELECT q.sim, vi, vj, direction, {_DIFF} FROM q {_NEAR})
SELECT sim, vi AS i, vj AS j, round(CASE WHEN gi = 0 AND gj = 0 THEN 1 ELSE (gi * -cos(radians(direction)) + gj * sin(radians(direction))) / sqrt(gi * gi + gj * gj) END, 6) AS cosine FROM g""")
def incidence_cosines(spark, sf_dir):
    """How squarely fronts, by their times of arrival, advance in a direction."""
    sims = land.sims(spark, sf_dir)
    vectors = sims.select("sim", "i", "j", (F.col("flame_length") % 360).alias("direction"), (F.col("flame_length").cast("bigint") % 2 == 0).alias("at_cell"), F.lit(1).alias("di"), F.lit(1).alias("dj"))
    arrivals = sims.select("sim", "i", "j", F.when(F.col("burn_time") <= 400, F.col("burn_time")).otherwise(-1.0).alias("burn_time"))
    return rounded(grid.incidence_cosine(vectors, arrivals, ["sim"]), "cosine").select("sim", "i", "j", "cosine")


@query(f"WITH {land.CELLS}, {land.FUELS} SELECT i, j, round(CASE WHEN canopy_cover > 0 AND canopy_height > 0 THEN 1 / ln((20 + 0.36e0 * (canopy_height / 0.3048e0)) / (0.13e0 * (canopy_height / 0.3048e0))) * (0.555e0 / sqrt(canopy_cover / 3 * (canopy_height / 0.3048e0))) WHEN depth > 0 THEN 1.36e0 * ln((20 + 0.36e0 * depth) / (0.13e0 * depth)) * (ln(1.36e0 / 0.13e0) - 1) ELSE 0e0 END, 6) AS waf FROM cells JOIN fuels USING (model)")
def wind_adjustment_metric(spark, sf_dir):
    waf = surface.wind_adjustment_metric(F.col("depth"), F.col("canopy_height"), F.col("canopy_cover"))
    return land.fueled(spark, sf_dir).select("i", "j", F.round(waf, 6).alias("waf"))


# --- suppression -------------------------------------------------------------------------------------------------


@query(f"""WITH {SLICES}, tw AS (SELECT sim, slice + turn AS at, rate, n FROM slices, (SELECT unnest([0, 72]) AS turn)),
p AS (SELECT a.sim, a.slice AS first, b.n, b.rate, sum(b.n) OVER w AS upto, min(b.n) OVER w AS least FROM slices a JOIN tw b ON a.sim = b.sim AND b.at BETWEEN a.slice AND a.slice + 71 WHERE a.n > 0 WINDOW w AS (PARTITION BY a.sim, a.slice ORDER BY b.at))
SELECT sim, first, CAST(count(*) AS INT) AS length, round(sum(n * rate) / sum(n), 6) AS rate, CAST(sum(n) AS BIGINT) AS n FROM p WHERE least > 0 AND upto - n < 90 GROUP BY sim, first""")
def suppression_segments(spark, sf_dir):
    """The stretch of front from each slice on that holds ninety cells."""
    return rounded(suppression.segments(front_slices(spark, sf_dir), 90), "rate")


@query()
def suppression_choice(spark, sf_dir):
    """Slices to suppress for 200 cells of each fire: slowest stretches first. Rates that tie but for rounding may go either way in SQL."""
    return suppression.chosen(front_slices(spark, sf_dir), 200)


# --- samples -------------------------------------------------------------------------------------------------------


def _poisson_sql(seed: int, mean: float, *keys: str) -> str:
    import math

    top, p, total, steps = int(mean + 8 * mean**0.5 + 12), math.exp(-mean), 0.0, []
    for k in range(top + 1):
        total += p
        steps.append(total)
        p *= mean / (k + 1)
    return f"CAST(len(list_filter([{', '.join(f'{x!r}e0' if 'e' not in repr(x) else repr(x) for x in steps)}], lambda t: t <= {uniform_sql(seed, *keys)})) AS INT)"


@query(f"""WITH {land.CELLS}, s AS (SELECT i, j, 1 + slope * 20 AS mu, 0.1e0 + slope AS sigma, aspect, {_poisson_sql(30, 4.5, 'i', 'j')} AS n FROM cells), b AS (SELECT *, unnest(range(1, n + 1)) AS brand FROM s WHERE n > 0),
d AS (SELECT *, exp(mu + sigma * {normal_sql(40, 'i', 'j', 'brand')}) * 3.281e0 AS along, {normal_sql(50, 'i', 'j', 'brand')} * 30 * 3.281e0 AS across FROM b)
SELECT i, j, CAST(brand AS INT) AS brand, round(along, 4) AS along, round(across, 4) AS across, CAST(i + floor((-along * cos(radians(aspect)) + across * sin(radians(aspect))) / 98.425e0 + 0.5e0) AS BIGINT) AS to_i, CAST(j + floor((along * sin(radians(aspect)) + across * cos(radians(aspect))) / 98.425e0 + 0.5e0) AS BIGINT) AS to_j FROM d""")
def firebrand_landing(spark, sf_dir):
    """Firebrands of every cell: a Poisson number, lognormal and normal distances, the cells where they land."""
    sources = land.cells(spark, sf_dir).select("i", "j", (F.col("slope") * 20 + 1).alias("mu"), (F.col("slope") + 0.1).alias("sigma"), F.lit(30.0).alias("sigma_across"), "aspect")
    thrown = sampling.firebrands(sources, 30, 4.5, ["i", "j"])
    di, dj = spotting.landing(F.col("aspect"), F.col("along"), F.col("across"), 98.425)
    return rounded(thrown.select("i", "j", "brand", "along", "across", (F.col("i") + di).alias("to_i"), (F.col("j") + dj).alias("to_j")), "along", "across", digits=4)


@query(f"""WITH {land.WEATHER}, d AS (SELECT o_orderkey AS sim, CAST((o_custkey % 16) // 4 AS INT) AS i, CAST(o_custkey % 4 AS INT) AS j, CAST(o_orderkey % 720 AS INT) AS b FROM orders),
l AS (SELECT sim, i, j, b, unnest(['temperature', 'relative_humidity', 'fm_1h']) AS param, unnest([40e0 + {uniform_sql(61, 'sim')} * 60, 5e0 + {uniform_sql(62, 'sim')} * 90, [0.02e0, 0.04e0, 0.08e0][CAST(floor({uniform_sql(63, 'sim')} * 3) AS INT) + 1]]) AS drawn FROM d),
f AS (SELECT 'temperature' AS param, b, bi, bj, temperature AS v FROM weather WHERE temperature >= 60 UNION ALL SELECT 'relative_humidity', b, bi, bj, relative_humidity FROM weather WHERE relative_humidity >= 30)
SELECT sim, l.param, round(COALESCE(v, drawn), 9) AS v FROM l LEFT JOIN f ON f.param = l.param AND f.b = l.b AND f.bi = l.i AND f.bj = l.j""")
def simulation_weather(spark, sf_dir):
    """Weather and moisture of a simulation for every order: its cell's and hour's where a layer has them, else a draw."""
    draws = land.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sim"), F.floor((F.col("o_custkey") % 16) / 4).cast("int").alias("i"), (F.col("o_custkey") % 4).cast("int").alias("j"), (F.col("o_orderkey") % 720).cast("int").alias("b"))
    w, sim = land.weather(spark, sf_dir), F.col("sim")
    one = lambda c, least: w.where(F.col(c) >= least).select(F.lit(c).alias("param"), "b", F.col("bi").alias("i"), F.col("bj").alias("j"), F.col(c).alias("v"))
    columns = {"temperature": sampling.drawn(61, (40.0, 100.0), sim), "relative_humidity": sampling.drawn(62, (5.0, 95.0), sim), "fm_1h": sampling.drawn(63, [0.02, 0.04, 0.08], sim)}
    return rounded(layers.per_simulation(one("temperature", 60).union(one("relative_humidity", 30)), draws, columns), "v", digits=9)


@query(f"SELECT o_orderkey AS sim, round({uniform_sql(71, 'o_orderkey')} * (({uniform_sql(73, 'o_orderkey')} * 5 + 10) - ({uniform_sql(72, 'o_orderkey')} * 2)) + {uniform_sql(72, 'o_orderkey')} * 2, 9) AS num_firebrands, round(0.1e0 + {uniform_sql(74, 'o_orderkey')} * 0.2e0, 9) AS crown_share, round((epoch_ms(o_orderdate) + o_orderkey * 1000 - epoch_ms(date_trunc('day', o_orderdate))) * 0.000016667e0, 6) AS start_minutes, date_trunc('day', o_orderdate) + to_milliseconds(CAST(trunc(o_orderkey % 1440 * 1.5e0 * 60000) AS BIGINT)) AS started FROM orders")
def spotting_samples(spark, sf_dir):
    """Spotting parameters drawn between bounds that are drawn themselves, and times of ignition both ways."""
    o, k, day = land.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.date_trunc("day", F.col("o_orderdate"))
    ignited = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + k * 1_000_000)
    out = o.select(
        k.alias("sim"), sampling.between_draws(71, (0.0, 2.0), (10.0, 15.0), k).alias("num_firebrands"), sampling.between_draws(74, 0.1, 0.3, k).alias("crown_share"),
        sampling.start_time(ignited, day).alias("start_minutes"), sampling.started_at(k % 1440 * 1.5, day).cast("timestamp_ntz").alias("started"),
    )
    return rounded(rounded(out, "num_firebrands", "crown_share", digits=9), "start_minutes")


_CRITICAL, _PERCENT = [(1, 140, 30000.0, 0), (141, 204, 10000.0, 1)], [(1, 100, 0.3, 0), (91, 180, 0.6, 1)]


def _ranges_sql(name: str, rows) -> str:
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {v}e0, {p})" for a, b, v, p in rows) + ") AS t(lo, hi, v, pos))"


@query(f"""WITH {land.CELLS}, {_ranges_sql('crit', _CRITICAL)}, {_ranges_sql('pct', _PERCENT)}, x AS (SELECT i, j, canopy_cover > 52 AS crowns, elevation * 10 AS fli, (SELECT arg_min(v, pos) FROM crit WHERE c.model BETWEEN lo AND hi) AS cr, (SELECT arg_min(v, pos) FROM pct WHERE c.model BETWEEN lo AND hi) AS p, {uniform_sql(81, 'i', 'j')} AS u FROM cells c)
SELECT i, j, CASE WHEN crowns THEN 0.5e0 >= u ELSE fli > COALESCE(cr, 0) AND COALESCE(p, 0) >= u END AS spots FROM x""")
def spotting_cells(spark, sf_dir):
    """Which burning cells throw firebrands, by crown share, or fuel ranges of critical intensity and share."""
    c = land.cells(spark, sf_dir)
    made = lambda rows, name: spark.createDataFrame(rows, f"lo int, hi int, {name} double, pos int")
    c = intervals.lookup(c, "model", made(_CRITICAL, "critical"), "critical")
    c = intervals.lookup(c, "model", made(_PERCENT, "share"), "share")
    hit = spotting.spots_at_all(F.col("canopy_cover") > 52, F.lit(0.5), F.col("elevation") * 10, F.col("critical"), F.col("share"), sampling.uniform(81, F.col("i"), F.col("j")))
    return c.select("i", "j", hit.alias("spots"))


@query("SELECT sim, i, j, t, p FROM (SELECT *, row_number() OVER (PARTITION BY sim, i, j ORDER BY p DESC, t) AS r FROM (SELECT CAST(l_linenumber AS INT) AS sim, CAST(l_orderkey % 40 AS INT) AS i, CAST(l_partkey % 40 AS INT) AS j, l_suppkey * 1e0 AS t, l_quantity / 50 AS p FROM lineitem)) WHERE r = 1")
def merged_spots(spark, sf_dir):
    """Spot ignitions of one cell: the most probable, of equal ones the first."""
    spots = land.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("sim"), (F.col("l_orderkey") % 40).cast("int").alias("i"), (F.col("l_partkey") % 40).cast("int").alias("j"), F.col("l_suppkey").cast("double").alias("t"), (F.col("l_quantity") / 50).alias("p"))
    return ensemble.first_of_best(spots)


@query(f"WITH {land.CELLS} SELECT i, j, round(0.5e0 * (pow(elevation * 0.001e0, 0.26e0) * pow(1 + canopy_cover * 0.1e0, 0.11e0)) + 0.2e0, 6) AS mu, round(canopy_cover * 250e0, 6) AS variance FROM cells")
def sardoy_distances(spark, sf_dir):
    mu = spotting.sardoy(F.col("elevation"), F.col("canopy_cover") * 0.1 + 1, 0.5, 0.26, 0.11, 0.2)
    return land.cells(spark, sf_dir).select("i", "j", F.round(mu, 6).alias("mu"), F.round(spotting.distance_variance(F.lit(250.0), F.col("canopy_cover")), 6).alias("variance"))


@query(f"WITH {land.SIMS} SELECT sim, i, j, burn_time > 200 AS ignited_now, flame_length / 400 < 0.5e0 AS overtaken FROM sims")
def fire_predicates(spark, sf_dir):
    """Cells ignited after the clock's last step, and those that a fire of probability 0.5 overtakes."""
    return land.sims(spark, sf_dir).select("sim", "i", "j", ensemble.ignited_since(F.col("burn_time"), F.lit(200.0)).alias("ignited_now"), ensemble.overtaken(F.col("flame_length") / 400, F.lit(0.5)).alias("overtaken"))


# --- parameters ----------------------------------------------------------------------------------------------------


@query(f"WITH {land.CELLS}, w AS (SELECT p_size AS pyrome, avg(p_retailprice) AS a, max(p_retailprice) AS b, min(p_retailprice) AS c FROM part GROUP BY 1), f AS (SELECT pyrome, unnest(['101', '141', '181']) AS name, unnest([a, b, c]) AS value FROM w) SELECT i, j, model, round(COALESCE(value, 1) * 2, 4) AS rate FROM cells LEFT JOIN f ON pyrome = (i + j) % 60 AND CAST(name AS INT) = model // 20 * 20 + 1")
def pyrome_adjustments(spark, sf_dir):
    """Spread rates adjusted by each cell's region and fuel, from a wide table of parameters; 1 where it has none."""
    wide = land.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("pyrome")).agg(F.avg("p_retailprice").alias("101"), F.max("p_retailprice").alias("141"), F.min("p_retailprice").alias("181"))
    factors = tables.lookup_rows(wide, "pyrome").select("pyrome", F.col("name").cast("int").alias("fuel"), "value")
    cells = land.cells(spark, sf_dir).select("i", "j", "model", ((F.col("i") + F.col("j")) % 60).cast("long").alias("pyrome"), (F.floor(F.col("model") / 20) * 20 + 1).cast("int").alias("fuel"))
    return cells.join(factors, ["pyrome", "fuel"], "left").select("i", "j", "model", F.round(F.coalesce("value", F.lit(1.0)) * 2, 4).alias("rate"))


@query("SELECT lo, max(hi) AS hi, v FROM (SELECT CAST(n AS INT) AS lo, CAST(n AS INT) AS hi, CASE p_partkey % 2 WHEN 0 THEN [1e0, 2e0, 3e0][n - p_size + 1] ELSE 5e0 END AS v, p_partkey FROM (SELECT *, unnest(range(p_size, p_size + 3)) AS n FROM part)) GROUP BY lo, v, p_partkey")
def unfolded_settings(spark, sf_dir):
    """Settings with a list or one value over a range of numbers, as one interval a number."""
    value = F.when(F.col("p_partkey") % 2 == 0, "1.0, 2., 3.E+00,").otherwise("5.0")
    settings = land.table(spark, sf_dir, "part").select(F.col("p_size").alias("lo"), (F.col("p_size") + 2).alias("hi"), value.alias("value"))
    return intervals.unfolded(settings, 1, 303)


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(abs(l_quantity * 100 - 1000 - 4000) / 30) AS INT) AS ignition_row, CAST(trunc((l_extendedprice - 500) / 30) AS INT) AS ignition_col, l_suppkey % 24 * 60e0 AS ignition_start_time, l_quantity * 60 AS max_runtime, l_partkey % 128 AS pyrome FROM lineitem")
def fire_stats(spark, sf_dir):
    """Inputs of a simulation from each row of a summary whose numbers are Fortran text."""
    fortran = lambda c: F.format_string(" 0.%sE+02 ", F.lpad(F.round(c * 100).cast("bigint").cast("string"), 4, "0"))
    rows = land.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 24).cast("string").alias("metband"), F.col("l_extendedprice").cast("string").alias("x"), (F.col("l_quantity") * 100).cast("string").alias("y"),
        fortran(F.col("l_quantity")).alias("tstop"), (F.col("l_partkey") % 128).cast("string").alias("pyrome"),
    )
    return tables.fire_stats(rows, 30.0, 500.0, 1000.0, 4000.0, keep=["l_orderkey", "l_linenumber"])


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'boolean' WHEN 1 THEN 'number' WHEN 2 THEN 'list' ELSE 'text' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN CAST(p_size AS DOUBLE) * 10 END AS number, CASE WHEN p_partkey % 4 = 2 THEN p_size * 2e0 END AS total FROM part")
def namelist_values(spark, sf_dir):
    """What kind of value each setting has."""
    k = F.col("p_partkey") % 4
    value = F.when(k == 0, ".TRUE.").when(k == 1, F.format_string("%d.E+01", "p_size")).when(k == 2, F.format_string("%d., %d.0,", "p_size", "p_size")).otherwise(F.col("p_type"))
    v = land.table(spark, sf_dir, "part").select("p_partkey", tables.namelist_value(value).alias("v"))
    return v.select("p_partkey", "v.kind", "v.number", F.aggregate("v.list", F.lit(0.0), lambda a, b: a + b).alias("total"))


# --- weather readings and replays ---------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT user_id % 16 AS cell, CAST(row_number() OVER (PARTITION BY user_id % 16 ORDER BY value DESC, event_id) AS INT) AS rank, 0.87e0 * value AS ws, CAST(event_id % 360 AS INT) AS wd FROM events) WHERE rank <= 73")
def extreme_weather(spark, sf_dir):
    """The 73 strongest readings of each weather cell: a top-k report."""
    w = Window.partitionBy("cell").orderBy(F.desc("value"), "event_id")
    e = land.table(spark, sf_dir, "events").withColumn("cell", F.col("user_id") % 16)
    return e.withColumn("rank", F.row_number().over(w)).where("rank <= 73").select("cell", "rank", (F.col("value") * 0.87).alias("ws"), (F.col("event_id") % 360).cast("int").alias("wd"))


@query("SELECT cell, event_id, ws FROM (SELECT user_id % 16 AS cell, event_id, 0.87e0 * value AS ws, row_number() OVER (PARTITION BY user_id % 16 ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id % 16) AS n FROM events) WHERE r * 100 BETWEEN n * 74 AND n * 76")
def midrange_weather(spark, sf_dir):
    """Readings between the 74th and the 76th percentile of each weather cell."""
    by_cell = Window.partitionBy("cell")
    e = land.table(spark, sf_dir, "events").withColumn("cell", F.col("user_id") % 16)
    placed = e.withColumns({"r": F.row_number().over(by_cell.orderBy("value", "event_id")), "n": F.count("*").over(by_cell)})
    return placed.where((F.col("r") * 100).between(F.col("n") * 74, F.col("n") * 76)).select("cell", "event_id", (F.col("value") * 0.87).alias("ws"))


@query("SELECT l_suppkey % 40 AS cell, count(*) AS n, round(avg(l_quantity), 2) AS fire_size, round(avg(l_discount), 4) AS flame_length, 100 - max(l_linenumber) / 36e0 AS percentile FROM lineitem GROUP BY 1")
def cell_averages(spark, sf_dir):
    """Mean behaviour of the fires of each weather cell."""
    l = land.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("cell"))  # noqa: E741
    return l.agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 2).alias("fire_size"), F.round(F.avg("l_discount"), 4).alias("flame_length"), (100 - F.max("l_linenumber") / 36.0).alias("percentile"))


@query("SELECT o_custkey % 1000 AS fire, o_orderkey, md5(concat_ws('|', o_custkey % 1000, o_orderkey)) AS pair_hash FROM orders ORDER BY pair_hash LIMIT 64")
def replay_sample(spark, sf_dir):
    """A stable choice of 64 pairs to replay: those of smallest hash."""
    o = land.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 1000).alias("fire"), "o_orderkey")
    return replay.smallest_hashes(o, ["fire", "o_orderkey"], 64)


@query(f"""WITH {land.SIMS}, s AS (SELECT 'v' || sim % 3 AS variation, i % 48 + 1e0 AS hours, count(*) FILTER (flame_length > 30) AS real, count(*) FILTER (burn_time < 100 AND flame_length > 30) AS b, count(*) FILTER (burn_time < 100 AND flame_length <= 30) AS s_r, count(*) FILTER (burn_time >= 100 AND flame_length > 30) AS r_s FROM sims GROUP BY sim, i),
w AS (SELECT *, pow(hours / 12, 2) * exp(-hours / 12) AS w FROM s)
SELECT variation, count(*) AS n, count(*) FILTER (b + s_r = 0) AS failed, round(sum(w * CASE WHEN real = 0 THEN 0 ELSE s_r / real END) / sum(w), 6) AS over, round(sum(w * CASE WHEN real = 0 THEN 0 ELSE r_s / real END) / sum(w), 6) AS under FROM w GROUP BY variation""")
def variation_scores(spark, sf_dir):
    """Replays of each variation: failures and weighted shares of cells over- and underpredicted."""
    s = land.sims(spark, sf_dir)
    counts = replay.confusion(s, ["sim", "i"], F.col("burn_time") < 100, F.col("flame_length") > 30)
    scores = counts.select(F.concat(F.lit("v"), F.col("sim") % 3).alias("variation"), (F.col("i") % 48 + 1.0).alias("hours"), (F.col("both") + F.col("real_minus_sim")).alias("real"), "both", "sim_minus_real", "real_minus_sim")
    return rounded(replay.variations(scores, 24.0), "over", "under")


# --- text and streams ------------------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS compact, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS spaced FROM events")
def date_formats(spark, sf_dir):
    e = land.table(spark, sf_dir, "events")
    compact = F.date_format(F.col("ts"), "yyyyMMdd_HHmmss")
    return e.select("event_id", compact.alias("compact"), F.concat(text.reformat_date(compact, "yyyyMMdd_HHmmss", "yyyy-MM-dd HH:mm"), F.lit(" UTC")).alias("spaced"))


@query("SELECT p_partkey, lower(p_type) AS spaced, replace(lower(p_type), ' ', '-') AS kebab, list_reduce(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || b) AS joined, replace(lower(p_type), ' ', '_') AS snake FROM part")
def name_styles(spark, sf_dir):
    """Names from one style to another and back."""
    kebab = F.replace(F.lower("p_type"), F.lit(" "), F.lit("-"))
    camel = text.kebab_to_camel(kebab)
    back = text.camel_to_kebab(camel)
    return land.table(spark, sf_dir, "part").select("p_partkey", F.replace(back, F.lit("-"), F.lit(" ")).alias("spaced"), text.snake_to_kebab(text.kebab_to_snake(back)).alias("kebab"), F.concat(F.upper(F.substring(camel, 1, 1)), F.substring(camel, 2, 1000)).alias("joined"), text.kebab_to_snake(kebab).alias("snake"))


@query("SELECT event_id, CASE WHEN event_id % 5 != 0 THEN 'fire-' || user_id END AS fire, CASE WHEN event_id % 5 != 0 THEN CAST(event_id % 1000 AS INT) END AS subnumber, CASE WHEN event_id % 5 != 0 THEN date_trunc('second', ts) END AS at, printf('+%2dhr', CAST(floor(epoch_us(ts - date_trunc('month', ts)) / 3.6e9 + 0.5e0) AS BIGINT)) AS hours, CASE event_id % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'burned' END AS useful FROM events")
def snapshot_names(spark, sf_dir):
    """Fire, number and time of snapshot archives by their names; files of use in them."""
    k, ts = F.col("event_id"), F.col("ts")
    tail = F.when(k % 5 == 0, ".zip").otherwise(".tar.gz")
    path = F.concat(F.lit("/in/decks/fire-"), F.col("user_id"), F.date_format("ts", "_yyyyMMdd_HHmmss_"), F.lpad((k % 1000).cast("string"), 3, "0"), tail)
    entry = F.when(k % 3 == 0, "a/b/front.shp").when(k % 3 == 1, "a/fuels/already_burned.tif").otherwise("a/readme.txt")
    e = land.table(spark, sf_dir, "events").withColumn("s", text.parse_snapshot(path))
    useful = text.useful_file(entry, {"/front.shp": "polygon", "/fuels/already_burned.tif": "burned"})
    return e.select("event_id", "s.fire", "s.subnumber", F.col("s.at").cast("timestamp_ntz").alias("at"), text.hours_between(F.date_trunc("month", ts), ts).alias("hours"), useful.alias("useful"))


@query(f"WITH {land.SIMS} SELECT sim, i, j, 'flame_length' || CASE WHEN sim % 2 = 0 THEN '_max' ELSE '' END || '_' || lpad(CAST(sim AS VARCHAR), 4, '0') || CASE WHEN burn_time > 100 THEN '_t' || CAST(CAST(burn_time AS INT) AS VARCHAR) ELSE '' END || '.tif' AS name FROM sims")
def output_names(spark, sf_dir):
    suffix, minute = F.when(F.col("sim") % 2 == 0, "max").otherwise(""), F.when(F.col("burn_time") > 100, F.col("burn_time").cast("int"))
    return land.sims(spark, sf_dir).select("sim", "i", "j", tables.output_name(F.lit("flame_length"), suffix, F.col("sim"), minute, "tif").alias("name"))


@query("SELECT date_trunc('hour', ts) AS \"start\", date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", CAST(user_id % 40 AS INT) AS i, CAST(event_id % 40 AS INT) AS j, count(*) AS burn_count FROM events GROUP BY 1, 2, 3, 4")
def live_burn_counts(spark, sf_dir):
    """Burned cells by the hour, as the stream counts them."""
    e = land.table(spark, sf_dir, "events").select("ts", (F.col("user_id") % 40).cast("int").alias("i"), (F.col("event_id") % 40).cast("int").alias("j"))
    return watch.live_counts(e)


@query("SELECT event_id, contains('/data/' || event_type || '/x', 'click') OR contains('/data/' || event_type || '/x', '/purchase/') AS allowed FROM events")
def allowed_paths(spark, sf_dir):
    """Whether a white list lets a deck's suppressed twin run."""
    path = F.concat(F.lit("/data/"), F.col("event_type"), F.lit("/x"))
    return land.table(spark, sf_dir, "events").select("event_id", watch.allowed(path, ["click", "/purchase/"]).alias("allowed"))


@query("SELECT event_id, 'fire-' || user_id AS fire_name, 'active-fire' AS type, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS ignition_time, 'fire-' || user_id || strftime(ts, '_%Y%m%d_%H%M00_001') AS deck, date_trunc('hour', ts) AS weather_start FROM events")
def deck_jobs(spark, sf_dir):
    """Jobs by the paths of decks, the decks' names by their jobs."""
    e = land.table(spark, sf_dir, "events")
    path = F.concat(F.lit("/in/fire-"), F.col("user_id"), F.date_format("ts", "_yyyyMMdd_HHmmss"), F.lit("_001.tar"))
    j = e.select("event_id", text.job_of(path).alias("j"), text.weather_start(F.col("ts")).alias("weather_start"))
    deck = text.deck_name(F.col("j.fire_name"), F.regexp_replace("j.ignition_time", " UTC$", ""))
    return j.select("event_id", "j.*", deck.alias("deck"), "weather_start")


@query("SELECT event_id, '{\"fireName\":\"fire-' || user_id || '\",\"status\":' || CAST(event_id % 3 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN ',\"responseHost\":\"' || event_type || '\"' ELSE '' END || '}' AS message, 'fire-' || user_id AS fire_name, CAST(event_id % 3 AS INT) AS status, CASE WHEN event_id % 2 = 0 THEN event_type END AS response_host FROM events")
def request_messages(spark, sf_dir):
    """Messages written as JSON with camel-case names and read back."""
    fields = {"fire-name": F.concat(F.lit("fire-"), F.col("user_id")), "status": (F.col("event_id") % 3).cast("int"), "response-host": F.when(F.col("event_id") % 2 == 0, F.col("event_type"))}
    e = land.table(spark, sf_dir, "events").select("event_id", text.response(fields).alias("message"))
    return e.select("event_id", "message", text.request(F.col("message"), {"fire-name": "string", "status": "int", "response-host": "string"}).alias("r")).select("event_id", "message", "r.*")


@query(f"WITH {land.CELLS}, {land.SIMS} SELECT sim, round(avg(slope), 9) AS mean FROM sims JOIN cells USING (i, j) GROUP BY sim")
def mean_difficulty(spark, sf_dir):
    return rounded(suppression.mean_index(land.sims(spark, sf_dir), land.cells(spark, sf_dir), "slope"), "mean", digits=9)


@query(f"WITH {land.SIMS}, a AS (SELECT sim, i, count(*) AS n, max(burn_time) AS late FROM sims WHERE burn_time < 300 GROUP BY 1, 2), b AS (SELECT sim, i, count(*) AS n, min(burn_time) AS early FROM sims WHERE burn_time >= 200 GROUP BY 1, 2) SELECT COALESCE(a.sim, b.sim) AS sim, COALESCE(a.i, b.i) AS i, COALESCE(b.n, a.n) AS n, late, early FROM a FULL JOIN b ON a.sim = b.sim AND a.i = b.i")
def merged_statistics(spark, sf_dir):
    """Statistics of two runs over the same replays beside each other."""
    s = land.sims(spark, sf_dir)
    a = s.where("burn_time < 300").groupBy("sim", "i").agg(F.count("*").alias("n"), F.max("burn_time").alias("late"))
    b = s.where("burn_time >= 200").groupBy("sim", "i").agg(F.count("*").alias("n"), F.min("burn_time").alias("early"))
    return replay.merged(a, b, ["sim", "i"])


@query("SELECT CAST(row_number() OVER (ORDER BY moisture DESC, cell) AS INT) AS place, cell, moisture FROM (SELECT user_id % 16 AS cell, CAST(sum(CAST(round(value * 100) AS BIGINT)) % 97 AS BIGINT) AS moisture FROM events GROUP BY 1)")
def weather_cells(spark, sf_dir):
    """The sixteen weather cells, the moistest first."""
    e = land.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 16).alias("cell")).agg((land.cents("value") % 97).alias("moisture"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("moisture"), "cell"))).select("place", "cell", "moisture")


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
