"""Rasters, suppression, samples and text against plain versions and published values; the queries of workflows against SQL."""

import math
import os
import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderframe.functions import containment, crown, fuels, spotting, surface, text, units
from cinderframe.operators import ensemble, grid, layers, replay, sampling, suppression
from cinderframe.plans import workflows
from cinderframe.sources import database, geotiff, tables

SF = "/root/testdata/sf0.001"
#: Fixed values (BehavePlus 5, half cured fuel without wind and slope): rate (ch/h), reaction intensity (Btu/ft2/min).
HALF_CURED = """
GR1 0.6 448, GR2 1.1 1140, GR3 1.2 1435, GR4 2.2 2233, GR5 2.1 3998, GR6 2.8 5852, GR7 4.2 7937, GR8 3.6 9254, GR9 6.4 13981, GS1 0.8 1345,
GS2 1.2 2291, GS3 1.5 3429, GS4 2.5 16001, SH1 0.1 369, SH2 0.8 6083, SH3 0.3 1981, SH4 1.8 3610, SH5 2.9 5720, SH6 1.6 5375, SH7 2.4 7668,
SH8 1.7 8462, SH9 3.0 14085, TU1 0.3 1816, TU2 1.0 2059, TU3 1.6 3828, TU4 1.4 6882, TU5 1.2 9075, TL1 0.1 527, TL2 0.2 769, TL3 0.2 881,
TL4 0.3 1101, TL5 0.5 1751, TL6 0.7 2500, TL7 0.4 1779, TL8 0.9 3617, TL9 1.3 5243, SB1 0.8 2753, SB2 1.7 5547, SB3 2.8 7633, SB4 4.5 8049
"""
#: Fixed values (the same with 10 mph midflame wind from 90 degrees, 20 % slope of aspect 180): rate (ch/h), direction, effective wind (mph).
CROSS_WIND = """
GR1 11.9 271 4.6, GR2 70.5 271 10, GR3 82.4 271 10, GR4 145.2 271 10, GR5 111.3 271 10, GR6 145.5 271 10, GR7 218.7 271 10, GR8 177.7 271 10, GR9 318.9 271 10, GS1 46.1 271 10,
GS2 69.3 271 10, GS3 83.3 271 10, GS4 82.9 272 10, SH1 2.1 271 3.8, SH2 23.9 272 10, SH3 12.3 272 10, SH4 105.9 271 10, SH5 170.3 271 10, SH6 66.5 272 10, SH7 110.9 271 10,
SH8 67.9 272 10, SH9 120.8 272 10, TU1 9.3 272 10, TU2 39.6 271 10, TU3 75.7 271 10, TU4 45.4 271 10, TU5 25.2 272 10, TL1 1.2 272 5.4, TL2 3.1 272 7.9, TL3 4.3 272 9,
TL4 7.2 272 10, TL5 13.7 272 10, TL6 19.2 271 10, TL7 7.4 272 10, TL8 18.3 272 10, TL9 27 272 10, SB1 18.8 272 10, SB2 48.9 271 10, SB3 89.9 271 10, SB4 173.6 271 10
"""


def values(table):
    return {name: list(map(float, rest)) for name, *rest in (row.split() for row in table.replace("\n", " ").split(","))}


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def half_cured(spark):
    moist = {"fm_1h": 0.04, "fm_10h": 0.04, "fm_100h": 0.06, "fm_herb": 0.75, "fm_woody": 0.70}
    return surface.with_minimum_spread(fuels.fuel_models(spark, synonyms=False).where("model > 100").withColumns({k: F.lit(v) for k, v in moist.items()}))


def test_published_spread(spark):
    out = half_cured(spark)
    got = {r.name: r for r in out.select("name", (F.col("base_rate") / 1.1).alias("rate"), "reaction_intensity").collect()}
    assert got.keys() == values(HALF_CURED).keys()
    for name, (rate, reaction) in values(HALF_CURED).items():
        assert abs(got[name].rate - rate) <= 0.1 and abs(got[name].reaction_intensity - reaction) <= 12, name
    out = surface.with_maximum_spread(out, F.lit(880.0), F.lit(90.0), F.lit(0.2), F.lit(180.0), F.lit(1.0), F.lit(1.0))
    got = {r.name: r for r in out.select("name", (F.col("max_rate") / 1.1).alias("rate"), "max_direction", (F.col("effective_wind") / 88).alias("wind")).collect()}
    for name, (rate, direction, wind) in values(CROSS_WIND).items():
        r = got[name]
        assert abs(r.rate - rate) <= 0.3 and abs(r.max_direction - direction) <= 0.5 and abs(r.wind - wind) <= 0.1, (name, r)


def test_grass_suppression(spark):
    moist = {"fm_1h": 0.04, "fm_10h": 0.04, "fm_100h": 0.06, "fm_herb": 0.75, "fm_woody": 0.70}
    cells = fuels.fuel_models(spark, synonyms=False).withColumns({k: F.lit(v) for k, v in moist.items()})
    plain, slow = ({r.model: r.base_rate for r in surface.with_minimum_spread(cells, s).collect()} for s in (False, True))
    assert all(math.isclose(slow[m], plain[m] * (0.5 if 101 <= m <= 109 else 1.0), rel_tol=1e-12) for m in plain)


def test_embers(spark):
    """Rotation by the wind, and the cells where embers come down."""
    r = math.sqrt(0.5)
    turned = {0: (0, -1), 45: (r, -r), 90: (1, 0), 135: (r, r), 180: (0, 1), 225: (-r, r), 270: (-1, 0), 315: (-r, -r), 360: (0, -1)}
    for w, (x, y) in turned.items():
        dy, dx = one(spark, *(c for c in spotting.landing(F.lit(float(w)), F.lit(1e6), F.lit(0.0), 1.0)))
        assert abs(dx / 1e6 - x) < 0.01 and abs(dy / 1e6 - y) < 0.01
    cases = [((1, 0), 0, (8, 12)), ((10, 0), 0, (7, 12)), ((10, 0), 90, (8, 13)), ((10, 0), 180, (9, 12)), ((10, 0), 270, (8, 11)), ((10, 10), 0, (7, 13)), ((10, 10), 90, (9, 13)), ((10, 10), 180, (9, 11)), ((10, 10), 270, (7, 11)), ((200, 0), 0, (-12, 12)), ((200, 0), 270, (8, -8))]
    for (along, across), w, (i, j) in cases:
        di, dj = one(spark, *spotting.landing(F.lit(float(w)), F.lit(float(along)), F.lit(float(across)), 10.0))
        assert (8 + di, 12 + dj) == (i, j)
    assert math.isclose(one(spark, spotting.maximum_height(F.lit(0.003)))[0], 117.0)
    mu, sigma = spotting.lognormal(F.lit(40.0), F.lit(300.0))
    mean, spread = one(spark, spotting.lognormal_mean_feet(mu, sigma), spotting.lognormal_variation(sigma))
    assert math.isclose(mean, 40 * 3.281) and math.isclose(spread, math.sqrt(300) / 40)


def test_crown_shapes(spark):
    got = one(spark, *(crown.length_to_width(F.lit(w), F.lit(a)) for w, a in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (1.0, 2.0))), *(crown.eccentricity(F.lit(1.0), F.lit(a)) for a in (0.0, 1.0, 4.0, 10.0)))
    assert np.allclose(got, (1, 1, 1.125, 1.25, 0, 0.45, 0.75, 0.9), rtol=0.05)
    assert abs(one(spark, surface.normal_rate(F.lit(0.5), F.lit(1.0)))[0] - 1.0) < 1e-12


def test_front_angles(spark):
    around = [(10, 11), (11, 11), (11, 10), (11, 9), (10, 9), (9, 9), (9, 10), (9, 11)]
    assert np.allclose(one(spark, *(containment.bearing(F.lit(i), F.lit(j), F.lit(10), F.lit(10)) for i, j in around)), range(0, 360, 45))
    assert one(spark, *(containment.slice_of(F.lit(d), 5.0) for d in (0.0, 2.5, 5.0, 7.5, 10.0, 12.5, 15.0))) == [0, 0, 1, 1, 2, 2, 3]


def plain_segments(rates, counts, needed):
    n, out = len(counts), {}
    for first in range(n):
        length, held, total = 0, 0, 0.0
        while length < n and held < needed and counts[(first + length) % n]:
            k = (first + length) % n
            held, total, length = held + counts[k], total + counts[k] * rates[k], length + 1
        if held:
            out[first] = (length, held, total / held)
    return out


def plain_choice(rates, counts, needed):
    chosen, n = {}, len(counts)
    found = plain_segments(rates, counts, needed)
    for first in sorted(found, key=lambda s: (found[s][2], s)):
        for k in range(found[first][0]):
            s = (first + k) % n
            if sum(chosen.values()) < needed:
                chosen.setdefault(s, counts[s])
    return set(chosen)


def test_suppression(spark):
    """Stretches of front around the circle: known cases, and random ones with gaps, against a loop."""
    cases = [([6.0, 5.0, 4.0, 3.0, 2.0, 1.0], [2] * 6, 6), ([2.0, 1.0, 6.0, 5.0, 4.0, 3.0], [2] * 6, 6), ([2.0] * 4, [25] * 4, 100)]
    rnd = random.Random(4)
    cases += [([float(rnd.randint(1, 9)) for _ in range(6)], [rnd.choice((0, 1, 2, 5)) for _ in range(6)], rnd.randint(1, 9)) for _ in range(12)]
    for needed in sorted({c[2] for c in cases}):
        own = [(k, c) for k, c in enumerate(cases) if c[2] == needed]
        df = spark.createDataFrame([(k, s, r, n) for k, (rates, counts, _) in own for s, (r, n) in enumerate(zip(rates, counts))], "sim int, slice int, rate double, n long")
        got: dict = {}
        for r in suppression.segments(df, needed, 60.0).collect() if len(own[0][1][1]) == 6 else suppression.segments(df, needed, 90.0).collect():
            got.setdefault(r.sim, {})[r["first"]] = (r.length, r.n, r.rate)
        for k, (rates, counts, _) in own:
            want = plain_segments(rates, counts, needed)
            assert got.get(k, {}).keys() == want.keys() and all(got[k][s][:2] == want[s][:2] and math.isclose(got[k][s][2], want[s][2]) for s in want)
        picked: dict = {}
        for r in suppression.chosen(df, needed, 360.0 / len(own[0][1][1])).collect():
            picked.setdefault(r.sim, set()).add(r.slice)
        assert {k: picked.get(k, set()) for k, _ in own} == {k: plain_choice(*c) for k, c in own}


def test_slices_are_filled(spark):
    vectors = spark.createDataFrame([(1, 10, 11, 2.0), (1, 10, 11, 4.0), (1, 10, 9, 5.0), (1, 11, 10, 1.0), (1, 10, 12, 3.0)], "sim int, i int, j int, spread_rate double")
    got = {r.slice: (r.rate, r.n) for r in suppression.slices(vectors).collect()}
    assert len(got) == 72 and {s: v for s, v in got.items() if v[1]} == {0: (3.0, 2), 36: (5.0, 1), 18: (1.0, 1)}


def test_bands_and_summary(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.0, 2.0, 10.0, 1), (1, 0, 1, 5.0, 0.0, 20.0, 2), (1, 1, 1, 20.0, 4.0, 0.0, 3), (2, 0, 0, 11.0, -1.0, 0.0, 1), (2, 0, 1, -1.0, 9.0, 9.0, 1)], "sim int, i int, j int, burn_time double, flame_length double, fire_line_intensity double, fire_type int")
    got = {(r.band, r.i, r.j): r.burn_count for r in ensemble.burn_counts(cells, 10.0, 25.0).collect()}
    assert got == {(0, 0, 0): 1, (1, 0, 0): 1, (2, 0, 0): 2, (1, 0, 1): 1, (2, 0, 1): 1, (2, 1, 1): 1}
    spots = spark.createDataFrame([(1, 5), (1, 6)], "sim int, at int")
    r = {x.sim: x for x in ensemble.summary(cells, 660.0, spots).collect()}
    assert (r[1].fire_size, r[1].surface_fire_size, r[1].crown_fire_size, r[1].spot_count) == (30.0, 10.0, 20.0, 2)
    assert (r[1].flame_length_mean, r[1].flame_length_stddev, r[1].fire_line_intensity_mean) == (3.0, 1.0, 15.0)
    assert math.isclose(r[1].fire_line_intensity_stddev, 5.0) and r[2].flame_length_mean is None and r[2].spot_count == 0
    assert {(x.i, x.spot_count) for x in ensemble.spot_counts(spark.createDataFrame([(1, 2), (1, 2), (3, 2)], "i int, j int")).collect()} == {(1, 2), (3, 1)}


def test_percentiles(spark):
    rows = [(1, float(v)) for v in (15, 20, 35, 40, 50)] + [(2, 7.0), (1, float("nan")), (1, None), (1, 20.0)]
    got = {r.k: tuple(r)[1:] for r in replay.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", [1, 40, 50, 95]).collect()}
    assert got == {1: (15.0, 20.0, 27.5, 50.0), 2: (7.0,) * 4}


def test_set_operations_on_repeated_cells(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "i int, j int")
    b = spark.createDataFrame([(1, 1)], "i int, j int")
    assert [tuple(r) for r in grid.except_cells(a, b).collect()] == [(2, 2)]


def test_draws(spark):
    n = spark.range(4000)
    k = F.col("id")
    r = n.select(F.avg(sampling.poisson(3, 4.0, k)), F.var_pop(sampling.poisson(3, 4.0, k)), F.avg(sampling.normal(5, 2.0, 3.0, k)), F.stddev_pop(sampling.normal(5, 2.0, 3.0, k)), F.avg(F.ln(sampling.lognormal(9, F.lit(1.0), F.lit(0.5), k)))).first()
    assert np.allclose(list(r), (4, 4, 2, 3, 1), atol=0.25)
    assert n.select(F.count_distinct(sampling.uniform(1, k))).first()[0] == 4000
    sites = sampling.ignition_sites(spark.createDataFrame([], "i int, j int"), 5, F.lit(True), 1)
    assert sites.count() == 0


def test_firebrands_draw_once_a_source(spark):
    """Counts are drawn after the sources are grouped, not for each of their rows, and not again for each step of the inversion."""
    rows = spark.range(6000).select((F.col("id") % 30).cast("int").alias("i"), (F.col("id") % 20).cast("int").alias("j"))
    sources = rows.groupBy("i", "j").agg((F.count("*") * 0.01).alias("mu")).withColumns({"sigma": F.lit(0.5), "sigma_across": F.lit(30.0)})
    thrown = sampling.firebrands(sources, 30, 1.5, ["i", "j"])
    plan = thrown._jdf.queryExecution().optimizedPlan().toString()
    assert "filter([" in plan and "Range" in plan
    assert not any("md5(" in x for x in plan.partition("Aggregate [")[2].splitlines()[1:]) and "md5(" not in plan.partition("filter([")[2]
    draws = sources.select("i", "j", sampling.uniform(30, F.col("i"), F.col("j"))).collect()
    steps = np.cumsum([math.exp(-1.5) * 1.5**k / math.factorial(k) for k in range(20)])
    want = {(i, j, b) for i, j, u in draws for b in range(1, int((steps <= u).sum()) + 1)}
    got = [tuple(r) for r in thrown.select("i", "j", "brand").collect()]
    assert set(got) == want and len(got) == len(want) and len({x[:2] for x in want}) < len(draws) == 60


@pytest.mark.parametrize("kind", ["<i2", ">f4", "<f8", ">u1", "<u4"])
def test_geotiff_layouts(kind):
    """Strips, tiles, interleaved and apart, packed, predicted, of both byte orders, built by hand."""
    rng = np.random.default_rng(1)
    data = rng.integers(0, 200, (2, 5, 7)).astype(np.dtype(kind).newbyteorder("="))
    order = kind[0] if kind[1:] != "u1" else ">"
    for tiled, apart, packed, predicted in ((0, 0, 0, 0), (0, 1, 1, 0), (1, 0, 1, 1), (1, 1, 0, 0)):
        if predicted and data.dtype.kind == "f":
            continue
        import zlib

        tw, th = (4, 4) if tiled else (7, 2)
        parts = []
        for bands in ([data[:1], data[1:]] if apart else [data]):
            for r in range(0, 5, th):
                for c in range(0, 7, tw):
                    part = bands[:, r : r + th, c : c + tw]
                    if tiled:
                        part = np.pad(part, ((0, 0), (0, th - part.shape[1]), (0, tw - part.shape[2])))
                    part = np.moveaxis(part, 0, 2)
                    if predicted:
                        part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1).astype(data.dtype)
                    raw = part.astype(np.dtype(kind).newbyteorder(order)).tobytes()
                    parts.append(zlib.compress(raw) if packed else raw)
        at, starts = 8, []
        for x in parts:
            starts.append(at)
            at += len(x)
        form = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
        tags = [(256, 3, [7]), (257, 3, [5]), (258, 3, [data.itemsize * 8] * 2), (259, 3, [8 if packed else 1]), (277, 3, [2]), (284, 3, [2 if apart else 1]), (317, 3, [2 if predicted else 1]), (339, 3, [form] * 2)]
        tags += [(322, 3, [tw]), (323, 3, [th]), (324, 4, starts), (325, 4, [len(x) for x in parts])] if tiled else [(273, 4, starts), (278, 3, [th]), (279, 4, [len(x) for x in parts])]
        code, end, entries, more = {3: "H", 4: "I"}, at + 2 + 12 * len(tags) + 4, b"", b""
        for t, k, v in sorted(tags):
            raw = struct.pack(f"{order}{len(v)}{code[k]}", *v)
            if len(raw) > 4:
                entries += struct.pack(order + "HHII", t, k, len(v), end + len(more))
                more += raw
            else:
                entries += struct.pack(order + "HHI", t, k, len(v)) + raw.ljust(4, b"\0")
        file = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + b"".join(parts) + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + more
        got, _ = geotiff.decode(file)
        assert (got == data).all(), (tiled, apart, packed, predicted)


def test_geotiff_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    cells = spark.createDataFrame([("a", b, int(i), int(j), float(v)) for b in range(2) for (i, j), v in np.ndenumerate(rng.random((70, 9)).astype(np.float32)) if (i + j) % 5], "layer string, b int, i int, j int, v double")
    (tmp_path / "a.tif").write_bytes(geotiff.encoded(cells, 70, 9, 30.0, 500.0, 9000.0).first().content)
    got = {(r.b, r.i, r.j): r.v for r in geotiff.read_geotiff(spark, f"{tmp_path}/a.tif").collect()}
    assert {k: v for k, v in got.items() if v is not None} == {(r.b, r.i, r.j): r.v for r in cells.collect()} and len(got) == 2 * 70 * 9
    r = geotiff.envelopes(spark, f"{tmp_path}/a.tif").first()
    assert (r.bands, r.height, r.width, r.scale, r.x, r.y) == (2, 70, 9, 30.0, 500.0, 9000.0)
    for bad in (b"not a tiff", b"II" + struct.pack("<HI", 43, 8)):
        with pytest.raises(ValueError):
            geotiff.decode(bad)


def test_tiles(spark):
    """A raster of 3 by 2 tiles is whole; each kind of fault is found where it is."""
    heights, widths = (42, 61, 17), (27, 53)
    rows = [(a, b, h, w, 1.0, float(sum(widths[:b])), -float(sum(heights[:a]))) for a, h in enumerate(heights) for b, w in enumerate(widths)]
    kind = "tile_row int, tile_col int, height long, width long, scale double, x double, y double"
    assert grid.tile_faults(spark.createDataFrame(rows, kind)).count() == 0
    broken = [*rows[:5], (2, 1, 17, 53, 1.0, 28.0, -103.0)]
    assert {tuple(r) for r in grid.tile_faults(spark.createDataFrame(broken, kind)).collect()} == {(2, 0, "right")}
    assert {r.fault for r in grid.tile_faults(spark.createDataFrame(rows[:5], kind)).collect()} == {"missing"}


def test_text(spark):
    got = one(spark, text.camel_to_kebab(F.lit("someFireName")), text.kebab_to_camel(F.lit("some-fire-name")), text.kebab_to_camel(F.lit("one")), text.snake_to_kebab(F.lit("a_b")), text.kebab_to_snake(F.lit("a-b")), text.reformat_date(F.lit("20220719_165409"), "yyyyMMdd_HHmmss", "yyyy-MM-dd HH:mm"), text.reformat_date(F.lit("no date"), "yyyyMMdd_HHmmss", "yyyy"), text.file_name(F.lit("/a/b/c.tif")))
    assert got == ["some-fire-name", "someFireName", "one", "a-b", "a_b", "2022-07-19 16:54", None, "c.tif"]
    s = one(spark, text.parse_snapshot(F.lit("/x/wa-silver-lake_20220806_060400_001.tar.gz")), text.parse_snapshot(F.lit("other.tar.gz")))
    assert (s[0].fire, s[0].subnumber, str(s[0].at)) == ("wa-silver-lake", 1, "2022-08-06 06:04:00") and s[1] is None
    assert one(spark, units.layer_envelope(*(F.lit(float(x)) for x in (100, 200, 4, 3, 10, -10))))[0].asDict() == {"xmin": 100.0, "ymin": 170.0, "xmax": 140.0, "ymax": 200.0}
    assert [r.kind for r in spark.createDataFrame([(".TRUE.",), ("1.",), ("-2.5E+01",), ("1., 2.",), ("x, y",), ("",)], "v string").select(tables.namelist_value(F.col("v")).alias("s")).select("s.kind").collect()] == ["boolean", "number", "number", "list", "text", "text"]


def test_wide_parameters(spark):
    wide = spark.createDataFrame([(7, "0.5", 1.5)], "pyrome int, `101` string, `204` double")
    assert sorted(tuple(r) for r in tables.lookup_rows(wide, "pyrome").collect()) == [(7, "101", 0.5), (7, "204", 1.5)]
    assert layers.planar(2, 3, 45.0, 10.0, spark).agg(F.max("v")).first()[0] == pytest.approx(20.0)


def test_raster_tables(spark):
    """Rasters in a database, here the one that comes with Spark, kept in memory."""
    url, driver = "jdbc:derby:memory:rasters;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    cells = spark.createDataFrame([(b, i, j, float(i * 10 + j + b)) for b in range(2) for i in range(6) for j in range(4)], "b int, i int, j int, v double")
    cells.write.format("jdbc").options(url=url, dbtable="layer", driver=driver).mode("overwrite").save()
    back = database.read_raster(spark, url, "layer", 6, parts=3, driver=driver)
    assert back.rdd.getNumPartitions() == 3 and sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    mask = database.read_raster(spark, url, "layer", 6, threshold=30.0, driver=driver).where("v > 0")
    assert {r.i for r in mask.collect()} == {3, 4, 5}
    coarse = {(r.b, r.i, r.j): r.v for r in database.read_raster(spark, url, "layer", 6, rescale=2, driver=driver).collect()}
    assert len(coarse) == 12 and coarse[0, 0, 0] == 5.5 and coarse[1, 2, 1] == 48.5
    assert [tuple(r) for r in database.metadata(back).orderBy("b").collect()] == [(0, 6, 4, 0.0, 53.0), (1, 6, 4, 1.0, 54.0)]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(workflows.oracle_sql()))
def test_query_is_the_sql(spark, duck, name):
    a, b = workflows.queries()[name](spark, SF).toPandas(), duck.sql(workflows.oracle_sql()[name]).df()
    names = sorted(a.columns)
    assert names == sorted(b.columns) and len(a) == len(b) > 0
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (a, b))
    for n in names:
        assert ((a[n] == b[n]) | (a[n].isna() & b[n].isna())).all(), n
