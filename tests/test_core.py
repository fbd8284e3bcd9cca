"""Physics against published values, operators against plain versions, queries against SQL."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderframe.functions import containment, crown, fuels, spotting, surface, units, weather
from cinderframe.operators import intervals, sampling
from cinderframe.plans import queries as plans
from cinderframe.sources import envi, sparse_binary, tables
from cinderframe.streaming import watch

SF = "/root/testdata/sf0.001"
#: Fixed values (BehavePlus 5, cured fuel without wind and slope): rate (ch/h), intensity, flame length, reaction intensity, residence.
CURED = {
    "GR1": (1.1, 2, 0.6, 430, 0.19), "GR4": (4.7, 40, 2.4, 2209, 0.21), "GR8": (8.6, 449, 7.5, 9700, 0.29), "GS2": (1.6, 15, 1.6, 2467, 0.21),
    "SH5": (2.9, 93, 3.6, 5720, 0.31), "SH9": (3.1, 215, 5.3, 13425, 0.28), "TU2": (1.0, 8, 1.2, 2059, 0.22), "TL8": (0.9, 13, 1.5, 3617, 0.22), "SB2": (1.7, 36, 2.3, 5547, 0.20),
}
#: Fixed values (half cured, 10 mph midflame wind, 20 % slope): rate, intensity, flame length.
WINDY = {"GR1": (11.9, 18, 1.7), "GR4": (148.3, 1277, 12.1), "GR9": (326.3, 19924, 42.7), "GS2": (70.8, 625, 8.7)}


def moist(df, herb):
    values = {"fm_1h": 0.04, "fm_10h": 0.04, "fm_100h": 0.06, "fm_herb": herb, "fm_woody": 0.70}
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def test_cured_spread(spark):
    out = surface.with_minimum_spread(moist(fuels.fuel_models(spark, synonyms=False), 0.30))
    fli = surface.fireline_intensity(F.col("reaction_intensity"), F.col("base_rate"), F.col("residence_time"))
    rows = {r["name"]: r for r in out.select("name", (F.col("base_rate") / 1.1).alias("ros"), fli.alias("fli"), surface.flame_length(fli).alias("fl"), "reaction_intensity", "residence_time").collect()}
    for name, (ros, intensity, flame, reaction, residence) in CURED.items():
        r = rows[name]
        assert abs(r.ros - ros) <= 0.1 and abs(r.fli - intensity) <= 0.5 and abs(r.fl - flame) <= 0.05, (name, r)
        assert abs(r.reaction_intensity - reaction) <= 12 and abs(r.residence_time - residence) <= 0.01, (name, r)
    assert rows["NB1"].ros == 0


def test_windy_spread(spark):
    out = surface.with_minimum_spread(moist(fuels.fuel_models(spark, synonyms=False), 0.75))
    zero, one = F.lit(0.0), F.lit(1.0)
    out = surface.with_maximum_spread(out, F.lit(880.0), zero, F.lit(0.2), zero, one, one)
    fli = surface.fireline_intensity(F.col("reaction_intensity"), F.col("max_rate"), F.col("residence_time"))
    rows = {r["name"]: r for r in out.select("name", (F.col("max_rate") / 1.1).alias("ros"), fli.alias("fli"), surface.flame_length(fli).alias("fl"), "max_direction").collect()}
    for name, (ros, intensity, flame) in WINDY.items():
        r = rows[name]
        assert abs(r.ros - ros) <= 0.3 and abs(r.fli - intensity) <= 25.1 and abs(r.fl - flame) <= 0.05 and r.max_direction == 180, (name, r)


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_crown_values(spark):
    got = one(spark, *(crown.critical_intensity(F.lit(float(h)), F.lit(float(m))) for h, m in ((0, 0), (7, 95), (7, 135), (1, 120))))
    assert all(abs(g - w) <= 0.05 * w for g, w in zip(got, (0, 2890, 4560, 210)))
    metres = units.convert(F.lit(7.0), "m_to_ft")
    fires = [(50.0, 95.0, 10500.0, True), (50.0, 135.0, 9500.0, True), (50.0, 120.0, 85.0, False), (0.0, 95.0, 10500.0, False)]
    got = one(spark, *(crown.initiates(F.lit(c), metres, F.lit(m / 100), units.convert(F.lit(i), "kw_m_to_btu_ft_s")) for c, m, i, _ in fires))
    assert got == [f[3] for f in fires]


def test_spotting_values(spark):
    celsius = lambda f: units.convert(F.lit(f), "f_to_c")
    got = one(spark, *(spotting.preignition_heat(t, F.lit(m)) for t, m in ((F.lit(320.0), 0.0), (F.lit(0.0), 0.0), (celsius(30.0), 0.01), (celsius(160.0), 0.1), (celsius(130.0), 0.25))))
    assert np.allclose(got, (0.0, 144.512, 153.816, 193.996, 292.814), atol=1e-3)
    got = one(spark, *(spotting.ignition_probability(celsius(t), F.lit(m)) for t, m in ((35.0, 0.015), (75.0, 0.015), (35.0, 0.05), (75.0, 0.05))))
    assert np.allclose(got, (0.87, 0.97, 0.51, 0.59), atol=0.01)
    got = one(spark, *(spotting.spot_probability(F.lit(p), F.lit(0.005), F.lit(d)) for p, d in ((0.2, 100.0), (1.0, 100.0), (0.5, 200.0))))
    assert np.allclose(got, (0.121, 0.606, 0.183), atol=1e-3)


def test_sun_and_clock(spark):
    ts, lat, lon = F.lit("2022-07-19 16:54:09.073").cast("timestamp"), F.lit(43.17), F.lit(5.60)
    assert one(spark, *weather.burn_period(lat, lon, ts)) == ["04:15", "19:13"]
    assert one(spark, *weather.burn_period(lat, lon, ts, F.lit(10.0), 9 / 15)) == ["08:14", "18:14"]
    assert one(spark, *(weather.clock(F.lit(h)) for h in (9.2, 19.75, 0.0, 23.99, 26.5))) == ["09:12", "19:45", "00:00", "23:59", "02:30"]
    days = [("2022-01-01", 0.0), ("2022-03-21", 0.21643835616438353), ("2022-07-01", 0.49589041095890407)]
    assert np.allclose(one(spark, *(weather.year_angle(F.lit(d).cast("timestamp")) / (2 * math.pi) for d, _ in days)), [x for _, x in days])


def test_containment(spark):
    got = one(spark, *(containment.bearing(F.lit(float(i)), F.lit(float(j)), F.lit(0.0), F.lit(0.0)) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))))
    assert np.allclose(got, (0, 90, 180, 270))
    assert one(spark, containment.joined_average(F.lit(10.0), F.lit(2), F.lit(4.0), F.lit(1)), containment.parted_average(F.lit(8.0), F.lit(3), F.lit(4.0), F.lit(1))) == [8.0, 10.0]


def test_interval_maps(spark):
    table = spark.createDataFrame([(1, 100, 0.1, 0), (91, 150, 0.2, 1)], "lo int, hi int, v double, pos int")
    rows = spark.createDataFrame([(95,), (150,), (151,), (None,)], "m int")
    assert {r.m: r.v for r in intervals.lookup(rows, "m", table).collect()} == {95: 0.1, 150: 0.2, 151: None, None: None}


@pytest.mark.parametrize("width", [1, 7, 64, 1000])
def test_fractional_keys(spark, width):
    """One rule, whatever the bins: fractions, bounds, ties of pos, ranges of no number."""
    table = spark.createDataFrame([(1, 100, 0.1, 0), (91, 150, 0.2, 1), (140, 160, 0.3, 1), (-20, -5, 0.4, 2), (9, 3, 9.9, 0)], "lo int, hi int, v double, pos int")
    rows = spark.createDataFrame([(x,) for x in (95.5, 100.0, 100.5, 150.0, 145.0, 150.5, -5.0, -4.5, -20.0, 0.5, None)], "m double")
    want = {95.5: 0.1, 100.0: 0.1, 100.5: 0.2, 150.0: 0.2, 145.0: 0.2, 150.5: 0.3, -5.0: 0.4, -4.5: None, -20.0: 0.4, 0.5: None, None: None}
    assert {r.m: r.v for r in intervals.lookup(rows, "m", table, width=width).collect()} == want
    a, b = [(1, 100, 1.0), (150, 400, 2.0)], [(50, 160, 3.0), (90, 90, 4.0), (401, 500, 5.0)]
    kind = "lo int, hi int, v double"
    got = sorted(tuple(r) for r in intervals.combine(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), width).collect())
    assert got == sorted((max(x[0], y[0]), min(x[1], y[1]), x[2], y[2]) for x in a for y in b if x[0] <= y[1] and y[0] <= x[1])


def test_settings_unfold(spark):
    rows = [(2, 8, "5.0, 5.0, 6.0, 6.0, 7.0, 7.0, 8.0, 8.0")]
    each = intervals.unfolded(spark.createDataFrame(rows, "lo int, hi int, value string"), 1, 10)
    got = sorted(tuple(r) for r in intervals.fill_gaps(intervals.merge_adjacent(each), 1, 10, 1.0).collect())
    assert got == [(1, 1, 1.0), (2, 3, 5.0), (4, 5, 6.0), (6, 7, 7.0), (8, 8, 8.0), (9, 10, 1.0)]
    rows = [(301, None, "4., 5., 6.,"), (None, 3, "2")]
    got = sorted(tuple(r) for r in intervals.unfolded(spark.createDataFrame(rows, "lo int, hi int, value string"), 1, 303).collect())
    assert got == [(1, 1, 2.0), (2, 2, 2.0), (3, 3, 2.0), (301, 301, 4.0), (302, 302, 5.0), (303, 303, 6.0)]


def test_samples_are_fixed(spark):
    df = spark.range(1000)
    draw = lambda d: [r.x for r in d.select("id", sampling.drawn(5, (2.0, 3.0), F.col("id")).alias("x")).orderBy("id").collect()]
    a, b = draw(df), draw(df.repartition(7))
    assert a == b and min(a) >= 2 and max(a) < 3 and abs(np.mean(a) - 2.5) < 0.05
    few = spark.createDataFrame([(0, 0), (1, 1)], "i int, j int")
    sites = sampling.ignition_sites(few, 5, F.lit(True), 1).collect()
    assert sorted(r.sim for r in sites) == list(range(5)) and len({(r.i, r.j) for r in sites}) == 2


def test_envi(spark, tmp_path):
    data = np.arange(24, dtype="<i2").reshape(2, 3, 4) - 5
    (tmp_path / "x.bsq").write_bytes(data.tobytes())
    header = "ENVI\nsamples = 4\nlines = 3\nbands = 2\nheader offset = 0\ndata type = 2\ninterleave = bsq\nbyte order = 0\nmap info = {Albers,\n 1, 2}\n"
    (tmp_path / "x.hdr").write_text(header)
    got = {(r.b, r.i, r.j): r.v for r in envi.read_bsq(spark, [f"{tmp_path}/x.bsq"]).collect()}
    assert got == {(b, i, j): float(data[b, i, j]) for b in range(2) for i in range(3) for j in range(4)}
    (tmp_path / "other").mkdir()
    (tmp_path / "other/x.bsq").write_bytes(data[:1].tobytes())
    (tmp_path / "other/x.hdr").write_text(header.replace("bands = 2", "bands = 1"))
    assert envi.read_bsq(spark, [f"{tmp_path}/x.bsq", f"{tmp_path}/other/x.bsq"]).count() == 36  # equal names in two folders
    for bad in ("no\n", "ENVI\nsamples = 4\n", header.replace("bsq", "bil"), header.replace("data type = 2", "data type = 12")):
        with pytest.raises(ValueError):
            envi.parse_header(bad)


def test_sparse_binary(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 2, 3.5, 7), (1, 4, 0, 1.25, 8), (1, 2, 2, 0.0, 9)], "sim int, i int, j int, t double, k int")
    (tmp_path / "f.bin").write_bytes(sparse_binary.encoded(cells, 5, ["t", "k"]).first().content)
    got = {(r.i, r.j, r.t, r.k) for r in sparse_binary.read(spark, f"{tmp_path}/f.bin", 5, {"t": "float", "k": "int"}).collect()}
    assert got == {(0, 2, 3.5, 7), (4, 0, 1.25, 8)}


def test_tables(spark, tmp_path):
    (tmp_path / "ign.csv").write_text("row,col,start,runtime\n4,1,0,10\n5,2,0,20\n")
    assert [tuple(r) for r in tables.read_ignitions(spark, f"{tmp_path}/ign.csv").collect()] == [(4, 1, 0.0, 10.0), (5, 2, 0.0, 20.0)]
    lines = spark.createDataFrame([("A_DT = 3.5 ! note",), ("LIST(2) = 'x'",), ("R(1:256) = 7",), ("S(110:) = 1., 2.,",), ("T(:110) = 5 /",), ("P = '/data/in'",), ("Q = 'a & b' & c",), ('V = "it\'s ./x!" ! \'',), ("&INPUTS",), ("/",)], "value string")
    want = {("a_dt", None, None, "3.5"), ("list", 2, 2, "x"), ("r", 1, 256, "7"), ("s", 110, None, "1., 2.,"), ("t", None, 110, "5"), ("p", None, None, "/data/in"), ("q", None, None, "a & b"), ("v", None, None, "it's ./x!")}
    assert {tuple(r) for r in tables.namelist(lines).collect()} == want
    tables.write_summary(spark.createDataFrame([(2, 1, 5.0), (1, 9, 6.0)], "ignition_row int, ignition_col int, fire_size double"), f"{tmp_path}/out")
    assert [r.fire_size for r in spark.read.option("header", True).schema("ignition_row int, ignition_col int, fire_size double").csv(f"{tmp_path}/out").orderBy("ignition_row").collect()] == [6.0, 5.0]


def test_stream(spark, tmp_path):
    rows = [("a", 0), ("a", 3), ("a", 20), ("b", 1), ("z", 500)]
    df = spark.createDataFrame(rows, "path string, s int").select("path", F.timestamp_seconds("s").alias("modified"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = watch.settled(stream, late="0 seconds").writeStream.format("memory").queryName("settled").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.path, r.changes) for r in spark.table("settled").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]
    assert watch.settled(df).count() == 4
    cells = spark.createDataFrame([(1, 2, 10), (1, 2, 20), (1, 3, 3700)], "i int, j int, s int").select("i", "j", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.burn_count for r in watch.live_counts(cells).collect()) == [1, 2]


def test_plans_stay_small(spark):
    """Shared intermediates are worked out once: the plan of the fastest spread is not much larger than that of the slowest."""
    size = {n: len(plans.queries()[n](spark, SF)._jdf.queryExecution().optimizedPlan().toString()) for n in ("surface_minimum_spread", "surface_maximum_spread", "flame_stats_by_fuel")}
    assert max(size.values()) < 3 * size["surface_minimum_spread"] < 60_000, size


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_is_the_sql(spark, duck, name):
    a, b = plans.queries()[name](spark, SF).toPandas(), duck.sql(plans.oracle_sql()[name]).df()
    names = sorted(a.columns)
    assert names == sorted(b.columns) and len(a) == len(b)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (a, b))
    for n in names:
        assert ((a[n] == b[n]) | (a[n].isna() & b[n].isna())).all(), n
