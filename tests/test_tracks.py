"""Record parsing, statistics and cleaning on small tracks with values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantrail.config import Thresholds, load_archive, load_thresholds
from vantrail.functions import naming, records, stats
from vantrail.functions.geo import great_circle_m
from vantrail.operators import catalog, census, clean, observables, resample, spectral
from vantrail.plans.cleaning import clean_tracks
from vantrail.sources import catalog as sources
from vantrail.sources import tracks

LIMITS = Thresholds()
GOOD = "B1015004512345N00630500EA0120001250"


def lines(spark, texts, flight="f1"):
    return spark.createDataFrame([("paragliders", flight, i, t) for i, t in enumerate(texts)], "source string, flight_id string, line_no int, line string")


def fixes(spark, rows, source="paragliders", flight="f1"):
    """rows: (t, lat, lon, baro)"""
    return spark.createDataFrame([(source, flight, i + 1, float(t), float(a), float(o), True, float(b), float(b) + 50) for i, (t, a, o, b) in enumerate(rows)], "source string, flight_id string, fix_no int, t double, lat double, lon double, valid boolean, baro_alt double, gnss_alt double")


def test_parse_good_records(spark):
    rows = tracks.parse_records(lines(spark, ["AXXX0001 TEST", GOOD, "B1015104512400N00630600EA0120301254", "B1015204512455S00630700WV-045000000", "G000"])).orderBy("fix_no").collect()
    assert [r.t for r in rows] == [0.0, 10.0, 20.0]
    assert rows[0].lat == pytest.approx(45 + 12.345 / 60) and rows[0].lon == pytest.approx(6 + 30.5 / 60)
    assert rows[2].lat < 0 and rows[2].lon < 0 and rows[2].valid is False
    assert (rows[2].baro_alt, rows[2].gnss_alt) == (-450.0, 0.0)


@pytest.mark.parametrize("bad", [
    "B1015004560000N00630500EA0120001250", "B1015004512345X00630500EA0120001250", "B1015009112345N00630500EA0120001250", "B1015004512345N00660000EA0120001250", "B1015004512345N00630500QA0120001250",
    "B1015004512345N18130500EA0120001250", "B2415004512345N00630500EA0120001250", "B1060004512345N00630500EA0120001250", "B1015604512345N00630500EA0120001250", "B1015004512345N00630500EA01x0001250", "B10150045",
])
def test_malformed_records_go_and_the_file_stays(spark, bad):
    assert tracks.parse_records(lines(spark, [bad, GOOD])).count() == 1


def test_midnight_and_jitter(spark):
    line = lambda hms: f"B{hms}4512345N00630500EA0120001250"
    assert [r.t for r in tracks.parse_records(lines(spark, [line("235950"), line("000010")])).orderBy("fix_no").collect()] == [0.0, 20.0]
    assert [r.t for r in tracks.parse_records(lines(spark, [line("100000"), line("100003"), line("100001"), line("100005")])).orderBy("fix_no").collect()] == [0.0, 3.0, 3.0, 5.0]


def test_no_records(spark):
    empty = tracks.parse_records(lines(spark, ["AXXX", "G000"]))
    assert empty.count() == 0 and empty.columns == tracks.FIX_COLUMNS


def test_read_files_with_any_line_end(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.igc").write_bytes(("AXXX\r" + GOOD + "\r\n" + GOOD.replace("101500", "101510") + "\xe9\n").encode("latin-1"))
    found = tracks.parse_records(tracks.read_track_lines(spark, str(tmp_path), "paragliders"))
    assert [(r.flight_id, r.t) for r in found.orderBy("fix_no").collect()] == [("x", 0.0), ("x", 10.0)]
    assert tracks.list_tracks(spark, str(tmp_path)).first().name == "x.igc"


def test_file_checks(spark):
    rows = [("good", "A\n" + "B" * 120), ("html", "<html>" + "x" * 200), ("short", "A\nB"), ("header", "A" * 200)]
    df = spark.createDataFrame(rows, "name string, text string").withColumn("lines", F.split("text", "\n"))
    found = {r.name: r.p for r in df.select("name", records.file_problem(F.col("lines"), F.length("text")).alias("p")).collect()}
    assert found == {"good": None, "html": "invalid_structure", "short": "too_small", "header": "invalid_structure"}
    kinds = [r[0] for r in spark.createDataFrame([("._x.igc",), ("x.igc.part",), ("x.igc",), ("x.txt",)], "n string").select(records.entry_kind(F.col("n"))).collect()]
    assert kinds == ["sidecar", "leftover", "check", "other"]


def test_great_circle(spark):
    row = spark.range(1).select(great_circle_m(F.lit(45.0), F.lit(5.0), F.lit(46.0), F.lit(5.0)).alias("d"), great_circle_m(F.lit(45.0), F.lit(5.0), F.lit(45.0), F.lit(5.0)).alias("z"), great_circle_m(F.lit(None).cast("double"), F.lit(5.0), F.lit(46.0), F.lit(5.0)).alias("n")).first()
    assert row.d == pytest.approx(111195, abs=5) and row.z == 0 and row.n is None


def test_track_stats(spark):
    straight = fixes(spark, [(10 * i, 45.0, 5 + 0.001 * i, 100 + 10 * (i % 2)) for i in range(4)])
    one = fixes(spark, [(0, 45, 5, 0)], flight="one")
    gap = fixes(spark, [(t, 45.0, 5.0, 0) for t in (0, 10, 20, 70, 80)], flight="gap")
    found = {r.flight_id: r for r in census.track_stats(straight.unionByName(one).unionByName(gap)).collect()}
    s = found["f1"]
    assert "one" not in found
    assert s.path_km == pytest.approx(s.extent_km) and s.max_gap_ratio == 1 and s.missing_fraction == 0 and s.max_vz_mps == pytest.approx(1.0)
    assert (s.baro_alt_min_m, s.baro_alt_max_m, s.dt_s) == (100, 110, 10)
    assert found["gap"].max_gap_ratio == 5 and found["gap"].missing_fraction == pytest.approx(1 - 5 / 9)


def test_duplicate_timestamp_is_no_speed(spark):
    rows = census.fix_quantities(fixes(spark, [(0, 45, 5, 100), (0, 45, 5.001, 100), (10, 45, 5.002, 110)])).collect()
    assert len([r for r in rows if r.quantity == "v_xy"]) == 1 and len([r for r in rows if r.quantity == "alt"]) == 3
    assert all(math.isfinite(r.value) for r in rows)


def test_retention_is_monotone(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (4.0,)], "x double")
    assert [r.retained for r in census.retention_curve(df, "x", [1, 2, 4, 5]).collect()] == pytest.approx([1, 2 / 3, 1 / 3, 0])
    assert census.fraction_retained(df.where("x is null"), "x", 1.0).first().retained == 0.0


def test_sample_size_and_interval(spark):
    assert stats.required_sample_size(0.02) == 2401
    row = spark.createDataFrame([(1, 4), (0, 0)], "k int, n int").select(*[c.alias(n) for c, n in zip(stats.proportion_ci(F.col("k"), F.col("n")), "ph", strict=True)]).collect()
    assert row[0].p == 0.25 and row[0].h == pytest.approx(1.959963984540054 * math.sqrt(0.25 * 0.75 / 4)) and (row[1].p, row[1].h) == (0.0, None)


def test_naming(spark):
    assert naming.parse_seasons("2003-2001,1999,1999", 1990, 2020) == [1999, 2001, 2002, 2003]
    assert naming.parse_seasons("all", 2000, 2002) == [2000, 2001, 2002]
    for bad in (",", "x"):
        with pytest.raises(ValueError):
            naming.parse_seasons(bad, 2000, 2002)
    row = spark.createDataFrame([("2014/07/12", "7"), ("  ", "8")], "d string, i string").select(naming.track_name(F.col("d"), F.col("i"))).collect()
    assert [r[0] for r in row] == ["2014-07-12_7.igc", "0000-00-00_8.igc"]
    numbers = spark.createDataFrame([(" 12.5 ",), ("12.7d",), ("-3.9",), ("inf",), (None,)], "s string").select(naming.lenient_double(F.col("s")), naming.lenient_long(F.col("s"))).collect()
    assert [tuple(r) for r in numbers] == [(12.5, 12), (None, None), (-3.9, -3), (None, None), (None, None)]


def test_season_xml_and_catalog(spark, tmp_path):
    folder = tmp_path / "xml"
    folder.mkdir()
    (folder / "1999.xml").write_text('<root><flights><flight id="1001" date="2000-00-00" pilot=" PILOT A " distance="35.5" duration="0" speed="" igc_tracklog_link="https://host.invalid/f/a.igc"/><flight id="1002" date="2000-02-28" distance="" duration="6817" speed="13.7" igc_tracklog_link="https://host.invalid/f/"/></flights></root>')
    (folder / "notes.xml").write_text("<a/>")
    assert sources.archived_years(str(folder)) == [1999]
    flights = {r.flight_id: r for r in sources.load_season(spark, str(folder), 1999).collect()}
    assert flights["1001"].date == "2000-00-00" and flights["1001"].duration_s == 0 and flights["1001"].speed is None and flights["1001"].pilot == "PILOT A"
    assert flights["1002"].igc_link == "" and flights["1002"].duration_s == 6817 and flights["1002"].season == "1999-2000"
    with pytest.raises(FileNotFoundError):
        sources.load_season(spark, str(folder), 2001)
    listing = spark.createDataFrame([("/t/1999-2000/2000-00-00_1001.igc", 500)], "path string, length long")
    cat = catalog.build_catalog(sources.load_season(spark, str(folder), 1999), listing, "/t")
    index = catalog.season_index(cat).first()
    assert (index.n_flights, index.n_with_igc, index.n_downloaded) == (2, 1, 1)


def test_config(tmp_path, monkeypatch):
    y = tmp_path / "c.yaml"
    y.write_text("data_root: ~/x\nseasons: {start: 2000, end: 2002}\n")
    monkeypatch.delenv("VANTRAIL_DATA_ROOT", raising=False)
    assert list(load_archive(y).seasons) == [2000, 2001, 2002] and not load_archive(y).root.startswith("~")
    monkeypatch.setenv("VANTRAIL_DATA_ROOT", "/data")
    assert load_archive(y).path("raw/xml", "a") == "/data/raw/xml/a"
    y.write_text("fix_level: {max_horizontal_speed_mps: {paragliders: 45.0, hang gliders: 55.0}, hampel_eps_min_m: 15.0}\nsavgol: {polyorder: 3, tau_c_vertical_gnss_s: 6.0}\n")
    assert load_thresholds(y).savgol.tau_c_vertical_gnss_s == 6.0 and load_thresholds(y).fix_level.max_horizontal_speed_mps["paragliders"] == 45.0
    y.write_text("sampling: {max_gap_factor: 7}\n")
    assert load_thresholds(y).sampling.max_gap_factor == 7
    y.write_text("sampling: {nonsense: 7}\n")
    with pytest.raises(TypeError):
        load_thresholds(y)
    with pytest.raises(FileNotFoundError):
        load_thresholds(tmp_path / "none.yaml")


def brute_run(t):
    best = 0
    for mask in range(1 << len(t)):
        x = [v for i, v in enumerate(t) if mask >> i & 1]
        if all(a < b for a, b in zip(x, x[1:], strict=False)):
            best = max(best, len(x))
    return best


def test_longest_run_is_longest():
    rng = np.random.default_rng(1)
    for _ in range(40):
        t = rng.permutation(9)[: rng.integers(1, 10)].astype(float)
        kept = t[clean.longest_run(t)]
        assert (np.diff(kept) > 0).all() and len(kept) == brute_run(t)


def circle(n=600):
    return [(i, 45 + 0.0001 * i, 5 + 0.0001 * math.sin(i / 40), 1000 + 5 * math.sin(i / 30)) for i in range(n)]


def test_clock_repair_drops_one_fix(spark):
    rows = circle(50)
    rows[20] = (5000, *rows[20][1:])
    found = clean.repair_clock(fixes(spark, rows)).where("not kept").collect()
    assert [r.fix_no for r in found] == [21]


def test_spike_goes_and_neighbours_stay(spark):
    rows = circle(120)
    rows[60] = (rows[60][0], rows[60][1] + 0.005, *rows[60][2:])
    found = clean.impossible(clean.hampel(fixes(spark, rows), LIMITS), LIMITS).where("spike").collect()
    assert [r.fix_no for r in found] == [61]


def test_blocks_and_discontinuity(spark):
    rows = circle(120)
    for i in (60, 61, 62):
        rows[i] = (rows[i][0], rows[i][1] + 0.02, *rows[i][2:])
    found = clean.remove_blocks(fixes(spark, rows), LIMITS)
    assert sorted(r.fix_no for r in found.where("not kept").collect()) == [61, 62, 63] and found.where("split_before").count() == 0
    moved = [(t, a + (0.02 if i >= 60 else 0), o, b) for i, (t, a, o, b) in enumerate(circle(120))]
    found = clean.remove_blocks(fixes(spark, moved), LIMITS)
    assert found.where("not kept").count() == 0 and [r.fix_no for r in found.where("split_before").collect()] == [61]


@pytest.mark.parametrize(("step", "seconds", "goes"), [(1, 50, True), (1, 60, True), (1, 70, False), (4, 60, True), (4, 100, False)])
def test_block_bound_is_in_seconds(spark, step, seconds, goes):
    rows = [(t, a + (0.1 if 200 <= t <= 200 + seconds else 0), o, b) for t, a, o, b in circle(600)[::step]]
    found = clean.remove_blocks(fixes(spark, rows), LIMITS)
    gone = [r.t for r in found.where("not kept").orderBy("t").collect()]
    assert gone == ([r[0] for r in rows if 200 <= r[0] <= 200 + seconds] if goes else [])
    assert [r.t for r in found.where("split_before").orderBy("t").collect()] == ([] if goes else [200, 200 + seconds + step])


@pytest.mark.parametrize(("flat", "jitter", "frozen"), [(True, 0.0, True), (False, 0.00001, False), (False, 0.0, True)])
def test_frozen_needs_a_witness(spark, flat, jitter, frozen):
    rows = circle(300)
    for i in range(100, 190):
        rows[i] = (rows[i][0], rows[100][1] + jitter * (i % 2), rows[100][2], 1000.0 if flat else 1000.0 + 2 * (i - 100))
    found = clean.frozen_runs(clean.altitude_source(fixes(spark, rows), Thresholds()).withColumn("alt_source", F.lit("baro")), LIMITS).where("frozen").count()
    assert (found >= 90) == frozen


def test_cleaning_plan_keeps_a_clean_flight(spark):
    rows = [(i, 45 + 0.00012 * i, 5 + 0.0005 * math.sin(i / 60), 1000 + 500 * math.sin(i / 300)) for i in range(3600)]
    done = clean_tracks(fixes(spark, rows), LIMITS)
    flight = done.flights.first()
    assert flight.reason is None and flight.n_clean >= 3500
    assert done.segments.where("passes").count() == 1
    grid = done.fixes.where("k = 0").first()
    assert grid.k == 0 and not grid.interpolated


def long_flight():
    return [(i, 45 + 0.00012 * i, 5 + 0.0005 * math.sin(i / 60), 1000 + 500 * math.sin(i / 300)) for i in range(3600)]


@pytest.mark.parametrize("source", ["baro", "gnss"])
def test_cleaning_plan_nulls_an_altitude_spike_and_smooths(spark, source):
    rows = long_flight()
    table = fixes(spark, rows).withColumn("gnss_alt", F.col("gnss_alt") + F.when(F.col("fix_no") == 1001, 300).otherwise(0))
    if source == "gnss":
        table = table.withColumn("baro_alt", F.lit(0.0))
    else:
        table = table.withColumn("baro_alt", F.col("gnss_alt") - 50)
    done = clean_tracks(table, LIMITS)
    flight = done.flights.first()
    assert flight.alt_source == source and flight.reason is None and flight.nulled_alt >= 1
    grid = done.fixes.orderBy("k").toPandas()
    want = 1000 + 500 * np.sin(grid["grid_t"] / 300) + (50 if source == "gnss" else 0)
    assert np.abs(grid["alt"] - want).max() < 1
    assert grid.loc[grid["grid_t"] == 1000, "interpolated"].all() and not grid.loc[grid["grid_t"] == 900, "interpolated"].any()
    speed = 500 / 300 * np.cos(grid["grid_t"] / 300)
    assert np.abs(grid["alt_vel"] - speed).max() < 0.2 and np.abs(grid["north_m_vel"] - 0.00012 * 111195).max() < 0.1
    assert grid[[f"{v}_{d}" for v in ("east_m", "north_m", "alt") for d in ("pos", "vel", "acc")]].notna().all().all()


@pytest.mark.parametrize(("bad", "reason"), [(200, None), (500, "removed_fraction")])
def test_integrity_gate_counts_airborne_removals(spark, bad, reason):
    rows = long_flight()
    for i in range(100, 100 + 6 * bad, 6):
        rows[i] = (rows[i][0], rows[i][1] + 0.01, *rows[i][2:])
    parked = [(t - 3000, rows[0][1], rows[0][2], rows[0][3]) for t in range(2990)]  # frozen, before take-off, so never counted
    flight = clean_tracks(fixes(spark, parked + rows), LIMITS).flights.first()
    assert flight.reason == reason and flight.removed_spike + flight.removed_block == bad
    assert flight.removed_frozen == 0 and abs(flight.n_airborne - 3600) <= 2


def test_gap_split_and_fill(spark):
    for hole, segments in ((8, 1), (25, 2)):
        rows = [r for i, r in enumerate(circle(400)) if not 200 < i < 200 + hole]
        placed = resample.with_segments(resample.with_enu(clean.altitude_source(fixes(spark, rows), LIMITS)), LIMITS)
        assert placed.select("segment_id").distinct().count() == segments
        filled = resample.native_grid(placed).where("interpolated").count()
        assert filled == (hole - 1 if segments == 1 else 0)


def test_enu_origin_and_grid(spark):
    placed = resample.with_enu(fixes(spark, circle(10)))
    first = placed.orderBy("fix_no").first()
    assert (first.east_m, first.north_m) == (0.0, 0.0)
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.integers(1, 5, 60)).astype(float)
    z = rng.normal(size=60)
    grid = resample.linear_grid(fixes(spark, [(a, 45, 5, b) for a, b in zip(t, z, strict=True)]), ["flight_id"], ["baro_alt"], F.lit(1.5)).orderBy("k").toPandas()
    want = np.arange(t[0], t[-1] + 0.75, 1.5)
    want = want[want <= t[-1]]
    assert np.allclose(grid["baro_alt"], np.interp(want, t, z))


def test_savgol_reproduces_a_cubic(spark):
    x = np.arange(30) * 0.5
    y = 2 + x - 0.3 * x**2 + 0.05 * x**3
    found = resample.savgol(y, 0.5, 7)
    assert np.allclose(found[0], y) and np.allclose(found[1], 1 - 0.6 * x + 0.15 * x**2) and np.allclose(found[2], -0.6 + 0.3 * x)
    df = spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(y)], "f string, k int, y double")
    rows = resample.savgol5(df, "y", ["f"], F.lit(0.5)).orderBy("k").toPandas()
    assert np.allclose(rows["y_pos"], y) and np.allclose(rows["y_vel"], 1 - 0.6 * x + 0.15 * x**2) and np.allclose(rows["y_acc"], -0.6 + 0.3 * x)


def test_welch_against_a_plain_transform(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=64) + np.arange(64) * 0.1
    flat = x - np.polyval(np.polyfit(np.arange(64), x, 1), np.arange(64))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    want = np.array([abs(sum(flat[n] * w[n] * np.exp(-2j * np.pi * k * n / 64) for n in range(64))) ** 2 for k in range(33)]) / (w**2).sum()
    want[1:-1] *= 2
    assert np.allclose(spectral.welch(x, 1.0, 64), want)
    got = spark.createDataFrame([(x.tolist(),)], "v array<double>").select(spectral.welch_column(F.col("v"), 1.0, 64).alias("p")).first().p
    assert np.allclose(got, want)


def test_ensemble_bands(spark):
    rows = [("p", "baro", [1.0] * 3)] * 4 + [("p", "baro", [100.0] * 3), ("p", "baro", [1.0] * 2)]
    row = spectral.ensemble(spark.createDataFrame(rows, "discipline string, channel string, pxx array<double>"), 3, "pxx").where("k = 0").first()
    assert (row.n, row.q_50, row.mean) == (5, 1.0, pytest.approx(20.8))


def test_straight_flight_is_ballistic(spark):
    points = spark.createDataFrame([("s", f, t, 10.0 * t, 5.0 * t) for f in range(3) for t in range(1, 20)], "source string, flight_id int, t int, east_m double, north_m double")
    assert observables.scaling_exponent(observables.msd(points, "t"), "t", "msd").first().alpha == pytest.approx(2.0)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    start, move, emit = np.log([0.6, 0.4]), np.log([[0.8, 0.2], [0.3, 0.7]]), np.log([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]])
    for _ in range(10):
        seen = rng.integers(0, 3, 6)
        score = lambda p: start[p[0]] + emit[p[0], seen[0]] + sum(move[a, b] + emit[b, s] for a, b, s in zip(p, p[1:], seen[1:], strict=False))  # noqa: E731, B023
        best = max(score([m >> i & 1 for i in range(6)]) for m in range(64))
        assert score(observables.viterbi(seen, start, move, emit).tolist()) == pytest.approx(best)


def test_order_of_rows_does_not_matter(spark):
    df = fixes(spark, circle(200))
    a, b = (sorted(map(tuple, census.track_stats(x).collect())) for x in (df, df.orderBy(F.rand(1)).repartition(3)))
    assert [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a] == [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b]


def test_exact_quantiles_and_distances(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from vantrail.operators import observables, ranks

    rng = np.random.default_rng(4)
    values = [(g, float(v)) for g in "ab" for v in np.round(rng.lognormal(0, 2, 700), 1)] + [("a", 5.0)] * 300 + [("b", None), ("c", 1.5)]
    rows = spark.createDataFrame(values, "g string, v double")
    got = {r.g: (r.n, list(r.xs)) for r in ranks.exact_quantiles(rows, "v", [0.0, 0.1, 0.5, 0.999, 1.0], ["g"]).collect()}
    for g in "abc":
        own = [v for x, v in values if x == g and v is not None]
        assert got[g][0] == len(own) and np.allclose(got[g][1], np.quantile(own, [0.0, 0.1, 0.5, 0.999, 1.0]))
    a, b = (np.sort([v for x, v in values if x == g and v is not None]) for g in "ab")
    both = np.concatenate([a, b])
    want = np.abs(np.searchsorted(a, both, "right") / len(a) - np.searchsorted(b, both, "right") / len(b)).max()
    assert abs(observables.ks_distance(rows.where("g <> 'c'"), "v", F.col("g") == "a").first().ks - want) < 1e-12
    assert ranks.exact_quantiles(rows.limit(0), "v", [0.5], ["g"]).count() == 0


def test_failures_are_written_where_there_are_any(spark, tmp_path):
    from vantrail.sources import catalog

    rows = spark.createDataFrame([("1", "timeout")], "flight_id string, reason string")
    assert catalog.write_failures(rows, str(tmp_path / "f")) and spark.read.csv(str(tmp_path / "f"), header=True).first().reason == "timeout"
    assert not catalog.write_failures(rows.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    index = spark.createDataFrame([(2001, "2001-2002", "l", "x", 5, 4, 3)], "season_year int, season string, list_url string, xml_url string, n_flights long, n_with_igc long, n_downloaded long")
    catalog.write_csv(index, str(tmp_path / "index"))
    assert catalog.read_season_index(spark, str(tmp_path / "index")).collect() == index.collect()
    made = []
    table = lambda: made.append(1) or index
    for force in (False, False, True):
        assert catalog.load_or_compute(spark, str(tmp_path / "scan"), table, force).count() == 1
    assert len(made) == 2
