"""Phases, lags, isotropy, the census measures and keys against brute force and values worked out by hand."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantrail.config import Thresholds
from vantrail.operators import catalog, census, lags, observables, phases
from vantrail.sources import catalog as sources
from vantrail.sources import tracks


# ---------------------------------------------------------------- phases
def by_paths(batch, model):
    """Likelihoods and expected counts over all paths."""
    first, move, emit, total, best = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 8)), [], []
    for s in batch:
        paths = []
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], s[t]]
            paths.append((p, path))
        whole = sum(p for p, _ in paths)
        total.append(math.log(whole))
        best.append(max(paths, key=lambda x: x[0])[1])
        for p, path in paths:
            first[path[0]] += p / whole
            for t, state in enumerate(path):
                emit[state, s[t]] += p / whole
                if t:
                    move[path[t - 1], state] += p / whole
    return total, first, move, emit, best


def test_forward_backward_is_the_sum_over_paths():
    rng = np.random.default_rng(2)
    batch = [rng.integers(0, 8, n) for n in (1, 2, 6, 3, 5, 1)]
    model = phases.first_model()
    *want, best = by_paths(batch, model)
    for a, b in zip(phases.expected_counts(batch, model), want, strict=True):
        assert np.allclose(a, b)
    assert [tuple(p) for p in phases.viterbi(batch, model)] == best


def test_training_never_loses_likelihood_and_finds_the_model(spark):
    rng = np.random.default_rng(1)
    true = phases.Model(np.array([0.6, 0.3, 0.1]), np.array([[0.95, 0.04, 0.01], [0.05, 0.85, 0.1], [0.08, 0.02, 0.9]]), phases.first_model().emit)
    rows, states = [], {}
    for flight in range(60):
        state = rng.choice(3, p=true.start)
        for k in range(int(rng.integers(20, 300))):
            rows.append(("paragliders", flight, 0, k, int(rng.choice(8, p=true.emit[state]))))
            states[flight, k] = phases.PHASES[state]
            state = rng.choice(3, p=true.move[state])
    df = spark.createDataFrame(rows, "source string, flight_id long, segment_id short, k long, symbol int").repartition(5)
    whole = phases.sequences(df).cache()
    model, history = phases.train(whole, iterations=12, tolerance=-1.0)
    likelihoods = [h[1] for h in history]
    assert len(history) == 13 and all(b >= a - 1e-9 for a, b in zip(likelihoods, likelihoods[1:]))
    assert history[0][3] + history[0][4] == len(rows) and history[0][4] > 0 and history[-1][2] > history[0][2]
    assert np.abs(model.move - true.move).max() < 0.06
    own = [(r.held, list(r.symbols)) for r in whole.collect()]
    _, *counts = phases.expected_counts([np.array(s) for held, s in own if not held], phases.first_model())
    one, _ = phases.train(whole, iterations=1)
    assert np.allclose(one.move, counts[1] / counts[1].sum(axis=1, keepdims=True), atol=1e-6)
    found = phases.with_phases(df, model).collect()
    assert len(found) == len(rows) and sum(states[r.flight_id, r.k] == r.phase for r in found) > 0.8 * len(rows)


def test_training_of_nothing(spark):
    empty = phases.sequences(spark.createDataFrame([], "source string, flight_id long, segment_id short, k long, symbol int"))
    model, history = phases.train(empty)
    assert history == [] and np.allclose(model.emit, phases.first_model().emit)


def test_features_of_a_glide_and_a_circle(spark):
    rows = []
    for k in range(120):
        if k < 60:
            e, n, alt = 15.0 * k, 0.0, 1500.0 - k
        else:
            a = 2 * math.pi * (k - 60) / 20
            e, n, alt = 900 + 60 * math.sin(a), 60 - 60 * math.cos(a), 1440.0 + 2 * (k - 60)
        rows.append(("paragliders", 1, 0, k, float(k), 1.0, e, n, alt))
    rows.append(("paragliders", 2, 0, 0, 0.0, 1.0, 0.0, 0.0, None))
    grid = spark.createDataFrame(rows, "source string, flight_id long, segment_id short, k long, grid_t double, dt_s double, east_m double, north_m double, alt double")
    found = {(r.flight_id, r.k): r for r in phases.features(grid, half_s=8.0).collect()}
    assert all((found[1, k].rising, found[1, k].turning, found[1, k].straight) == (False, False, True) for k in range(50))
    assert all((found[1, k].rising, found[1, k].turning, found[1, k].straight) == (True, True, False) for k in range(75, 112))
    assert found[2, 0].symbol == 0 and len(found) == 121


# ---------------------------------------------------------------- lags
def test_lags_are_the_double_loop(spark):
    rng = np.random.default_rng(5)
    rows, paths = [], {}
    for flight, segment, n in ((1, 0, 40), (1, 1, 25), (2, 0, 1), (3, 0, 60)):
        r = rng.normal(size=(n, 2)).cumsum(axis=0) * 200 + 5e4
        paths[flight, segment] = r
        rows += [("paragliders", flight, segment, k, 5.0 * flight, float(e), float(no)) for k, (e, no) in enumerate(r)]
    grid = spark.createDataFrame(rows, "source string, flight_id long, segment_id short, k long, dt_s double, east_m double, north_m double").repartition(4)
    want, corr = {}, {}
    for (flight, _), r in paths.items():
        for m in range(len(r)):
            for i in range(len(r) - m):
                want.setdefault((flight, m), []).append(((r[i + m] - r[i]) ** 2).sum())
                corr.setdefault((flight, m), []).append(float(r[i + m] @ r[i]))
    got = {(r.flight_id, r.lag): r for r in lags.time_averaged_msd(grid).collect()}
    assert set(got) == set(want)
    for key, squares in want.items():
        assert got[key].n == len(squares) and got[key].lag_s == 5.0 * key[0] * key[1] and got[key].tamsd == pytest.approx(np.mean(squares), abs=1e-3)
    some = lags.velocity_autocorrelation(grid, [0, 3, 50], "east_m", "north_m").collect()
    assert {(r.flight_id, r.lag) for r in some} == {k for k in want if k[1] in (0, 3, 50)}
    assert all(r.vacf == pytest.approx(np.mean(corr[r.flight_id, r.lag]), rel=1e-9) for r in some)


def test_curves_over_flights(spark):
    rows = [("p", 1, 1, 4.0, 10, 2.0), ("p", 1, 2, 7.0, 30, 6.0), ("p", 2, 1, 5.0, 1, 9.0), ("p", 2, 0, 0.0, 1, 0.0), ("p", 3, 1, 8.0, 4, 1.0)]
    curves = spark.createDataFrame(rows, "source string, flight_id long, lag int, lag_s double, n long, tamsd double")
    got = {r.lag_class: r for r in lags.over_flights(curves, "tamsd").collect()}
    assert (got[2].flights, got[2].mean) == (2, 7.0) and got[2].eb == pytest.approx(4 / 49) and got[3].eb == 0
    strata = spark.createDataFrame([("p", 1, "short"), ("p", 2, "long")], "source string, flight_id long, stratum string")
    aged = {(r.stratum, r.lag_class): r.mean for r in lags.over_flights(curves, "tamsd", strata).collect()}
    assert aged == {("short", 2): 5.0, ("long", 2): 9.0}


def test_isotropy_ks(spark):
    rng = np.random.default_rng(0)
    rows = [(m, float(e), float(n)) for m in (1, 2) for e, n in rng.normal(size=(150, 2)).round(1) * [1, m]]
    got = {r.m: r for r in observables.isotropy_ks(spark.createDataFrame(rows, "m int, east_m double, north_m double"), "m").collect()}
    for m in (1, 2):
        e, n = (np.sort([r[i] for r in rows if r[0] == m]) for i in (1, 2))
        at = np.concatenate([e, n])
        want = np.abs(np.searchsorted(e, at, "right") - np.searchsorted(n, at, "right")).max() / 150
        assert got[m].n == 150 and got[m].ks == pytest.approx(want)


# ---------------------------------------------------------------- census
def test_census_measures_by_hand(spark):
    rows = [
        # flight, dt, ratio, baro share, fixes, duration, path
        (1, 1.0, 2.0, 1.0, 10, 3600.0, 10.0), (2, 4.0, 2.5, 0.9, 10, 7200.0, 20.0), (3, 0.0, None, 0.0, 10, 0.0, 0.0), (4, 2.5, 12.0, 0.5, 10, 3600.0, 40.0), (5, None, None, 0.2, 10, None, None), (6, 10.0, 3.0, 0.0, 10, 1800.0, 5.0),
    ]
    df = spark.createDataFrame([("paragliders", *r) for r in rows], "source string, flight_id string, dt_s double, max_gap_ratio double, baro_present_frac double, n_fix long, duration_s double, path_km double")
    r = census.census_measures(df).first()
    assert (r.tracks, r.no_baro_pct) == (6, 50.0)
    assert r.baro_zero_pct == pytest.approx(200 / 3) and r.baro_full_pct == pytest.approx(100 / 3) and r.baro_miss_flights_pct == pytest.approx(200 / 3)
    assert (r.baro_miss_median_fixes, r.baro_miss_max_fixes) == (3.0, 5.0)  # 1 and 5 fixes
    assert (r.dt_int_pct, r.dt_1_pct, r.dt_2_pct, r.dt_10_pct) == (75.0, 25.0, 0.0, 25.0)  # of 1, 4, 2.5 and 10 s; 0 s does not count
    assert r.gap_int_pct == 75.0  # ratios 2, 12 and 3 of four are whole; 2.5 is not, though its gap of 10 s is
    assert (r.gap_split_rel_pct, r.gap_split_comb_pct) == (25.0, 50.0)  # 12 is over 10; at 10 s the floor of 20 s is passed by 30 s
    assert r.median_path_km == 10.0 and r.median_dur_h == 1.0
    tight = census.census_measures(df, Thresholds(sampling=type(Thresholds().sampling)(max_gap_factor=2.0))).first()
    assert tight.gap_split_rel_pct == 75.0


def test_representative_of_any_ids(spark):
    rows = [("p", "2012-05-01_12", 5), ("p", "b", 9), ("p", "a", 9), ("h", "x", 1)]
    got = census.representative(spark.createDataFrame(rows, "source string, flight_id string, n_fix long")).collect()
    assert {(r.source, r.flight_id, r.n_fix) for r in got} == {("p", "a", 9), ("h", "x", 1)}


# ---------------------------------------------------------------- keys
XML = '<root><flights><flight id="12" date="2012-05-01" pilot="A" flight_type="triangle"/><flight id="13" date="2012-05-02" pilot="B" flight_type="free"/></flights></root>'
FIX = "B10150{}4512345N0063050{}EA0120001250"


def test_landed_files_meet_their_catalog(spark, tmp_path):
    """From files and exports of two disciplines, whose ids overlap, to strata."""
    for source, kinds in (("paragliders", "triangle"), ("hang gliders", "distance")):
        folder = tmp_path / source / "2011-2012"
        folder.mkdir(parents=True)
        (folder / "2012-05-01_12.igc").write_text("AXXX\n" + FIX.format(0, 0) + "\n" + FIX.format(5, 1) + "\n")
        (tmp_path / f"{source}-xml").mkdir()
        (tmp_path / f"{source}-xml" / "2011.xml").write_text(XML.replace("triangle", kinds))
    (tmp_path / "paragliders" / "loose.igc").write_text("AXXX\n" + FIX.format(0, 0) + "\n" + FIX.format(5, 1) + "\n")
    read = lambda s: tracks.parse_records(tracks.read_track_lines(spark, str(tmp_path / s), s))
    fixes = read("paragliders").unionByName(read("hang gliders"))
    season = lambda s: sources.load_season(spark, str(tmp_path / f"{s}-xml"), 2011).withColumn("source", F.lit(s))
    flights = season("paragliders").unionByName(season("hang gliders"))
    assert {(r.source, r.flight_id) for r in fixes.collect()} == {("paragliders", "12"), ("hang gliders", "12"), ("paragliders", "loose")}
    stats = catalog.with_stratum(census.track_stats(fixes), flights, "flight_type").collect()
    assert {(r.source, r.flight_id, r.flight_type, r.n_fix) for r in stats} == {("paragliders", "12", "triangle", 2), ("hang gliders", "12", "distance", 2)}
    assert {r.flight_id for r in census.representative(census.track_stats(fixes)).collect()} == {"12"}


# ---------------------------------------------------------------- durations and intervals
def brute_law(values, least=10):
    """(x_min, alpha, ks, rate, ratio) over every distinct value as the lower cut."""
    best = None
    for cut in sorted(set(values))[:-1]:
        tail = sorted(v for v in values if v >= cut)
        if len(tail) < least:
            continue
        alpha = 1 + len(tail) / sum(math.log(v / cut) for v in tail)
        ks = 0.0
        for v in set(tail):
            law = 1 - (v / cut) ** (1 - alpha)
            ks = max(ks, abs(sum(x <= v for x in tail) / len(tail) - law), abs(sum(x < v for x in tail) / len(tail) - law))
        if best is None or ks < best[2] - 1e-12:
            rate = len(tail) / sum(v - cut for v in tail)
            power = sum(math.log((alpha - 1) / cut) - alpha * math.log(v / cut) for v in tail)
            best = cut, alpha, ks, rate, power - sum(math.log(rate) - rate * (v - cut) for v in tail)
    return best


def test_duration_laws(spark):
    from vantrail.operators.durations import duration_laws

    rng = np.random.default_rng(3)
    climb = 20 + rng.exponential(120, 700).round()
    search = (10 * (1 - rng.random(900)) ** (-1 / 1.4)).round(1)
    rows = [("climb", float(x), False) for x in climb] + [("search", float(x), False) for x in search] + [("climb", 9.0, True)] * 7 + [("short", 1.0, False)] * 30 + [("cut", 5.0, True)] + [("search", 0.0, None)]
    got = {r.phase: r for r in duration_laws(spark.createDataFrame(rows, "phase string, duration_s double, censored boolean").repartition(3), cuts=2000).collect()}
    for name, values in (("climb", climb), ("search", search)):
        cut, alpha, ks, rate, ratio = brute_law(values.tolist())
        r = got[name]
        assert (r.x_min, r.n) == (cut, len(values)) and (r.alpha, r.ks, r.rate, r.ratio) == pytest.approx((alpha, ks, rate, ratio), rel=1e-7)
    assert got["search"].z > 2 and got["search"].alpha == pytest.approx(2.4, abs=0.2) and got["climb"].censored_share == pytest.approx(7 / 707)
    assert (got["short"].n, got["short"].x_min, got["cut"].n, got["cut"].censored_share) == (30, None, 0, 1.0)
    few = {r.phase: r for r in duration_laws(spark.createDataFrame(rows, "phase string, duration_s double, censored boolean")).collect()}
    assert few["search"].alpha == pytest.approx(got["search"].alpha, abs=0.2)


def test_intervals_and_sensitivity(spark):
    from vantrail.operators.durations import merged_intervals, sensitivity, without_intervals

    rng = np.random.default_rng(7)
    suspects = [("p", f, float(a), float(a + rng.integers(0, 9))) for f in range(4) for a in rng.integers(0, 80, 6)]
    runs = [("p", f, "wait" if i % 2 else "glide", 9.0 * i, 9.0 * i + 8, i == 0) for f in range(5) for i in range(10)]
    s = spark.createDataFrame(suspects, "source string, flight_id long, t0 double, t1 double")
    r = spark.createDataFrame(runs, "source string, flight_id long, phase string, t0 double, t1 double, censored boolean")
    cover = lambda f: {x / 10 for _, g, a, b in suspects if g == f for x in range(int(10 * a), int(10 * b))}
    merged = merged_intervals(s).collect()
    for f in range(4):
        own = sorted((x.t0, x.t1) for x in merged if x.flight_id == f)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:])) and sum(b - a for a, b in own) == pytest.approx(len(cover(f)) / 10)
    want = {}
    for x in without_intervals(r, s).collect():
        inside = len({c for c in cover(x.flight_id) if x.t0 <= c < x.t1}) / 10
        assert x.covered_s == pytest.approx(inside) and x.touched == any(g == x.flight_id and a < x.t1 and x.t0 < b for _, g, a, b in suspects)
        if not x.censored:
            for variant, left in (("all", 8.0), ("without", None if x.touched else 8.0), ("subtracted", 8 - inside if not x.touched or inside < 8 else None)):
                want.setdefault((x.phase, variant), []).append(left)
    got = {(x.phase, x.variant): (x.n, x.total_s) for x in sensitivity(r, s).collect()}
    assert got == {k: (sum(x is not None for x in v), pytest.approx(sum(x or 0 for x in v))) for k, v in want.items()}


def test_geometry_of_a_circle_and_a_line(spark):
    from vantrail.operators.geometry import run_geometry

    rows = [("p", 1, k, float(k), 10.0 * k, 5.0, 1000.0 - k, "glide") for k in range(5)]
    for k in range(60):
        a = 2 * math.pi * k / 24
        rows.append(("p", 1, 10 + k, 10.0 + k, 300 + 80 * math.cos(a), -50 + 80 * math.sin(a), 900 + 2.0 * k, "climb"))
    rows += [("p", 1, 100 + k, 100.0 + k, float(3 * k), float(4 * k), 800.0, "glide") for k in range(4)] + [("p", 1, 200, 200.0, 0.0, 0.0, 1.0, "rest")]
    df = spark.createDataFrame(rows, "source string, flight_id long, fix_no int, t double, east_m double, north_m double, alt double, phase string")
    glide, climb, line, rest = run_geometry(df, "phase").orderBy("run").collect()
    assert climb.radius_m == pytest.approx(80) and climb.circle_rms_m == pytest.approx(0, abs=1e-4) and climb.period_s == pytest.approx(24 * 59 / 58, rel=1e-9)
    assert climb.turned_rad == pytest.approx(2 * math.pi * 58 / 24) and climb.climb_mps == pytest.approx(2) and not climb.censored
    assert line.radius_m is None and line.tortuosity == pytest.approx(1) and line.period_s is None and line.net_m == pytest.approx(15)
    assert glide.censored and rest.censored and rest.radius_m is None and rest.tortuosity is None
    noisy = np.random.default_rng(1).normal(0, 2, (60, 2))
    shaken = [(*r[:4], r[4] + float(noisy[r[2] - 10][0]), r[5] + float(noisy[r[2] - 10][1]), *r[6:]) for r in rows if r[-1] == "climb"]
    found = run_geometry(spark.createDataFrame(shaken, df.schema), "phase").first()
    assert found.radius_m == pytest.approx(80, abs=2) and found.circle_rms_m == pytest.approx(2, abs=0.6)


def test_collapse_finds_the_exponent(spark):
    from vantrail.operators.collapse import collapse

    rng = np.random.default_rng(11)
    for h in (0.5, 0.8):
        rows = [(t, float(x)) for t in (1, 2, 4, 8, 16, 32) for x in rng.normal(0, 1000 * t**h, 6000)] + [(0, 5.0), (3, None)]
        got = collapse(spark.createDataFrame(rows, "t int, x double"), "t", "x", 20.0, [0.1 * i for i in range(1, 13)]).collect()
        assert [round(r.h, 1) for r in got if r.best] == [h] and all(r.times == 6 for r in got)


# ---------------------------------------------------------------- near-identical tracks
def slow_frechet(a, b):
    c = np.full((len(a), len(b)), np.inf)
    for i in range(len(a)):
        for j in range(len(b)):
            before = 0.0 if i == j == 0 else min(c[i - 1, j] if i else np.inf, c[i - 1, j - 1] if i and j else np.inf, c[i, j - 1] if j else np.inf)
            c[i, j] = max(np.hypot(*(a[i] - b[j])), before)
    return c[-1, -1]


def test_frechet_decides_as_the_whole_table():
    from vantrail.operators.duplicates import frechet

    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.normal(size=(rng.integers(1, 9), 2)).cumsum(axis=0)
        b = a if rng.random() < 0.6 else rng.normal(size=(rng.integers(1, 9), 2)).cumsum(axis=0)
        b = b[np.sort(rng.integers(0, len(b), rng.integers(1, 10)))] + rng.normal(size=2) * 0.2
        want, got = slow_frechet(a, b), frechet(a, b, 1.5)
        assert (got is None) == (want > 1.5) and (got is None or got == pytest.approx(want))


def test_near_tracks_are_those_of_all_pairs(spark):
    from vantrail.operators.duplicates import near_tracks, track_shapes
    from vantrail.plans.track_queries import copied

    fixes = copied(spark, "/root/testdata/sf0.001")
    fixes = fixes.unionByName(fixes.where("flight_id = 13").withColumn("flight_id", F.lit(99).cast("long")))
    pairs, members = near_tracks(fixes, metres=150.0, step_s=20.0)
    shapes = {(r.source, r.flight_id): np.array(r["shape"]) for r in track_shapes(fixes, 20.0).collect()}
    classes = {}
    for key in sorted(shapes):
        classes.setdefault(shapes[key].tobytes(), []).append(key)
    assert {(r.source, r.flight_id): (tuple(r["class"]), r["size"]) for r in members.collect()} == {k: (own[0], len(own)) for own in classes.values() for k in own}
    assert max(map(len, classes.values())) == 3  # a flight that was uploaded again as it was, twice
    heads = sorted(own[0] for own in classes.values())
    want = {}
    for i, a in enumerate(heads):
        for b in heads[i + 1 :]:
            d = slow_frechet(shapes[a], shapes[b])
            if d <= 150:
                want[a, b] = pytest.approx(d)
    assert {(tuple(r.class_a), tuple(r.class_b)): r.frechet_m for r in pairs.collect()} == want and len(want) >= 2


def test_near_tracks_of_nothing(spark):
    from vantrail.operators.duplicates import near_tracks
    from vantrail.plans.track_queries import view

    pairs, members = near_tracks(view(spark, "/root/testdata/sf0.001").where("false"))
    assert pairs.count() == 0 and members.count() == 0


def test_glides_and_the_waits_after_them(spark):
    from vantrail.operators.geometry import anatomy, coupling, glide_wait_pairs

    runs = [(1, "wait", 5.0, 1.0, 2.0, True), (2, "glide", 10.0, 100.0, 110.0, False), (3, "wait", 4.0, 2.0, 6.0, False), (4, "climb", 6.0, 3.0, 30.0, False), (5, "glide", 20.0, 300.0, 310.0, False), (6, "wait", 1.0, 0.0, 0.0, False), (7, "glide", 0.0, 0.0, 0.0, False), (8, "climb", 7.0, 1.0, 9.0, True)]
    df = spark.createDataFrame([("p", 1, *r) for r in runs] + [("p", 2, 1, "glide", 9.0, 9.0, 9.0, True)], "source string, flight_id long, run long, phase string, duration_s double, net_m double, path_m double, censored boolean")
    pairs = glide_wait_pairs(df, "glide")
    assert sorted((r.flight_id, r.run, r.length_m, r.glide_s, r.wait_s) for r in pairs.collect()) == [(1, 2, 100.0, 10.0, 10.0), (1, 5, 300.0, 20.0, 1.0)]  # the last glide's wait is cut off
    c = coupling(pairs).first()
    assert (c.n, c.speed_mps, c.speed_spread) == (2, 12.5, 2.5) and c.length_wait == pytest.approx(-1) and c.length_time == pytest.approx(1)
    own = {(r.flight_id, r.phase): r for r in anatomy(df).collect()}
    assert own[1, "glide"].n == 3 and own[1, "glide"].time_share == pytest.approx(30 / 53) and own[1, "climb"].way_share == pytest.approx(39 / 467)
    assert own[2, "glide"].time_share == 1.0 and coupling(pairs.where("false")).first().n == 0
