"""The cleaning plan over the view with injected defects, against plain loops over one flight at a time."""

from math import asin, cos, radians, sin, sqrt
from statistics import median

import pytest
from pyspark.sql import functions as F

from vantrail.config import Thresholds
from vantrail.operators import clean
from vantrail.plans.cleaning import clean_tracks
from vantrail.plans.queries import SOUND, sound_view

DATA = "/root/testdata/sf0.001"


def metres(a, b):
    p, q = radians(a["lat"]), radians(b["lat"])
    h = sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 6371008.8 * asin(min(1.0, sqrt(h)))


def one_backward(rows):
    """Without the one fix whose clock ran back; the view has no flight with more."""
    if all(a["t"] <= b["t"] for a, b in zip(rows, rows[1:])):
        return rows
    ways = [rows[:i] + rows[i + 1 :] for i in range(len(rows))]
    good = [w for w in ways if all(a["t"] <= b["t"] for a, b in zip(w, w[1:]))]
    assert len(good) == 1
    return good[0]


def merged(rows):
    out = []
    for t in sorted({r["t"] for r in rows}):
        own = [r for r in rows if r["t"] == t]
        mean = lambda c: sum(r[c] for r in own) / len(own)
        there = lambda c: (lambda v: sum(v) / len(v) if v else 0.0)([r[c] for r in own if r[c]])
        out.append({"t": t, "lat": mean("lat"), "lon": mean("lon"), "valid": all(r["valid"] for r in own), "baro_alt": there("baro_alt"), "gnss_alt": there("gnss_alt"), "fix_no": min(r["fix_no"] for r in own)})
    return out


def window(rows, r, half):
    return [x for x in rows if abs(x["t"] - r["t"]) <= half]


def spikes(rows, limits, bound):
    f = limits.fix_level
    for r in rows:
        near = window(rows, r, int(f.hampel_window_s))
        r["resid"] = metres({"lat": median(x["lat"] for x in near), "lon": median(x["lon"] for x in near)}, r)
    gone = []
    for i, r in enumerate(rows):
        near = window(rows, r, int(f.hampel_window_s))
        far = len(near) >= f.hampel_min_window_fixes and r["resid"] > max(f.hampel_k * 1.4826 * median(x["resid"] for x in near), f.hampel_eps_min_m)
        if far and 0 < i < len(rows) - 1 and all(metres(a, b) / (b["t"] - a["t"]) > bound for a, b in ((rows[i - 1], r), (r, rows[i + 1]))):
            gone.append(i)
    return gone


def blocks(rows, bound, longest):
    kept, splits, i = [rows[0]], set(), 1
    while i < len(rows):
        anchor = kept[-1]
        joins = lambda r: r["t"] <= anchor["t"] or metres(anchor, r) <= bound * (r["t"] - anchor["t"])  # noqa: B023, E731
        if joins(rows[i]):
            kept.append(rows[i])
            i += 1
            continue
        later = [j for j in range(i + 1, len(rows)) if rows[j - 1]["t"] - rows[i]["t"] <= longest and joins(rows[j])]
        if later:
            i = later[0]
        else:
            splits.add(rows[i]["t"])
        kept.append(rows[i])
        i += 1
    return kept, splits


def frozen(rows, limits, baro):
    f, out, i = limits.fix_level, [False] * len(rows), 0
    while i < len(rows):
        j = i
        while j + 1 < len(rows):
            box = rows[i : j + 2]
            lat, lon = [r["lat"] for r in box], [r["lon"] for r in box]
            if metres({"lat": min(lat), "lon": min(lon)}, {"lat": max(lat), "lon": max(lon)}) >= f.frozen_eps_m:
                break
            j += 1
        own = rows[i : j + 1]
        if own[-1]["t"] - own[0]["t"] < f.frozen_tau_s:
            i += 1
            continue
        same = max(b["t"] - a["t"] for x, a in enumerate(own) for y, b in enumerate(own) if x <= y and len({(r["lat"], r["lon"]) for r in own[x : y + 1]}) == 1)
        end = max(1, min(5, len(own) // 2))
        flat = baro and abs(median(r["baro_alt"] for r in own[:end]) - median(r["baro_alt"] for r in own[-end:])) < f.frozen_delta_z_m
        blind = not baro and all(not r["valid"] or r["gnss_alt"] == 0 for r in own)
        if same >= f.frozen_tau_s or flat or blind:
            out[i : j + 1] = [True] * len(own)
        i = j + 1
    return out


def null_altitudes(rows, limits, baro):
    f = limits.fix_level
    raw = [r["baro_alt"] if baro else r["gnss_alt"] for r in rows]
    for i, r in enumerate(rows):
        outside = not f.min_altitude_m <= raw[i] <= f.max_altitude_m
        steep = baro and i and abs((raw[i] - raw[i - 1]) / (r["t"] - rows[i - 1]["t"])) > f.max_vertical_speed_mps
        r["alt"] = None if outside or steep else raw[i]
    half = int(f.hampel_window_s)
    for r in rows:
        near = [x["alt"] for x in window(rows, r, half) if x["alt"] is not None]
        r["n_alt"], r["off"] = len(near), None if r["alt"] is None else abs(r["alt"] - median(near))
    bad = [r for r in rows if r["off"] is not None and r["n_alt"] >= f.hampel_min_window_fixes and r["off"] > max(f.hampel_k * 1.4826 * median(x["off"] for x in window(rows, r, half) if x["off"] is not None), f.hampel_eps_min_m)]
    for r in bad:
        r["alt"] = None


def runs(rows, of):
    """(value, first, last) of the maximal runs of a property of steps; a run begins with the fix before its first step."""
    out = []
    for i in range(len(rows)):
        v = of(i)
        if out and out[-1][0] == v:
            out[-1][2] = i
        else:
            out.append([v, i, i])
    return [(v, rows[max(a - 1, 0)]["t"], rows[b]["t"], rows[a : b + 1]) for v, a, b in out]


def brute(source, rows, limits):
    """(flight, segments) of one flight."""
    f, tr, sm, fl = limits.fix_level, limits.trimming, limits.sampling, limits.flight_level
    bound = f.max_horizontal_speed_mps[source]
    n_raw = len(rows)
    clock = one_backward(rows)
    gone = {"removed_clock": [r["t"] for r in rows if r not in clock], "removed_spike": [], "removed_block": [], "removed_frozen": []}
    if gone["removed_clock"]:
        lost = next(i for i, r in enumerate(rows) if r not in clock)
        gone["removed_clock"] = [rows[lost + 1]["t"]]  # counted at the fix after it
    rows = merged(clock)
    baro_there = sum(r["baro_alt"] != 0 for r in rows) / len(rows) >= limits.alt_channel.baro_present_frac
    baro = baro_there and max(r["baro_alt"] for r in rows) - min(r["baro_alt"] for r in rows) >= limits.alt_channel.baro_min_range_m
    bad = spikes(rows, limits, bound)
    gone["removed_spike"] = [rows[i]["t"] for i in bad]
    rows = [r for i, r in enumerate(rows) if i not in bad]
    kept, splits = blocks(rows, bound, f.block_max_s)
    gone["removed_block"] = [r["t"] for r in rows if r not in kept]
    rows = kept
    ice = frozen(rows, limits, baro)
    splits |= {rows[i]["t"] for i in range(1, len(rows)) if ice[i - 1] and not ice[i]}
    gone["removed_frozen"] = [r["t"] for r, x in zip(rows, ice, strict=True) if x]
    rows = [r for r, x in zip(rows, ice, strict=True) if not x]
    null_altitudes(rows, limits, baro)
    speed = lambda i: metres(rows[i - 1], rows[i]) / (rows[i]["t"] - rows[i - 1]["t"]) if i else None
    moving = [(a, b) for v, a, b, _ in runs(rows, lambda i: bool(i) and speed(i) > tr.takeoff_speed_mps) if v and b - a >= tr.sustained_s]
    if not moving:
        return {"reason": "never_moves", "n_raw": n_raw}, []
    on, off = min(a for a, _ in moving), max(b for _, b in moving)
    slow = [(a, b) for v, a, b, own in runs(rows, lambda i: bool(i) and speed(i) < tr.takeoff_speed_mps) if v and max(r["baro_alt"] for r in own) - min(r["baro_alt"] for r in own) <= tr.ground_flatness_m and b - a >= tr.interior_ground_s]
    rows = [r for r in rows if on <= r["t"] <= off]
    first, last = rows[0]["t"], rows[-1]["t"]
    flight = {"n_raw": n_raw, "alt_source": "baro" if baro else "gnss"} | {k: sum(first < t <= last for t in v) for k, v in gone.items()}
    flight["nulled_alt"] = sum(r["alt"] is None for r in rows)
    flight["n_airborne"] = len(rows) + sum(flight[k] for k in gone)
    splits |= {b for _, b in slow}
    rows = [r for r in rows if not any(a < r["t"] < b for a, b in slow)]
    alts = [r["alt"] for r in rows if r["alt"] is not None]
    flight |= {"n_clean": len(rows), "duration_s": rows[-1]["t"] - rows[0]["t"], "path_km": sum(metres(a, b) for a, b in zip(rows, rows[1:])) / 1000, "alt_range_m": max(alts) - min(alts)}
    changed = flight["nulled_alt"] + sum(flight[k] for k in gone)
    cuts = [("removed_fraction", changed / flight["n_airborne"] > f.integrity_max_fraction), ("too_short", flight["duration_s"] < fl.min_duration_s), ("too_long", flight["duration_s"] > fl.max_duration_s), ("short_path", flight["path_km"] < fl.min_path_km), ("flat", flight["alt_range_m"] < fl.min_alt_range_m)]
    flight["reason"] = next((name for name, is_so in cuts if is_so), None)
    if flight["reason"]:
        return flight, []
    gaps = [b["t"] - a["t"] for a, b in zip(rows, rows[1:])]
    dt = median(gaps)
    parts = [[rows[0]]]
    for r, gap in zip(rows[1:], gaps, strict=True):
        if gap > min(sm.max_gap_factor * dt, max(sm.max_gap_seconds, sm.gap_floor_ratio * dt)) or r["t"] in splits:
            parts.append([])
        parts[-1].append(r)
    segments = []
    for i, p in enumerate(parts):
        span = p[-1]["t"] - p[0]["t"]
        missing = max(0.0, 1 - len(p) / (span / dt + 1))
        segments.append((i, p[0]["t"], p[-1]["t"], len(p), missing <= sm.max_missing_fraction and span >= sm.min_segment_duration_s, i > 0, i < len(parts) - 1))
    return flight, segments


@pytest.fixture(scope="module")
def both(spark):
    view = sound_view(spark, DATA).collect()
    tracks = {}
    for r in sorted(view, key=lambda r: r.fix_no):
        tracks.setdefault((r.source, r.flight_id), []).append(r.asDict())
    return clean_tracks(sound_view(spark, DATA), SOUND), {k: brute(k[0], v, SOUND) for k, v in tracks.items()}


def test_flights(both):
    done, want = both
    rows = {(r.source, r.flight_id): r for r in done.flights.collect()}
    assert set(rows) == set(want)
    for key, (flight, _) in want.items():
        for name, value in flight.items():
            got = rows[key][name]
            assert got == (pytest.approx(value, rel=1e-9) if isinstance(value, float) else value), (key, name, got, value)


def test_segments(both):
    done, want = both
    got = {}
    for r in done.segments.orderBy("segment_id").collect():
        got.setdefault((r.source, r.flight_id), []).append((r.segment_id, r.t_start, r.t_end, r.n_fix, r.passes, r.cut_start, r.cut_end))
    assert got == {k: s for k, (_, s) in want.items() if s}


def test_rules_fire_and_flights_stay(both):
    done, want = both
    kept = [f for f, _ in want.values() if f["reason"] is None]
    assert 2 * len(kept) > len(want)
    fired = {k for f, _ in want.values() for k in ("removed_clock", "removed_spike", "removed_block", "removed_frozen", "nulled_alt") if f.get(k)}
    assert len(fired) == 5 and any(b[5] for _, s in want.values() for b in s)
    fixes = done.fixes
    assert fixes.where("east_m_vel is not null and alt_pos is not null").count() > 100
    assert fixes.where("interpolated").count() > 0


def test_frozen_stretches_are_those_of_whole_flights(spark):
    """Only candidate stretches go through Python; the mask is that of the loop over the whole flight."""
    rows = []
    for flight in range(6):
        lat = 45.0
        for i in range(400):
            parked = 50 <= i < 50 + 20 * flight or 200 <= i < 230 + 10 * flight or i < 70 * (flight % 2)
            lat += 1e-6 if parked else 2e-4
            rows.append(("paragliders", flight, i, float(5 * i), lat, 5.0, flight % 3 != 2, 0.0 if flight == 4 else float(900 + (i if not parked else 0)), 950.0))
    df = spark.createDataFrame(rows, "source string, flight_id long, fix_no int, t double, lat double, lon double, valid boolean, baro_alt double, gnss_alt double")
    limits = Thresholds()
    got = clean.frozen_runs(clean.altitude_source(df, limits), limits)
    found = {(r.flight_id, r.fix_no) for r in got.where("frozen").collect()}
    want = set()
    for flight in range(6):
        own = [dict(zip(("fix_no", "t", "lat", "lon", "valid", "baro_alt", "gnss_alt"), r[2:], strict=True)) for r in rows if r[1] == flight]
        want |= {(flight, r["fix_no"]) for r, x in zip(own, frozen(own, limits, flight != 4), strict=True) if x}
    assert found == want and want
    assert got.count() == len(rows) and got.agg(F.count_distinct("flight_id", "fix_no")).first()[0] == len(rows)
