"""Queries of the cleaning rules, grids, spectra and observables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from vantrail.functions.geo import c_trig
from vantrail.operators import catalog as catalogs
from vantrail.operators import census, clean, clusters, durations, geometry, lags, observables, phases, resample, spectral
from vantrail.operators.collapse import collapse
from vantrail.operators.duplicates import near_tracks
from vantrail.plans import store
from vantrail.plans.cleaning import clean_tracks
from vantrail.plans.queries import LIMITS, SOUND, merged, register, sound_view, statistics, table, view
from vantrail.plans.sql import MERGED, R, STATS, STEPS, VIEW, distance, query, r
from vantrail.session import dealt, shared_dir, written
from vantrail.sources import tracks

_MS = f"""
mw AS (SELECT *, t - lag(t) OVER f AS dt, lag(lat) OVER f AS plat, lag(lon) OVER f AS plon, baro_alt - lag(baro_alt) OVER f AS dz FROM d WINDOW f AS (PARTITION BY source, flight_id ORDER BY fix_no)),
ms AS (SELECT *, {distance("plat", "plon", "lat", "lon")} AS step_m FROM mw)
""".strip()


@register("a34_duplicate_merge", query(f"SELECT source, flight_id, fix_no, {r('t')}, {r('lat * 100', 'lat_x100')}, {r('lon * 100', 'lon_x100')}, valid, {r('baro_alt')}, {r('gnss_alt')}, n_merged FROM d", VIEW, MERGED))
def a34(spark, d):
    rows = clean.merge_duplicates(view(spark, d))
    return rows.withColumns({"lat_x100": F.col("lat") * 100, "lon_x100": F.col("lon") * 100}).drop("lat", "lon")  # means of sevenths places


@register("p21_flight_cuts", query("SELECT source, flight_id, CASE WHEN duration_s < 2400 THEN 'too_short' WHEN duration_s > 57600 THEN 'too_long' WHEN path_km < 30 THEN 'short_path' WHEN baro_alt_max_m - baro_alt_min_m < 75 THEN 'flat' END AS reason FROM st", VIEW, STEPS, STATS))
def p21(spark, d):
    c = statistics(spark, d)
    return c.select("source", "flight_id", census.flight_reason(F.col("duration_s"), F.col("path_km"), F.col("baro_alt_max_m") - F.col("baro_alt_min_m"), LIMITS).alias("reason"))


_ALT = """al AS (SELECT *, CASE WHEN avg(CASE WHEN baro_alt <> 0 THEN 1.0::DOUBLE ELSE 0.0 END) OVER p >= 0.5 AND max(baro_alt) OVER p - min(baro_alt) OVER p >= 30 THEN 'baro' ELSE 'gnss' END AS alt_source FROM v WINDOW p AS (PARTITION BY source, flight_id)),
am AS (SELECT *, CASE WHEN alt_source = 'baro' THEN baro_alt ELSE gnss_alt END AS alt FROM al)"""


@register("t7_alt_source", query(f"SELECT source, flight_id, fix_no, alt_source, {r('alt')} FROM am", VIEW, _ALT))
def t7(spark, d):
    return clean.altitude_source(view(spark, d), LIMITS).select("source", "flight_id", "fix_no", "alt_source", "alt")


@register("p22_altitude_band", query(f"""SELECT source, flight_id, fix_no, reason AS alt_reason, CASE WHEN reason IS NULL THEN {'round(alt, 6) + 0.0'} END AS alt FROM (SELECT *, CASE WHEN NOT (alt BETWEEN 100 AND 4000) THEN 'band' WHEN alt_source = 'baro' AND abs((alt - lag(alt) OVER f) / nullif(t - lag(t) OVER f, 0)) > 40 THEN 'steep' END AS reason FROM am WINDOW f AS (PARTITION BY source, flight_id ORDER BY fix_no))""", VIEW, _ALT))
def p22(spark, d):
    return clean.bad_altitudes(clean.altitude_source(view(spark, d), LIMITS), LIMITS).select("source", "flight_id", "fix_no", "alt_reason", "alt")


@register("a33_removal_counts", query("SELECT source, flight_id, count(*) AS n, CAST(sum(CASE WHEN NOT (alt BETWEEN 100 AND 4000) THEN 1 ELSE 0 END) AS BIGINT) AS removed, sum(CASE WHEN NOT (alt BETWEEN 100 AND 4000) THEN 1 ELSE 0 END) / count(*) <= 0.1 AS passes FROM am GROUP BY ALL", VIEW, _ALT))
def a33(spark, d):
    fixes = clean.altitude_source(view(spark, d), LIMITS).withColumn("reason", F.when(~F.col("alt").between(100, 4000), "band"))
    return clean.removal_counts(fixes, "reason", LIMITS)


@register("t8_clock_lis")
def t8(spark, d):
    t = F.when(F.col("fix_no") % 17 == 9, F.col("t") - 200).otherwise(F.col("t"))
    return clean.repair_clock(view(spark, d).withColumn("t", t)).select("source", "flight_id", "fix_no", "t", "kept")


_H = f"""h1 AS (SELECT *, quantile_cont(lat, 0.5) OVER g AS ml, quantile_cont(lon, 0.5) OVER g AS mo, count(*) OVER g AS n_near FROM d WINDOW g AS (PARTITION BY source, flight_id ORDER BY t RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING)),
h2 AS (SELECT *, {distance("ml", "mo", "lat", "lon")} AS resid_m FROM h1),
h3 AS (SELECT *, quantile_cont(resid_m, 0.5) OVER (PARTITION BY source, flight_id ORDER BY t RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING) AS mad_m FROM h2),
h4 AS (SELECT *, n_near >= 5 AND resid_m > greatest(5 * 1.4826 * mad_m, 15.0) AS hampel FROM h3)"""


@register("t9_hampel", query(f"SELECT source, flight_id, fix_no, n_near, round(resid_m, 3) + 0.0 AS resid_m, round(mad_m, 3) + 0.0 AS mad_m, hampel FROM h4", VIEW, MERGED, _H))
def t9(spark, d):
    found = clean.hampel(merged(spark, d), LIMITS)
    return found.select("source", "flight_id", "fix_no", "n_near", F.round("resid_m", 3).alias("resid_m"), F.round("mad_m", 3).alias("mad_m"), "hampel")


def _spiked(spark, d):
    far = F.col("fix_no") % 23 == 11
    return merged(spark, d).withColumn("lat", F.when(far, F.col("lat") + 0.5).otherwise(F.col("lat")))


_SPIKED = "sd AS (SELECT * REPLACE (CASE WHEN fix_no % 23 = 11 THEN lat + 0.5 ELSE lat END AS lat) FROM d)"


@register("t10_gate", query("SELECT source, flight_id, fix_no, coalesce(hampel AND v_in > b AND lead(v_in) OVER (PARTITION BY source, flight_id ORDER BY fix_no) > b, false) AS spike FROM (SELECT h4.*, CASE WHEN ms.dt > 0 THEN ms.step_m / ms.dt END AS v_in, CASE h4.source WHEN 'paragliders' THEN 45.0 ELSE 55.0 END AS b FROM h4 JOIN ms ON h4.source = ms.source AND h4.flight_id = ms.flight_id AND h4.fix_no = ms.fix_no)", VIEW, MERGED, _SPIKED, _H.replace("FROM d WINDOW", "FROM sd WINDOW"), _MS.replace("FROM d WINDOW", "FROM sd WINDOW")))
def t10(spark, d):
    return clean.impossible(clean.hampel(_spiked(spark, d), LIMITS), LIMITS).select("source", "flight_id", "fix_no", "spike")


@register("t12_alt_hampel", query("SELECT source, flight_id, fix_no, n_near, round(ar, 6) + 0.0 AS alt_resid_m, n_near >= 5 AND ar > greatest(5 * 1.4826 * am, 15.0) AS alt_hampel FROM (SELECT *, quantile_cont(ar, 0.5) OVER (PARTITION BY source, flight_id ORDER BY t RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING) AS am FROM (SELECT *, abs(baro_alt - quantile_cont(baro_alt, 0.5) OVER g) AS ar, count(*) OVER g AS n_near FROM d WINDOW g AS (PARTITION BY source, flight_id ORDER BY t RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING)))", VIEW, MERGED))
def t12(spark, d):
    return clean.hampel_altitude(merged(spark, d), LIMITS).select("source", "flight_id", "fix_no", "n_near", "alt_resid_m", "alt_hampel")


@register("t11_block_removal")
def t11(spark, d):
    return clean.remove_blocks(_spiked(spark, d), LIMITS).select("source", "flight_id", "fix_no", "kept", "split_before")


def _held(spark, d):
    hold = F.col("fix_no").between(20, 26)
    return merged(spark, d).withColumns({"lat": F.when(hold, F.lit(45.1)).otherwise(F.col("lat")), "lon": F.when(hold, F.lit(5.1)).otherwise(F.col("lon"))})


_HELD = "hd AS (SELECT * REPLACE (CASE WHEN fix_no BETWEEN 20 AND 26 THEN 45.1 ELSE lat END AS lat, CASE WHEN fix_no BETWEEN 20 AND 26 THEN 5.1 ELSE lon END AS lon) FROM d)"


@register("t13_frozen_run")
def t13(spark, d):
    held = dealt(_held(spark, d), "source", "flight_id")  # its windows sort many times in one task
    return clean.frozen_runs(clean.altitude_source(held, LIMITS), LIMITS).select("source", "flight_id", "fix_no", "frozen")


@register("t14_identical_runs", query(f"SELECT source, flight_id, CAST(run AS BIGINT) AS run, min(fix_no) AS first_fix, count(*) AS n, {r('max(t) - min(t)', 'span_s')}, {r('min(baro_alt)', 'baro_min')}, {r('max(baro_alt)', 'baro_max')} FROM (SELECT *, sum(nw) OVER (PARTITION BY source, flight_id ORDER BY fix_no) AS run FROM (SELECT *, CASE WHEN lat = lag(lat) OVER f AND lon = lag(lon) OVER f THEN 0 ELSE 1 END AS nw FROM hd WINDOW f AS (PARTITION BY source, flight_id ORDER BY fix_no))) GROUP BY source, flight_id, run HAVING count(*) > 1", VIEW, MERGED, _HELD))
def t14(spark, d):
    return clean.identical_runs(_held(spark, d))


_RUNS = """q1 AS (SELECT *, coalesce(lag(t) OVER f, t) AS tb, coalesce(dt > 0 AND step_m / dt > 12, false) AS moving, coalesce(dt > 0 AND step_m / dt < 12, false) AS slow FROM s WINDOW f AS (PARTITION BY source, flight_id ORDER BY fix_no)),
q2 AS (SELECT *, CASE WHEN moving = lag(moving) OVER f THEN 0 ELSE 1 END AS nm, CASE WHEN slow = lag(slow) OVER f THEN 0 ELSE 1 END AS ns FROM q1 WINDOW f AS (PARTITION BY source, flight_id ORDER BY fix_no)),
q3 AS (SELECT *, sum(nm) OVER (PARTITION BY source, flight_id ORDER BY fix_no) AS rm, sum(ns) OVER (PARTITION BY source, flight_id ORDER BY fix_no) AS rs FROM q2)"""


@register("t16_trim", query("SELECT source, flight_id, min(CASE WHEN mv AND t1 - t0 >= 60 THEN t0 END) AS t_on, max(CASE WHEN mv AND t1 - t0 >= 60 THEN t1 END) AS t_off, CASE WHEN min(CASE WHEN mv AND t1 - t0 >= 60 THEN t0 END) IS NULL THEN 'never_moves' END AS reason FROM (SELECT source, flight_id, rm, bool_and(moving) AS mv, min(tb) AS t0, max(t) AS t1 FROM q3 GROUP BY ALL) GROUP BY source, flight_id", VIEW, STEPS, _RUNS))
def t16(spark, d):
    return clean.trim_window(view(spark, d), LIMITS)


@register("t17_interior_ground", query("SELECT source, flight_id, t0, t1, CASE WHEN t1 - t0 >= 100 THEN 'ground' ELSE 'suspect' END AS kind FROM (SELECT source, flight_id, rs, min(tb) AS t0, max(t) AS t1, max(baro_alt) - min(baro_alt) AS ar FROM q3 WHERE slow GROUP BY ALL) WHERE ar <= 3000", VIEW, STEPS, _RUNS))
def t17(spark, d):
    return clean.interior_ground(view(spark, d), LIMITS)


# ---------------------------------------------------------------- frames, segments, grids
def _ecef(lat: str, lon: str, p: str) -> str:
    e2 = "(1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE))"
    n = f"(6378137.0::DOUBLE / sqrt(1 - {e2} * pow(sin(radians({lat})), 2)))"
    return f"{n} * cos(radians({lat})) * cos(radians({lon})) AS {p}x, {n} * cos(radians({lat})) * sin(radians({lon})) AS {p}y, {n} * (1 - {e2}) * sin(radians({lat})) AS {p}z"


def _enu(source: str) -> str:
    return f"""o AS (SELECT *, first_value(lat) OVER f AS la0, first_value(lon) OVER f AS lo0 FROM {source} WINDOW f AS (PARTITION BY source, flight_id ORDER BY fix_no)),
c AS (SELECT *, {_ecef("lat", "lon", "")}, {_ecef("la0", "lo0", "o")} FROM o),
en AS (SELECT *, CASE WHEN lat = la0 AND lon = lo0 THEN 0.0::DOUBLE ELSE -sin(radians(lo0)) * (x - ox) + cos(radians(lo0)) * (y - oy) END AS east_m,
  CASE WHEN lat = la0 AND lon = lo0 THEN 0.0::DOUBLE ELSE -sin(radians(la0)) * cos(radians(lo0)) * (x - ox) - sin(radians(la0)) * sin(radians(lo0)) * (y - oy) + cos(radians(la0)) * (z - oz) END AS north_m FROM c)"""


_R3 = lambda x, n=None: f"round({x}, 3) + 0.0 AS {n or x}"


@register("t18_enu", query(f"SELECT source, flight_id, fix_no, {_R3('east_m')}, {_R3('north_m')} FROM en", VIEW, _enu("v")))
def t18(spark, d):
    return resample.with_enu(view(spark, d)).select("source", "flight_id", "fix_no", F.round("east_m", 3).alias("east_m"), F.round("north_m", 3).alias("north_m"))


@register("t19_local_en", query(f"SELECT source, flight_id, fix_no, {_R3(f'radians(lon - avg(lon) OVER p) * {R} * cos(radians(avg(lat) OVER p))', 'x_m')}, {_R3(f'radians(lat - avg(lat) OVER p) * {R}', 'y_m')} FROM v WINDOW p AS (PARTITION BY source, flight_id)", VIEW))
def t19(spark, d):
    return resample.with_local(view(spark, d)).select("source", "flight_id", "fix_no", F.round("x_m", 3).alias("x_m"), F.round("y_m", 3).alias("y_m"))


def _seg(source: str) -> str:
    return f"""g1 AS (SELECT *, t - lag(t) OVER (PARTITION BY source, flight_id ORDER BY fix_no) AS gap FROM {source}),
g2 AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY source, flight_id) AS dt_s FROM g1),
g3 AS (SELECT *, CAST(sum(CASE WHEN gap > least(4 * dt_s, greatest(20.0, 3 * dt_s)) THEN 1 ELSE 0 END) OVER (PARTITION BY source, flight_id ORDER BY fix_no) AS SMALLINT) AS segment_id FROM g2)"""


@register("t20_segments", query(f"SELECT source, flight_id, fix_no, {r('dt_s')}, segment_id FROM g3", VIEW, MERGED, _seg("d")))
def t20(spark, d):
    return resample.with_segments(merged(spark, d), LIMITS).select("source", "flight_id", "fix_no", "dt_s", "segment_id")


@register("t21_segment_gates", query(f"SELECT source, flight_id, segment_id, t_start, t_end, n_fix, {r('dt_s')}, {r('missing')}, coalesce(missing <= 0.4 AND t_end - t_start >= 90, false) AS passes FROM (SELECT source, flight_id, segment_id, min(t) AS t_start, max(t) AS t_end, count(*) AS n_fix, max(dt_s) AS dt_s, CASE WHEN max(dt_s) > 0 THEN greatest(0.0, 1 - count(*) / ((max(t) - min(t)) / max(dt_s) + 1)) END AS missing FROM g3 GROUP BY ALL)", VIEW, MERGED, _seg("d")))
def t21(spark, d):
    return resample.segment_table(resample.with_segments(merged(spark, d), LIMITS), LIMITS)


def _linear(step: str, closed: bool) -> tuple[str, ...]:
    last = f"CASE WHEN (t - t0) = ceil((t - t0) / {step}) * {step} THEN CAST(ceil((t - t0) / {step}) AS BIGINT) END" if closed else "NULL"
    return (VIEW, MERGED, f"""i1 AS (SELECT *, min(t) OVER (PARTITION BY source, flight_id) AS t0, lead(t) OVER f AS tn, lead(baro_alt) OVER f AS bn, lead(gnss_alt) OVER f AS gn FROM d WINDOW f AS (PARTITION BY source, flight_id ORDER BY t)),
i2 AS (SELECT *, CAST(ceil((t - t0) / {step}) AS BIGINT) AS k0, CASE WHEN tn IS NULL THEN {last} ELSE CAST(ceil((tn - t0) / {step}) AS BIGINT) - 1 END AS k1 FROM i1),
i3 AS (SELECT *, unnest(range(k0, k1 + 1)) AS k FROM i2 WHERE k1 >= k0)""")


def _lin(v: str, vn: str, step: str) -> str:
    return r(f"{v} + coalesce(CASE WHEN tn IS NULL THEN 0.0 ELSE (t0 + k * {step} - t) / (tn - t) END * ({vn} - {v}), 0.0)", v)


@register("r1_resample", query(f"SELECT source, flight_id, k, {r('t0 + k * 30.0', 'grid_t')}, {_lin('baro_alt', 'bn', '30.0::DOUBLE')}, {_lin('gnss_alt', 'gn', '30.0::DOUBLE')} FROM i3", *_linear("30.0::DOUBLE", True)))
def r1(spark, d):
    return resample.linear_grid(merged(spark, d), ["source", "flight_id"], ["baro_alt", "gnss_alt"], F.lit(30.0))


@register("r2_resample", query(f"SELECT source, flight_id, k, {r('t0 + k * 1.0', 'grid_t')}, {_lin('baro_alt', 'bn', '1.0::DOUBLE')} FROM i3", *_linear("1.0::DOUBLE", False)))
def r2(spark, d):
    return resample.linear_grid(merged(spark, d), ["source", "flight_id"], ["baro_alt"], F.lit(1.0), closed=False)


def _grid(spark, d):
    placed = resample.with_segments(resample.with_enu(clean.altitude_source(merged(spark, d), LIMITS)), LIMITS)
    return resample.native_grid(placed)


def _end(h0: str, h1: str, d0: str, d1: str) -> str:
    three = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
    return f"CASE WHEN {d1} IS NULL THEN {d0} WHEN {three} * {d0} <= 0 THEN 0.0 WHEN {d0} * {d1} <= 0 AND abs({three}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {three} END"


def _slope(v: str) -> str:
    inner = f"CASE WHEN d{v} * db{v} <= 0 THEN 0.0 ELSE (3 * h + 3 * hb) / ((2 * h + hb) / db{v} + (h + 2 * hb) / d{v}) END"
    return f"CASE WHEN d{v} IS NULL AND db{v} IS NULL THEN 0.0 WHEN db{v} IS NULL THEN {_end('h', 'hn', f'd{v}', f'dn{v}')} WHEN d{v} IS NULL THEN {_end('hb', 'hbb', f'db{v}', f'dbb{v}')} ELSE {inner} END AS m{v}"


def _hermite(v: str, name: str) -> str:
    return f"CASE WHEN tn IS NULL THEN {name} ELSE (1 + 2 * u) * (1 - u) * (1 - u) * {name} + u * (1 - u) * (1 - u) * h * m{v} + u * u * (3 - 2 * u) * {v}n + u * u * (u - 1) * h * mn{v} END"


_S = "PARTITION BY source, flight_id, segment_id ORDER BY t"
_LAGS = ", ".join(f"(lead({c}) OVER z - {c}) / (lead(t) OVER z - t) AS d{v}, lead({c}) OVER z AS {v}n" for v, c in (("e", "east_m"), ("n", "north_m")))
_MORE = ", ".join(f"lead(d{v}) OVER z AS dn{v}, lag(d{v}) OVER z AS db{v}, lag(d{v}, 2) OVER z AS dbb{v}" for v in "en")
_PCHIP = (
    VIEW, MERGED, _ALT.replace("FROM v WINDOW", "FROM d WINDOW"), _enu("am"), _seg("en"),
    f"""h1 AS (SELECT *, lead(t) OVER z - t AS h, lead(t) OVER z AS tn, lead(alt) OVER z AS an, min(t) OVER (PARTITION BY source, flight_id, segment_id) AS t0, {_LAGS} FROM g3 WINDOW z AS ({_S})),
h2 AS (SELECT *, lead(h) OVER z AS hn, lag(h) OVER z AS hb, lag(h, 2) OVER z AS hbb, {_MORE} FROM h1 WINDOW z AS ({_S})),
h3 AS (SELECT *, {_slope("e")}, {_slope("n")} FROM h2),
h4 AS (SELECT *, lead(me) OVER z AS mne, lead(mn) OVER z AS mnn, CAST(ceil((t - t0) / dt_s) AS BIGINT) AS k0, CASE WHEN tn IS NULL THEN CASE WHEN t - t0 = ceil((t - t0) / dt_s) * dt_s THEN CAST(ceil((t - t0) / dt_s) AS BIGINT) END ELSE CAST(ceil((tn - t0) / dt_s) AS BIGINT) - 1 END AS k1 FROM h3 WHERE dt_s > 0 WINDOW z AS ({_S})),
h5 AS (SELECT *, unnest(range(k0, k1 + 1)) AS k FROM h4 WHERE k1 >= k0),
h6 AS (SELECT *, t0 + k * dt_s AS grid_t, CASE WHEN tn IS NULL THEN 0.0 ELSE (t0 + k * dt_s - t) / h END AS u FROM h5),
gd AS (SELECT source, flight_id, segment_id, k, grid_t, dt_s, {_hermite("e", "east_m")} AS east_m, {_hermite("n", "north_m")} AS north_m, alt + coalesce(u * (an - alt), 0.0) AS alt, least(grid_t - t, coalesce(tn - grid_t, grid_t - t)) > dt_s / 2 AS interpolated FROM h6)""",
)


@register("r3_grid", query(f"SELECT source, flight_id, segment_id, k, {r('grid_t')}, {r('dt_s')}, {_R3('east_m')}, {_R3('north_m')}, {_R3('alt')}, interpolated FROM gd", *_PCHIP))
def r3(spark, d):
    return _grid(spark, d).withColumns({c: F.round(c, 3) for c in ("east_m", "north_m", "alt")})


def _cubic(derivative: int) -> str:
    """The derivative of the cubic through five points y[1] to y[5], at position a of them, as its least-squares weights by a polynomial fit
    of each unit vector."""
    at = [np.polyfit(np.arange(5) - a, np.eye(5), 3)[3 - derivative] * (2 if derivative == 2 else 1) for a in range(5)]
    sums = [" + ".join(f"{w!r}::DOUBLE * y[{j + 1}]" for j, w in enumerate(map(float, row))) for row in at]
    return "CASE a " + " ".join(f"WHEN {a} THEN {x}" for a, x in enumerate(sums)) + " END"


_SG = ", ".join(f"round(CASE WHEN n >= 5 THEN ({_cubic(i)}) / pow(dt_s, {i}) END, 3) + 0.0 AS east_m_{name}" for i, name in enumerate(("pos", "vel", "acc")))


@register("r5_savgol5", query(f"SELECT source, flight_id, segment_id, k, {_SG} FROM (SELECT *, i - s AS a, all_[s + 1:s + 5] AS y FROM (SELECT *, least(greatest(i - 2, 0), n - 5) AS s FROM (SELECT *, row_number() OVER z - 1 AS i, count(*) OVER (PARTITION BY source, flight_id, segment_id) AS n, list(east_m) OVER (PARTITION BY source, flight_id, segment_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_ FROM gd WINDOW z AS (PARTITION BY source, flight_id, segment_id ORDER BY k))))", *_PCHIP))
def r5(spark, d):
    grid = _grid(spark, d)
    smooth = resample.savgol5(grid, "east_m", resample.SEGMENT, F.col("dt_s"))
    return smooth.select(*resample.SEGMENT, "k", *[F.round(f"east_m_{x}", 3).alias(f"east_m_{x}") for x in ("pos", "vel", "acc")])


# ---------------------------------------------------------------- spectra
_SPEC = "x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings WHERE len(embedding) = 64)"


def _spectra(spark, d):
    return table(spark, d, "embeddings").select(F.col("label"), F.col("embedding").cast("array<double>").alias("pxx"))


@register("a15_median_psd", query(f"SELECT label, CAST(k AS INTEGER) AS k, {r('quantile_cont(v, 0.5)', 'median')} FROM x GROUP BY ALL", _SPEC))
def a15(spark, d):
    return spectral.ensemble(_spectra(spark, d), 64, "pxx", [0.5], ["label"]).select("label", "k", F.col("q_50").alias("median"))


@register("a16_mean_psd", query(f"SELECT label, CAST(k AS INTEGER) AS k, count(*) AS n, {r('avg(v)', 'mean')} FROM x GROUP BY ALL", _SPEC))
def a16(spark, d):
    return spectral.ensemble(_spectra(spark, d), 64, "pxx", [0.5], ["label"]).select("label", "k", "n", "mean")


@register("a17_band", query(f"SELECT label, CAST(k AS INTEGER) AS k, {r('quantile_cont(v, 0.1)', 'q_10')}, {r('quantile_cont(v, 0.5)', 'q_50')}, {r('quantile_cont(v, 0.9)', 'q_90')} FROM x GROUP BY ALL", _SPEC))
def a17(spark, d):
    return spectral.ensemble(_spectra(spark, d), 64, "pxx", groups=["label"]).select("label", "k", "q_10", "q_50", "q_90")


@register("a18_pooled_band", query(f"SELECT label, CAST(k AS INTEGER) AS k, count(*) AS n, {r('quantile_cont(v, 0.1)', 'q_10')}, {r('quantile_cont(v, 0.9)', 'q_90')} FROM x GROUP BY GROUPING SETS ((label, k), (k))", _SPEC))
def a18(spark, d):
    return spectral.ensemble(_spectra(spark, d), 64, "pxx", groups=["label"], pool="label").select("label", "k", "n", "q_10", "q_90")


@register("w4_knee", query(f"""SELECT label, {r('max(fl)', 'floor')}, {r('min(CASE WHEN f > 0 AND p <= 1.2 * fl THEN f END)', 'f_c')}, {r('1 / min(CASE WHEN f > 0 AND p <= 1.2 * fl THEN f END)', 'tau')} FROM (SELECT c.*, b.fl FROM c JOIN (SELECT label, quantile_cont(p, 0.5) AS fl FROM c WHERE f BETWEEN 0.35 AND 0.5 GROUP BY label) b USING (label)) GROUP BY label""", _SPEC, "c AS (SELECT label, k / 128.0::DOUBLE AS f, quantile_cont(v * v, 0.5) AS p FROM x GROUP BY ALL)"))
def w4(spark, d):
    squared = _spectra(spark, d).withColumn("pxx", F.transform("pxx", lambda x: x * x))
    curve = spectral.ensemble(squared, 64, "pxx", [0.5], ["label"]).select("label", (F.col("k") / 128.0).alias("f"), F.col("q_50").alias("p"))
    return spectral.knee(curve, "f", "p", "label", factor=1.2)


def _welch(n: int, fs: str, keys: str, out: str) -> str:
    """Tables of the densities ({keys}, f, p) of x over i (0, 1, ...) in ``src``: half-overlapping segments of n, as plain Fourier sums."""
    return f"""nn AS (SELECT {keys}, count(*) AS points FROM src GROUP BY {keys} HAVING count(*) >= {n}),
sg AS (SELECT src.*, i - {n // 2} * g AS j, g FROM (SELECT *, unnest(range(0, (points - {n}) // {n // 2} + 1)) AS g FROM nn) JOIN src USING ({keys}) WHERE i BETWEEN {n // 2} * g AND {n // 2} * g + {n - 1}),
fl AS (SELECT {keys}, g, j, (x - avg(x) OVER z - (j - {(n - 1) / 2}) * regr_slope(x, j) OVER z) * (0.5 - 0.5 * cos(2 * pi() * j / {n})) AS y FROM sg WINDOW z AS (PARTITION BY {keys}, g)),
pw AS (SELECT {keys}, g, f, (pow(sum(y * cos(2 * pi() * f * j / {n})), 2) + pow(sum(y * sin(2 * pi() * f * j / {n})), 2)) / ({fs} * {n * 3 / 8}) * CASE WHEN f BETWEEN 1 AND {n // 2 - 1} THEN 2 ELSE 1 END AS p FROM fl, (SELECT unnest(range(0, {n // 2 + 1})) AS f) GROUP BY {keys}, g, f),
{out} AS (SELECT {keys}, f, avg(p) AS p FROM pw GROUP BY {keys}, f)"""


@register("w1_welch", query(f"SELECT vec_id, label, CAST(f AS INTEGER) AS k, {r('p')} FROM wl", "src AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)", _welch(64, "1.0", "vec_id, label", "wl")))
def w1(spark, d):
    series = table(spark, d, "embeddings").select("vec_id", "label", spectral.welch_column(F.col("embedding"), 1.0, 64).alias("pxx"))
    return series.select("vec_id", "label", F.posexplode("pxx").alias("k", "p"))


_MODAL = "m AS (SELECT round_even(dt_s, 0) AS r FROM st WHERE dt_s >= 0.5 GROUP BY 1 ORDER BY count(*) DESC, r LIMIT 1)"
_ELIGIBLE = "el AS (SELECT source, flight_id, n_fix FROM st, m WHERE n_fix >= 60 AND baro_present_frac >= 0.5 AND abs(dt_s - r) <= 3)"


def _on_grid(rows: str, step: str, closed: bool, channels: dict[str, str]) -> str:
    """``src`` of the channels on grids of a step, from a table (source, flight_id, t, channels)."""
    last = f"CASE WHEN (t - t0) = ceil((t - t0) / {step}) * {step} THEN CAST(ceil((t - t0) / {step}) AS BIGINT) END" if closed else "NULL"
    nexts = ", ".join(f"lead({c}) OVER f AS {c}_n" for c in channels)
    at = lambda c: f"{c} + coalesce(CASE WHEN tn IS NULL THEN 0.0 ELSE (t0 + i * {step} - t) / (tn - t) END * ({c}_n - {c}), 0.0)"
    union = " UNION ALL ".join(f"SELECT source, flight_id, {name} AS channel, '{c}' AS part, i, {at(c)} AS x FROM j3" for c, name in channels.items())
    return f"""j1 AS (SELECT *, min(t) OVER (PARTITION BY source, flight_id) AS t0, lead(t) OVER f AS tn, {nexts} FROM {rows} WINDOW f AS (PARTITION BY source, flight_id ORDER BY t)),
j2 AS (SELECT *, CAST(ceil((t - t0) / {step}) AS BIGINT) AS k0, CASE WHEN tn IS NULL THEN {last} ELSE CAST(ceil((tn - t0) / {step}) AS BIGINT) - 1 END AS k1 FROM j1),
j3 AS (SELECT *, unnest(range(k0, k1 + 1)) AS i FROM j2 WHERE k1 >= k0),
src AS ({union})"""


def _bands(at: str = "q") -> str:
    return ", ".join(f"round(quantile_cont(p, {q / 100}), 1) + 0.0 AS {at}_{q}" for q in (10, 50, 90))


_BOTH = "ea AS (SELECT source, flight_id, t, avg(baro_alt) AS baro, avg(gnss_alt) AS gnss FROM v JOIN el USING (source, flight_id) GROUP BY ALL)"


@register("w3_spectra", query(f"SELECT source, channel, CAST(f AS INTEGER) AS k, {r('f / (16 * (SELECT r FROM m))', 'hz')}, count(*) AS n, {_bands()} FROM wl GROUP BY GROUPING SETS ((source, channel, f), (channel, f))", VIEW, STEPS, STATS, _MODAL, _ELIGIBLE, _BOTH, _on_grid("ea", "(SELECT r FROM m)", True, {"baro": "'baro'", "gnss": "'gnss'"}), _welch(16, "(1 / (SELECT r FROM m))", "source, flight_id, channel", "wl")))
def w3_spectra(spark, d):
    c = statistics(spark, d)
    modal = census.modal_interval(c)
    spectra = spectral.altitude_spectra(view(spark, d), c, modal, tolerance=3.0, least=60, nperseg=16)
    bands = spectral.ensemble(spectra, 9, "pxx", groups=["source", "channel"], pool="source").crossJoin(F.broadcast(modal))  # one row
    return bands.select("source", "channel", "k", (F.col("k") / (16 * F.col("modal_dt_s"))).alias("hz"), "n", *[F.round(q, 1).alias(q) for q in ("q_10", "q_50", "q_90")])


@register("f5_noise", query(f"SELECT source, flight_id, fix_no, {r('t - t0', 't')}, {r('baro_alt')}, {r('gnss_alt')}, {r('gnss_alt - baro_alt - avg(gnss_alt - baro_alt) OVER ()', 'offset_m')} FROM (SELECT v.*, min(t) OVER () AS t0 FROM v JOIN (SELECT source, flight_id FROM el ORDER BY n_fix DESC, source, flight_id LIMIT 1) USING (source, flight_id)) WHERE t <= t0 + 1800", VIEW, STEPS, STATS, _MODAL, _ELIGIBLE))
def f5(spark, d):
    c = statistics(spark, d)
    return spectral.noise_panel(view(spark, d), spectral.eligible(c, census.modal_interval(c), tolerance=3.0, least=60))


_LOCAL = f"lo AS (SELECT source, flight_id, t, radians(lon - avg(lon) OVER p) * {R} * cos(radians(avg(lat) OVER p)) AS east, radians(lat - avg(lat) OVER p) * {R} AS north, CASE WHEN baro_present_frac >= 0.5 THEN baro_alt ELSE gnss_alt END AS up, baro_present_frac >= 0.5 AS b FROM v JOIN st USING (source, flight_id) WHERE n_fix >= 32 AND abs(dt_s - 10) <= 60 WINDOW p AS (PARTITION BY source, flight_id)), lm AS (SELECT source, flight_id, t, b, avg(east) AS east, avg(north) AS north, avg(up) AS up FROM lo GROUP BY ALL)"
_KNEE = "kn AS (SELECT c.channel, max(n) AS n, max(fl) AS floor, min(CASE WHEN f > 0 AND m50 <= 3 * fl THEN f END) AS f_c, min(CASE WHEN f > 0 AND m90 <= 3 * fn THEN f END) AS f_n FROM cv c JOIN (SELECT channel, quantile_cont(m50, 0.5) AS fl, quantile_cont(m90, 0.5) AS fn FROM cv WHERE f BETWEEN 0.35::DOUBLE / 10 AND 0.5::DOUBLE / 10 GROUP BY channel) USING (channel) GROUP BY c.channel)"


@register("w5_timescales", query(f"SELECT channel, n AS n_flights, round(floor, 1) + 0.0 AS floor, {r('f_c')}, {r('1 / f_c', 'tau')}, {r('1 / f_n', 'tau_p90')} FROM kn", VIEW, STEPS, STATS, _LOCAL, _on_grid("lm", "10.0::DOUBLE", False, {"east": "'horizontal'", "north": "'horizontal'", "up": "CASE WHEN b THEN 'vertical_baro' ELSE 'vertical_gnss' END"}), _welch(32, "0.1::DOUBLE", "source, flight_id, channel, part", "wl"), "cv AS (SELECT channel, f / 320.0::DOUBLE AS f, count(DISTINCT (source, flight_id)) AS n, quantile_cont(p, 0.5) AS m50, quantile_cont(p, 0.9) AS m90 FROM wl GROUP BY ALL)", _KNEE))
def w5(spark, d):
    found = spectral.timescales(view(spark, d), statistics(spark, d), cadence=10.0, tolerance=60.0, sample=None, nperseg=32, least=32)
    return found.select("channel", "n_flights", F.round("floor", 1).alias("floor"), "f_c", "tau", "tau_p90")


@register("w3_eligible", query(f"SELECT source, flight_id, n_fix, {r('dt_s')} FROM st, m WHERE n_fix >= 60 AND baro_present_frac >= 0.5 AND abs(dt_s - r) <= 3", VIEW, STEPS, STATS, "m AS (SELECT round_even(dt_s, 0) AS r FROM st WHERE dt_s >= 0.5 GROUP BY 1 ORDER BY count(*) DESC, r LIMIT 1)"))
def w3(spark, d):
    c = statistics(spark, d)
    return spectral.eligible(c, census.modal_interval(c), tolerance=3.0, least=60).select("source", "flight_id", "n_fix", "dt_s")


# ---------------------------------------------------------------- observables
def _points(spark, d):
    return resample.with_enu(view(spark, d)).withColumn("minute", F.floor(F.col("t") / 60))


_PT = (VIEW, _enu("v"), "pt AS (SELECT *, CAST(floor(t / 60) AS BIGINT) AS minute FROM en)")


@register("b1_msd", query("SELECT minute, count(*) AS n, round(avg(east_m * east_m + north_m * north_m), 1) + 0.0 AS msd FROM pt GROUP BY minute", *_PT))
def b1(spark, d):
    return observables.msd(_points(spark, d), "minute").select("minute", "n", F.round("msd", 1).alias("msd"))


@register("b6_nongauss", query(f"SELECT minute, CASE WHEN avg(east_m * east_m + north_m * north_m) > 0 THEN {'round(avg(pow(east_m * east_m + north_m * north_m, 2)) / (2 * pow(avg(east_m * east_m + north_m * north_m), 2)) - 1, 6) + 0.0'} END AS non_gaussian FROM pt GROUP BY minute", *_PT))
def b6(spark, d):
    return observables.msd(_points(spark, d), "minute").select("minute", "non_gaussian")


_GK = "PARTITION BY source, flight_id, segment_id"
_PAIRS = "SELECT a.source, a.flight_id, CAST(b.k - a.k AS INTEGER) AS lag, max(a.dt_s) * (b.k - a.k) AS lag_s, count(*) AS n, avg({what}) AS {name} FROM {rows} a JOIN {rows} b ON a.source = b.source AND a.flight_id = b.flight_id AND a.segment_id = b.segment_id AND b.k >= a.k GROUP BY a.source, a.flight_id, b.k - a.k"
_TM = "tm AS (" + _PAIRS.format(rows="gd", name="tamsd", what="pow(b.east_m - a.east_m, 2) + pow(b.north_m - a.north_m, 2)") + ")"
_VV = f"vv AS (SELECT * FROM (SELECT source, flight_id, segment_id, k, dt_s, (lead(east_m) OVER z - east_m) / dt_s AS vx, (lead(north_m) OVER z - north_m) / dt_s AS vy FROM gd WINDOW z AS ({_GK} ORDER BY k)) WHERE vx IS NOT NULL)"
_VC = "vc AS (" + _PAIRS.format(rows="vv", name="vacf", what="a.vx * b.vx + a.vy * b.vy") + ")"
_LAGS_OF_ALL = "ow AS (SELECT source, flight_id, CAST(floor(log2(lag_s) + 1e-9) AS INTEGER) AS lag_class, sum(tamsd * n) / sum(n) AS v FROM tm WHERE lag_s > 0 GROUP BY ALL)"
_OVER = "lag_class, count(*) AS flights, round(avg(v), 1) + 0.0 AS mean, CASE WHEN avg(v) <> 0 THEN round(var_pop(v) / pow(avg(v), 2), 6) + 0.0 END AS eb"


@register("b2_tamsd", query(f"SELECT source, flight_id, lag, {r('lag_s')}, n, round(tamsd, 1) + 0.0 AS tamsd FROM tm WHERE lag IN (1, 2, 4, 8, 16, 32)", *_PCHIP, _TM))
def b2(spark, d):
    return lags.time_averaged_msd(_grid(spark, d), [1, 2, 4, 8, 16, 32]).withColumn("tamsd", F.round("tamsd", 1))


@register("b3_ergodicity", query(f"SELECT CAST(NULL AS VARCHAR) AS stratum, {_OVER} FROM ow GROUP BY lag_class", *_PCHIP, _TM, _LAGS_OF_ALL))
def b3(spark, d):
    return lags.over_flights(lags.time_averaged_msd(_grid(spark, d)), "tamsd").withColumn("mean", F.round("mean", 1))


_AGES = (2400.0, 2520.0)


@register("b3_aging", query(f"SELECT CASE WHEN span < 2400 THEN 'below 2400' WHEN span < 2520 THEN '2400 to 2520' ELSE '2520 on' END AS stratum, {_OVER} FROM ow JOIN (SELECT source, flight_id, max(grid_t) - min(grid_t) AS span FROM gd GROUP BY ALL) USING (source, flight_id) GROUP BY 1, lag_class", *_PCHIP, _TM, _LAGS_OF_ALL))
def b3_aging(spark, d):
    grid = written(_grid(spark, d))
    return lags.over_flights(lags.time_averaged_msd(grid), "tamsd", lags.duration_strata(grid, _AGES)).withColumn("mean", F.round("mean", 1))


@register("b7_vacf", query(f"SELECT source, flight_id, lag, {r('lag_s')}, n, round(vacf, 3) + 0.0 AS vacf FROM vc WHERE lag IN (0, 1, 2, 4, 8)", *_PCHIP, _VV, _VC))
def b7(spark, d):
    w = Window.partitionBy(*resample.SEGMENT).orderBy("k")
    speed = lambda c: (F.lead(c).over(w) - F.col(c)) / F.col("dt_s")
    moving = _grid(spark, d).withColumns({"vx": speed("east_m"), "vy": speed("north_m")}).where(F.col("vx").isNotNull())
    return lags.velocity_autocorrelation(moving, [0, 1, 2, 4, 8]).withColumn("vacf", F.round("vacf", 3))


@register("b8_turning", query("SELECT source, flight_id, fix_no, CASE WHEN ax * ax + ay * ay > 0 AND bx * bx + byy * byy > 0 THEN round(atan2(ax * byy - ay * bx, ax * bx + ay * byy), 4) + 0.0 END AS turn FROM (SELECT *, lead(ax) OVER f AS bx, lead(ay) OVER f AS byy FROM (SELECT *, east_m - lag(east_m) OVER f AS ax, north_m - lag(north_m) OVER f AS ay FROM en WINDOW f AS (PARTITION BY source, flight_id ORDER BY fix_no)) WINDOW f AS (PARTITION BY source, flight_id ORDER BY fix_no))", VIEW, _enu("v")))
def b8(spark, d):
    """By the C library's sines: last bits decide which way a reversal, half a turn, goes."""
    return observables.turning_angles(resample.with_enu(view(spark, d), c_trig)).select("source", "flight_id", "fix_no", F.round("turn", 4).alias("turn"))


@register("b9_first_passage", query("SELECT source, flight_id, q AS radius, min(CASE WHEN sqrt(east_m * east_m + north_m * north_m) >= q THEN t END) AS t FROM en, (SELECT unnest([500, 1000, 5000, 10000]::DOUBLE[]) AS q) GROUP BY ALL", VIEW, _enu("v")))
def b9(spark, d):
    return observables.first_passage(resample.with_enu(view(spark, d)), [500, 1000, 5000, 10000])


@register("b10_speed_distribution", query("SELECT source, CAST(floor(step_m / dt / 10 + 0.5) AS BIGINT) AS bin, count(*) AS n FROM s WHERE dt > 0 GROUP BY ALL", VIEW, STEPS))
def b10(spark, d):
    steps = tracks.with_steps(view(spark, d)).where("dt > 0").withColumn("v", F.col("step_m") / F.col("dt"))
    return observables.propagator(steps, "source", "v", 10.0).select("source", "bin", "n")


@register("b10_climb_distribution", query("SELECT source, CAST(floor(dz / dt + 0.5) AS BIGINT) AS bin, count(*) AS n FROM s WHERE dt > 0 GROUP BY ALL", VIEW, STEPS))
def b10_climb(spark, d):
    steps = tracks.with_steps(view(spark, d)).where("dt > 0").withColumn("v", F.col("dz") / F.col("dt"))
    return observables.propagator(steps, "source", "v", 1.0).select("source", "bin", "n")


_CATALOG = "ct AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'hang gliders' ELSE 'paragliders' END AS source, c_custkey AS flight_id, c_mktsegment AS stratum FROM customer)"


@register("j11_stratum_msd", query("SELECT stratum, minute, count(*) AS n, round(avg(east_m * east_m + north_m * north_m), 1) + 0.0 AS msd FROM pt JOIN ct USING (source, flight_id) GROUP BY ALL", *_PT, _CATALOG))
def j11(spark, d):
    """Strata from a catalog by source and flight, here the customer of the flight's number and the market segment."""
    key = F.col("c_custkey")
    flights = table(spark, d, "customer").select(F.when(key % 10 == 0, "hang gliders").otherwise("paragliders").alias("source"), key.alias("flight_id"), F.col("c_mktsegment").alias("stratum"))
    r2 = F.col("east_m") * F.col("east_m") + F.col("north_m") * F.col("north_m")
    return catalogs.with_stratum(_points(spark, d), flights, "stratum").groupBy("stratum", "minute").agg(F.count("*").alias("n"), F.round(F.avg(r2), 1).alias("msd"))


@register("b13_geography", query("SELECT CAST(floor(lat * 10) AS BIGINT) AS cell_lat, CAST(floor(lon * 10) AS BIGINT) AS cell_lon, count(DISTINCT (source, flight_id)) AS flights, count(*) AS n, round(avg(east_m * east_m + north_m * north_m), 1) + 0.0 AS msd FROM en GROUP BY 1, 2", VIEW, _enu("v")))
def b13_geography(spark, d):
    """Cells of a tenth of a degree."""
    cell = lambda c: F.floor(F.col(c) * 10).cast("bigint")
    points = resample.with_enu(view(spark, d)).withColumns({"cell_lat": cell("lat"), "cell_lon": cell("lon")})
    r2 = F.col("east_m") * F.col("east_m") + F.col("north_m") * F.col("north_m")
    return points.groupBy("cell_lat", "cell_lon").agg(F.count_distinct("source", "flight_id").alias("flights"), F.count("*").alias("n"), F.round(F.avg(r2), 1).alias("msd"))


_PLACES = """p0 AS (SELECT source, flight_id, 0 AS seconds, arg_min(lat, (t, fix_no)) AS lat, arg_min(lon, (t, fix_no)) AS lon FROM v WHERE t >= 0 GROUP BY source, flight_id),
p1 AS (SELECT source, flight_id, 1800 AS seconds, arg_min(lat, (t, fix_no)) AS lat, arg_min(lon, (t, fix_no)) AS lon FROM v WHERE t >= 1800 GROUP BY source, flight_id),
pl AS (SELECT *, (CAST(floor(lon / 0.005::DOUBLE) AS BIGINT) + 8388608) * 16777216 + CAST(floor(lat / 0.005::DOUBLE) AS BIGINT) + 8388608 AS cell FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1)),
dn AS (SELECT seconds, cell FROM pl GROUP BY ALL HAVING count(*) >= 2),
eg AS (SELECT a.seconds, a.cell AS a, b.cell AS b FROM dn a JOIN dn b ON a.seconds = b.seconds AND abs(a.cell // 16777216 - b.cell // 16777216) <= 1 AND abs(a.cell % 16777216 - b.cell % 16777216) <= 1),
rc AS (SELECT seconds, a, b FROM eg UNION SELECT rc.seconds, rc.a, eg.b FROM rc JOIN eg ON rc.seconds = eg.seconds AND rc.b = eg.a),
lb AS (SELECT seconds, a AS cell, min(b) AS cluster FROM rc GROUP BY seconds, a)"""


@register("b13_clusters", query(f"SELECT seconds, coalesce(cluster, -1) AS cluster, count(*) AS flights, {r('avg(lat)', 'lat')}, {r('avg(lon)', 'lon')} FROM pl LEFT JOIN lb USING (seconds, cell) GROUP BY ALL", VIEW, _PLACES).replace("WITH ", "WITH RECURSIVE ", 1))
def b13_clusters(spark, d):
    """Clusters of take-offs and of the places after 1,800 seconds, over cells of half a hundredth of a degree; -1 is all that is in none."""

    def at(seconds):
        places = clusters.dense_clusters(clusters.places_at(view(spark, d), seconds), "lon", "lat", 0.005, 2)
        return clusters.cluster_table(places).select(F.lit(seconds).alias("seconds"), F.coalesce("cluster", F.lit(-1)).alias("cluster"), "flights", "lat", "lon")

    return at(0).unionByName(at(1800))


@register("b4_propagator", query(f"SELECT minute, bin, n, {r('n / (sum(n) OVER (PARTITION BY minute) * 500.0)', 'density')} FROM (SELECT minute, CAST(floor(north_m / 500 + 0.5) AS BIGINT) AS bin, count(*) AS n FROM pt GROUP BY 1, 2)", *_PT))
def b4(spark, d):
    return observables.propagator(_points(spark, d), "minute", "north_m", 500.0)


@register("b5_return_probability", query(f"SELECT minute, {r('density')} FROM (SELECT minute, bin, n / (sum(n) OVER (PARTITION BY minute) * 500.0) AS density FROM (SELECT minute, floor(east_m / 500 + 0.5) AS bin, count(*) AS n FROM pt GROUP BY 1, 2)) WHERE bin = 0", *_PT))
def b5(spark, d):
    return observables.propagator(_points(spark, d), "minute", "east_m", 500.0).where("bin = 0").select("minute", "density")


@register("b11_scaling", query(f"SELECT {r('regr_slope(ln(msd), ln(minute))', 'alpha')}, {r('regr_slope(ln(msd), ln(minute)) / 2', 'hurst')} FROM (SELECT minute, avg(east_m * east_m + north_m * north_m) AS msd FROM pt GROUP BY minute) WHERE minute > 0 AND msd > 0", *_PT))
def b11(spark, d):
    return observables.scaling_exponent(observables.msd(_points(spark, d), "minute"), "minute", "msd")


@register("b12_isotropy", query(f"SELECT minute, count(*) AS n, {r('avg(east_m * east_m) / nullif(avg(north_m * north_m), 0)', 'ratio')} FROM pt GROUP BY minute", *_PT))
def b12(spark, d):
    return observables.isotropy(_points(spark, d), "minute")


@register("b12_ks", query(f"SELECT minute, CAST(max(ta) AS BIGINT) AS n, {r('max(abs(a / ta - b / tb))', 'ks')} FROM (SELECT minute, sum(a) OVER z AS a, sum(b) OVER z AS b, sum(a) OVER y AS ta, sum(b) OVER y AS tb FROM ug WINDOW z AS (PARTITION BY minute ORDER BY v), y AS (PARTITION BY minute)) GROUP BY minute", *_PT, "uv AS (SELECT minute, round(east_m, 3) + 0.0 AS v, 1 AS a, 0 AS b FROM pt UNION ALL SELECT minute, round(north_m, 3) + 0.0, 0, 1 FROM pt), ug AS (SELECT minute, v, sum(a) AS a, sum(b) AS b FROM uv GROUP BY ALL)"))
def b12_ks(spark, d):
    """East against north at each minute, in whole millimetres."""
    points = _points(spark, d).withColumns({c: F.round(c, 3) + F.lit(0.0) for c in ("east_m", "north_m")})
    return observables.isotropy_ks(points, "minute")


@register("b13_stratum_msd", query("SELECT source, minute, count(*) AS n, round(avg(east_m * east_m + north_m * north_m), 1) + 0.0 AS msd FROM pt GROUP BY ALL", *_PT))
def b13(spark, d):
    r2 = F.col("east_m") * F.col("east_m") + F.col("north_m") * F.col("north_m")
    return _points(spark, d).groupBy("source", "minute").agg(F.count("*").alias("n"), F.round(F.avg(r2), 1).alias("msd"))


_PH = "p1 AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fix_no, floor(epoch_us(ts) / 1e9) AS t FROM events), p2 AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY fix_no) THEN 0 ELSE 1 END AS nw FROM p1), p3 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY fix_no) AS run FROM p2), pr AS (SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS phase, CAST(min(t) AS BIGINT) AS t0, CAST(max(t) AS BIGINT) AS t1, count(*) AS n FROM p3 GROUP BY user_id, run)"


def _phases(spark, d):
    e = table(spark, d, "events")
    rows = e.withColumn("fix_no", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e9)))
    return observables.phase_runs(rows, "event_type", ["user_id"])


@register("b15_phase_runs", query("SELECT *, run = 1 OR run = max(run) OVER (PARTITION BY user_id) AS censored FROM pr", _PH))
def b15(spark, d):
    return _phases(spark, d)


@register("b16_transition", query(f"""SELECT phase AS "from", nx AS "to", count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY phase)', 'share')} FROM (SELECT phase, lead(phase) OVER (PARTITION BY user_id ORDER BY run) AS nx FROM pr) WHERE nx IS NOT NULL GROUP BY phase, nx""", _PH))
def b16(spark, d):
    return observables.transitions(_phases(spark, d), ["user_id"])


_KIN = "k1 AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY flight_id ORDER BY fix_no) THEN 0 ELSE 1 END AS nw FROM en), k2 AS (SELECT *, sum(nw) OVER (PARTITION BY flight_id ORDER BY fix_no) AS run FROM k1), k3 AS (SELECT flight_id, run, any_value(event_type) AS phase, max(t) - min(t) AS dt, arg_max(east_m, fix_no) - arg_min(east_m, fix_no) AS d0, arg_max(north_m, fix_no) - arg_min(north_m, fix_no) AS d1, arg_max(gnss_alt, fix_no) - arg_min(gnss_alt, fix_no) AS d2 FROM k2 GROUP BY flight_id, run), k4 AS (SELECT *, max(run) OVER (PARTITION BY flight_id) AS last FROM k3)"


@register("b15_kinematics", query(f"SELECT phase, count(*) AS n, {r('avg(dt)', 'duration_s')}, {_R3('avg(sqrt(d0 * d0 + d1 * d1) / dt)', 'v_xy_mps')}, {r('avg(d2 / dt)', 'v_z_mps')} FROM k4 WHERE run > 1 AND run < last AND dt > 0 GROUP BY phase", VIEW, _enu("v"), _KIN))
def b15_kinematics(spark, d):
    rows = _kinds(spark, d, resample.with_enu(view(spark, d)))
    found = observables.phase_kinematics(rows, "kind", alt="gnss_alt")
    return found.withColumn("v_xy_mps", F.round("v_xy_mps", 3))


@register("b16_step_wait", query(f"SELECT count(*) AS n, {r('corr(w, nx)', 'corr')} FROM (SELECT phase, CAST(t1 - t0 AS DOUBLE) AS w, CAST(lead(t1 - t0) OVER f AS DOUBLE) AS nx, run = 1 OR run = max(run) OVER (PARTITION BY user_id) AS c, lead(run) OVER f = max(run) OVER (PARTITION BY user_id) AS cn FROM pr WINDOW f AS (PARTITION BY user_id ORDER BY run)) WHERE phase = 'click' AND NOT c AND NOT cn", _PH))
def b16_step_wait(spark, d):
    return observables.step_wait_correlation(_phases(spark, d), "click", ["user_id"])


_LAWS = """dr AS (SELECT phase, run = 1 OR run = max(run) OVER (PARTITION BY user_id) AS c, CAST(t1 - t0 AS DOUBLE) AS x FROM pr),
sh AS (SELECT phase, avg(CASE WHEN c THEN 1.0::DOUBLE ELSE 0.0 END) AS censored_share, count(CASE WHEN NOT c AND x > 0 THEN 1 END) AS n FROM dr GROUP BY phase),
ct AS (SELECT phase, x, count(*) AS n FROM dr WHERE NOT c AND x > 0 GROUP BY ALL),
rk AS (SELECT *, sum(n) OVER (PARTITION BY phase ORDER BY x) AS upto, row_number() OVER (PARTITION BY phase ORDER BY x) AS i, count(*) OVER (PARTITION BY phase) AS m FROM ct),
tr AS (SELECT a.phase, a.x AS x_min, any_value(a.upto - a.n) AS below, CAST(sum(b.n) AS BIGINT) AS n_tail, 1 + sum(b.n) / sum(b.n * ln(b.x / a.x)) AS alpha, sum(b.n) / sum(b.n * (b.x - a.x)) AS rate FROM rk a JOIN rk b ON a.phase = b.phase AND b.x >= a.x WHERE (a.i - 1) % CAST(ceil(a.m / 64.0) AS BIGINT) = 0 AND a.i < a.m GROUP BY a.phase, a.x HAVING sum(b.n) >= 10),
mt AS (SELECT tr.*, b.n, abs((b.upto - below) / n_tail - (1 - pow(b.x / x_min, 1 - alpha))) AS g1, abs((b.upto - below - b.n) / n_tail - (1 - pow(b.x / x_min, 1 - alpha))) AS g2, ln((alpha - 1) / x_min) - alpha * ln(b.x / x_min) - ln(rate) + rate * (b.x - x_min) AS d FROM tr JOIN rk b ON tr.phase = b.phase AND b.x >= x_min),
ft AS (SELECT phase, x_min, n_tail, alpha, rate, max(greatest(g1, g2)) AS ks, sum(n * d) AS ratio, sum(n * d * d) AS squares FROM mt GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY round(ks, 12), x_min) AS k FROM ft)"""


@register("b15_duration_laws", query(f"SELECT sh.phase, n, {r('censored_share')}, {r('x_min')}, n_tail, {r('alpha')}, {r('ks')}, {r('rate')}, {r('ratio')}, {r('CASE WHEN squares - ratio * ratio / n_tail > 0 THEN ratio / sqrt(squares - ratio * ratio / n_tail) END', 'z')} FROM sh LEFT JOIN (SELECT * FROM bs WHERE k = 1) b USING (phase)", _PH, _LAWS))
def b15_laws(spark, d):
    return durations.duration_laws(_phases(spark, d).withColumn("duration_s", (F.col("t1") - F.col("t0")).cast("double")))


def _kinds(spark, d, rows):
    """``rows`` with the kind of their event."""
    events = table(spark, d, "events")
    kinds = events.select(F.col("user_id").alias("flight_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("fix_no"), F.col("event_type").alias("kind"))
    return rows.join(kinds, ["flight_id", "fix_no"])


_KRUNS = "kr AS (SELECT source, flight_id, run, any_value(event_type) AS phase, min(t) AS t0, max(t) AS t1, run = 1 OR run = max(run) OVER (PARTITION BY source, flight_id) AS c FROM (SELECT *, sum(nw) OVER (PARTITION BY source, flight_id ORDER BY fix_no) AS run FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY source, flight_id ORDER BY fix_no) THEN 0 ELSE 1 END AS nw FROM v)) GROUP BY source, flight_id, run)"
_SUSPECT = """su AS (SELECT source, flight_id, t0, t1 FROM (SELECT source, flight_id, rs, min(tb) AS t0, max(t) AS t1, max(baro_alt) - min(baro_alt) AS ar FROM q3 WHERE slow GROUP BY ALL) WHERE ar <= 3000),
s1 AS (SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY source, flight_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM su),
s2 AS (SELECT *, sum(fresh) OVER (PARTITION BY source, flight_id ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS island FROM s1),
s3 AS (SELECT source, flight_id, min(t0) AS t0, max(t1) AS t1 FROM s2 GROUP BY source, flight_id, island),
mk AS (SELECT kr.phase, kr.t1 - kr.t0 AS d, coalesce(sum(CASE WHEN s3.t0 IS NOT NULL THEN least(s3.t1, kr.t1) - greatest(s3.t0, kr.t0) END), 0.0) AS cov, count(s3.t0) > 0 AS touched FROM kr LEFT JOIN s3 ON kr.source = s3.source AND kr.flight_id = s3.flight_id AND s3.t0 < kr.t1 AND kr.t0 < s3.t1 WHERE NOT c GROUP BY kr.source, kr.flight_id, kr.run, kr.phase, kr.t0, kr.t1),
vr AS (SELECT phase, 'all' AS variant, d AS s FROM mk UNION ALL SELECT phase, 'without', CASE WHEN NOT touched THEN d END FROM mk UNION ALL SELECT phase, 'subtracted', CASE WHEN NOT touched OR d - cov > 0 THEN d - cov END FROM mk)"""


@register("j12_sensitivity", query(f"SELECT phase, variant, count(s) AS n, {r('avg(s)', 'mean_s')}, {r('coalesce(sum(s), 0.0)', 'total_s')} FROM vr GROUP BY phase, variant", VIEW, STEPS, _RUNS, _KRUNS, _SUSPECT))
def j12_sensitivity(spark, d):
    runs = observables.phase_runs(_kinds(spark, d, view(spark, d)), "kind")
    return durations.sensitivity(runs, clean.interior_ground(view(spark, d), LIMITS).drop("kind"))


_GEO = """ge AS (SELECT source, flight_id, fix_no, t, gnss_alt, event_type, round(east_m, 3) + 0.0 AS x, round(north_m, 3) + 0.0 AS y FROM en),
g1 AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY source, flight_id ORDER BY fix_no) THEN 0 ELSE 1 END AS nw FROM ge),
g2 AS (SELECT *, sum(nw) OVER (PARTITION BY source, flight_id ORDER BY fix_no) AS run FROM g1),
g4 AS (SELECT *, x - lag(x) OVER z AS sx, y - lag(y) OVER z AS sy, x - avg(x) OVER (PARTITION BY source, flight_id, run) AS u, y - avg(y) OVER (PARTITION BY source, flight_id, run) AS w FROM g2 WINDOW z AS (PARTITION BY source, flight_id, run ORDER BY fix_no)),
g5 AS (SELECT *, lag(sx) OVER z AS px, lag(sy) OVER z AS py, u * u + w * w AS q FROM g4 WINDOW z AS (PARTITION BY source, flight_id, run ORDER BY fix_no)),
g6 AS (SELECT source, flight_id, run, any_value(event_type) AS phase, count(*) AS n, max(t) - min(t) AS duration_s, arg_max(gnss_alt, fix_no) - arg_min(gnss_alt, fix_no) AS gain_m, coalesce(sum(sqrt(sx * sx + sy * sy)), 0.0) AS path_m,
  sqrt(pow(arg_max(x, fix_no) - arg_min(x, fix_no), 2) + pow(arg_max(y, fix_no) - arg_min(y, fix_no), 2)) AS net_m, coalesce(sum(CASE WHEN px * px + py * py > 0 AND sx * sx + sy * sy > 0 THEN CASE WHEN px * sy - py * sx = 0 AND px * sx + py * sy < 0 THEN pi() ELSE atan2(px * sy - py * sx, px * sx + py * sy) END END), 0.0) AS turned,
  sum(u * u) AS suu, sum(w * w) AS sww, sum(u * w) AS suw, sum(u * q) AS suq, sum(w * q) AS swq, sum(q) AS sq FROM g5 GROUP BY source, flight_id, run),
g7 AS (SELECT *, suu * sww - suw * suw AS det, run = 1 OR run = max(run) OVER (PARTITION BY source, flight_id) AS censored FROM g6),
g8 AS (SELECT *, CASE WHEN n >= 3 AND det > 1e-9 * suu * sww THEN sqrt(pow((suq * sww - swq * suw) / (2 * det), 2) + pow((swq * suu - suq * suw) / (2 * det), 2) + sq / n) END AS radius FROM g7)"""


@register("b15_geometry", query(f"SELECT source, flight_id, CAST(run AS BIGINT) AS run, phase, censored, n, duration_s, {r('gain_m')}, {r('CASE WHEN duration_s > 0 THEN gain_m / duration_s END', 'climb_mps')}, {_R3('path_m')}, {_R3('net_m')}, {_R3('CASE WHEN net_m > 0 THEN path_m / net_m END', 'tortuosity')}, {_R3('turned', 'turned_rad')}, {_R3('CASE WHEN duration_s > 0 AND abs(turned) >= 2 * pi() THEN 2 * pi() * duration_s / abs(turned) END', 'period_s')}, {_R3('log10(radius)', 'log_radius')} FROM g8", VIEW, _enu("v"), _GEO))
def b15_geometry(spark, d):
    """Positions in whole millimetres; radii, which are huge for nearly straight runs, as logarithms."""
    found = _run_rows(spark, d)
    three = {c: F.round(c, 3) for c in ("path_m", "net_m", "tortuosity", "turned_rad", "period_s")}
    return found.withColumns(three | {"log_radius": F.round(F.log10("radius_m"), 3)}).drop("radius_m", "circle_rms_m")


def _run_rows(spark, d):
    rows = resample.with_enu(view(spark, d)).withColumns({c: F.round(c, 3) + F.lit(0.0) for c in ("east_m", "north_m")})
    return geometry.run_geometry(_kinds(spark, d, rows), "kind", alt="gnss_alt")


_PAIRS_OF = """gw AS (SELECT * FROM (SELECT *, sum(CASE WHEN phase = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY source, flight_id ORDER BY run) AS part FROM g7) WHERE part > 0),
gp AS (SELECT source, flight_id, part, max(CASE WHEN phase = 'click' THEN net_m END) AS length_m, max(CASE WHEN phase = 'click' THEN duration_s END) AS glide_s, sum(CASE WHEN phase <> 'click' THEN duration_s END) AS wait_s, bool_or(censored) AS cut FROM gw GROUP BY ALL)"""


@register("b16_glide_wait", query(f"SELECT count(*) AS n, {r('corr(length_m, wait_s)', 'length_wait')}, {r('corr(length_m, glide_s)', 'length_time')}, {_R3('avg(v)', 'speed_mps')}, {_R3('stddev_pop(v)', 'speed_spread')} FROM (SELECT *, CASE WHEN glide_s > 0 THEN length_m / glide_s END AS v FROM gp WHERE NOT cut AND wait_s IS NOT NULL)", VIEW, _enu("v"), _GEO, _PAIRS_OF))
def b16_glide_wait(spark, d):
    found = geometry.coupling(geometry.glide_wait_pairs(_run_rows(spark, d), "click"))
    return found.withColumns({c: F.round(c, 3) for c in ("speed_mps", "speed_spread")})


@register("b15_anatomy", query(f"SELECT source, flight_id, phase, n, {r('seconds')}, {_R3('metres')}, {r('seconds / nullif(sum(seconds) OVER z, 0)', 'time_share')}, {r('metres / nullif(sum(metres) OVER z, 0)', 'way_share')} FROM (SELECT source, flight_id, phase, count(*) AS n, sum(duration_s) AS seconds, sum(path_m) AS metres FROM g7 GROUP BY ALL) WINDOW z AS (PARTITION BY source, flight_id)", VIEW, _enu("v"), _GEO))
def b15_anatomy(spark, d):
    return geometry.anatomy(_run_rows(spark, d)).withColumn("metres", F.round("metres", 3))


_HS = [round(0.1 * i, 1) for i in range(1, 16)]
_COLLAPSE = f"""cc AS (SELECT CAST(minute AS DOUBLE) AS t, floor(north_m / 100 + 0.5) AS i, count(*) AS n FROM pt WHERE minute > 0 GROUP BY ALL),
c1 AS (SELECT *, i * 100.0::DOUBLE / pow(t, h) AS u, n / sum(n) OVER (PARTITION BY h, t) AS share FROM cc, (SELECT unnest({_HS}::DOUBLE[]) AS h)),
c2 AS (SELECT h, sqrt(sum(share * u * u) / count(DISTINCT t)) AS rms, count(DISTINCT t) AS times FROM c1 GROUP BY h),
c3 AS (SELECT h, times, t, floor(u / rms / 0.25 + 0.5) AS bin, sum(share) AS p FROM c1 JOIN c2 USING (h) WHERE abs(u / rms) < 3 GROUP BY ALL),
c4 AS (SELECT h, times, bin, sum(p) AS s1, sum(p * p) AS s2 FROM c3 GROUP BY ALL),
c5 AS (SELECT h, times, sum(s2 / times - pow(s1 / times, 2)) / sum(pow(s1 / times, 2)) AS spread FROM c4 GROUP BY ALL)"""


@register("b4_collapse", query(f"SELECT h, times, {r('spread')}, row_number() OVER (ORDER BY round(spread, 12), h) = 1 AS best FROM c5", *_PT, _COLLAPSE))
def b4_collapse(spark, d):
    return collapse(_points(spark, d), "minute", "north_m", 100.0, _HS)


def copied(spark, d):
    """The view with some of its flights uploaded again under other numbers: shifted by twenty metres, without every fifth fix, or as they are."""
    v = view(spark, d)
    way = F.col("flight_id") % 25
    again = v.where(way.isin(0, 7, 13)).where((way != 7) | (F.col("fix_no") % 5 != 2))
    again = again.withColumn("lat", F.col("lat") + F.when(way == 0, 1.8e-4).otherwise(0.0)).withColumn("flight_id", F.col("flight_id") + 1_000_000)
    return v.unionByName(again)


@register("b19_near_tracks")
def b19_near_tracks(spark, d):
    """Pairs of classes of near tracks, and each class's size."""
    pairs, members = near_tracks(copied(spark, d), metres=150.0, step_s=10.0)
    sizes = members.select("class", "size").distinct()
    both = pairs.join(sizes.select(F.col("class").alias("class_a"), F.col("size").alias("size_a")), "class_a").join(sizes.select(F.col("class").alias("class_b"), F.col("size").alias("size_b")), "class_b")
    return both.select(F.col("class_a.source").alias("source_a"), F.col("class_a.flight_id").alias("flight_a"), "size_a", F.col("class_b.source").alias("source_b"), F.col("class_b.flight_id").alias("flight_b"), "size_b", F.round("frechet_m", 1).alias("frechet_m"))


@register("j12_suspect_overlap", query("SELECT a.source, a.flight_id, a.t0, a.t1, b.t0 AS s0, b.t1 AS s1 FROM (SELECT source, flight_id, min(CASE WHEN mv AND t1 - t0 >= 60 THEN t0 END) AS t0, max(CASE WHEN mv AND t1 - t0 >= 60 THEN t1 END) AS t1 FROM (SELECT source, flight_id, rm, bool_and(moving) AS mv, min(tb) AS t0, max(t) AS t1 FROM q3 GROUP BY ALL) GROUP BY source, flight_id) a JOIN (SELECT source, flight_id, rs, min(tb) AS t0, max(t) AS t1, max(baro_alt) - min(baro_alt) AS ar FROM q3 WHERE slow GROUP BY ALL) b ON a.source = b.source AND a.flight_id = b.flight_id AND a.t0 < b.t1 AND b.t0 < a.t1 WHERE b.ar <= 3000", VIEW, STEPS, _RUNS))
def j12(spark, d):
    airborne = clean.trim_window(view(spark, d), LIMITS).where("reason IS NULL").select("source", "flight_id", F.col("t_on").alias("t0"), F.col("t_off").alias("t1"))
    return clean.ground_overlap(airborne, clean.interior_ground(view(spark, d), LIMITS).drop("kind"))


@register("b14_phases")
def b14(spark, d):
    rows = observables.phase_features(resample.with_enu(view(spark, d)))
    move = np.array([[0.9, 0.1], [0.1, 0.9]])
    emit = np.array([[0.6, 0.2, 0.15, 0.05], [0.05, 0.15, 0.2, 0.6]])
    return observables.segment_phases(rows, np.array([0.5, 0.5]), move, emit).select("source", "flight_id", "fix_no", "symbol", "phase")


@register("t15_witness", query(f"SELECT source, flight_id, CAST(run AS BIGINT) AS run, n, {r('span_s')}, span_s >= 60 AS witness FROM (SELECT source, flight_id, run, count(*) AS n, max(t) - min(t) AS span_s FROM (SELECT *, sum(nw) OVER (PARTITION BY source, flight_id ORDER BY fix_no) AS run FROM (SELECT *, CASE WHEN lat = lag(lat) OVER f AND lon = lag(lon) OVER f THEN 0 ELSE 1 END AS nw FROM hd WINDOW f AS (PARTITION BY source, flight_id ORDER BY fix_no))) GROUP BY source, flight_id, run HAVING count(*) > 1)", VIEW, MERGED, _HELD))
def t15(spark, d):
    runs = clean.identical_runs(_held(spark, d))
    return runs.select("source", "flight_id", "run", "n", "span_s", (F.col("span_s") >= LIMITS.fix_level.frozen_tau_s).alias("witness"))


def _phase_rows(spark, d):
    fixes = dealt(clean.merge_duplicates(sound_view(spark, d)).drop("n_merged"), "source", "flight_id")
    placed = resample.with_segments(resample.with_enu(clean.altitude_source(fixes, SOUND)), SOUND)
    return written(phases.features(resample.native_grid(placed), half_s=60.0, turn_rad_s=0.005))


@register("b14_training")
def b14_training(spark, d):
    """The likelihoods of each iteration, and the probabilities of the trained model."""
    model, history = phases.train(written(phases.sequences(_phase_rows(spark, d))), iterations=8)
    rows = [("likelihood", "training" if part == 1 else "held out", str(h[0]), h[part]) for h in history for part in (1, 2)]
    return spark.createDataFrame(rows + phases.as_table(model), "part string, from string, to string, value double")


@register("b14_trained_phases")
def b14_trained(spark, d):
    rows = _phase_rows(spark, d)
    model, _ = phases.train(written(phases.sequences(rows)), iterations=8)
    return phases.with_phases(rows, model).select(*resample.SEGMENT, "k", "symbol", "phase")


def _cleaned(spark, d):
    return clean_tracks(sound_view(spark, d), SOUND)


@register("cleaning_pipeline")
def pipeline_flights(spark, d):
    return _cleaned(spark, d).flights


@register("cleaning_segments")
def pipeline_segments(spark, d):
    return _cleaned(spark, d).segments


@register("cleaning_fixes")
def pipeline_fixes(spark, d):
    """The smoothed fixes, to the millimetre and the millimetre a second."""
    fixes = _cleaned(spark, d).fixes
    return fixes.withColumns({c: F.round(c, 3) for c, kind in fixes.dtypes if kind == "double"})


@register("k9_store")
def k9(spark, d):
    """The flights of the stored archive with what their stored fixes and segments add up to."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store.write_store(spark, store.stored_tables(_cleaned(spark, d), SOUND), root, buckets=8, parts=4)
    kept = store.open_store(spark, root)
    fixes = kept.read("fixes").groupBy(*store.KEYS).agg(F.count("*").alias("n_fix"), F.max("t").alias("t_last"))
    segments = kept.read("segments").groupBy(*store.KEYS).agg(F.count("*").alias("n_segments"), F.sum(F.col("passes").cast("bigint")).alias("n_passing"))
    return kept.read("flights_meta").join(fixes, store.KEYS, "left").join(segments, store.KEYS, "left")
