"""SQL building blocks for the oracle: the track view, its steps and per-flight statistics as common table expressions."""

from __future__ import annotations

R = 6371008.8

VIEW = """
e AS (SELECT user_id, event_id, event_type, value, ts, floor(epoch_us(ts) / 1e9) AS s FROM events),
v AS (
  SELECT CASE WHEN user_id % 10 = 0 THEN 'hang gliders' ELSE 'paragliders' END AS source, user_id AS flight_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fix_no, event_type, event_id,
    CAST(s - min(s) OVER (PARTITION BY user_id) AS DOUBLE) AS t,
    45 + 1e-4::DOUBLE * (s - min(s) OVER (PARTITION BY user_id)) + 1e-5::DOUBLE * value AS lat,
    5 + 1e-4::DOUBLE * (s - min(s) OVER (PARTITION BY user_id)) * ((user_id % 7) - 3) / 3 AS lon,
    event_type <> 'error' AS valid,
    CASE WHEN user_id % 3 = 0 THEN 0.0::DOUBLE ELSE floor(value * 10) END AS baro_alt,
    CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE floor(value * 10) + 50 END AS gnss_alt
  FROM e)
""".strip()


def distance(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(CASE WHEN {a} IS NOT NULL THEN 2 * {R} * asin(least(1.0::DOUBLE, sqrt({a}))) END)"


STEPS = f"""
w AS (SELECT *, t - lag(t) OVER f AS dt, lag(lat) OVER f AS plat, lag(lon) OVER f AS plon, baro_alt - lag(baro_alt) OVER f AS dz,
    first_value(lat) OVER f AS flat, first_value(lon) OVER f AS flon
  FROM v WINDOW f AS (PARTITION BY source, flight_id ORDER BY fix_no)),
s AS (SELECT *, {distance("plat", "plon", "lat", "lon")} AS step_m, {distance("flat", "flon", "lat", "lon")} AS from_start FROM w)
""".strip()

STATS = """
a AS (SELECT source, flight_id, max(t) - min(t) AS duration_s, count(*) AS n_fix, coalesce(sum(step_m), 0.0) / 1000 AS path_km, max(from_start) / 1000 AS extent_km,
    quantile_cont(dt, 0.5) AS dt_s, max(dt) AS max_gap_s, avg(CASE WHEN baro_alt <> 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS baro_present_frac,
    max(CASE WHEN dt > 0 THEN step_m / dt END) AS max_vxy_mps, max(CASE WHEN dt > 0 THEN abs(dz) / dt END) AS max_vz_mps,
    min(baro_alt) AS baro_alt_min_m, max(baro_alt) AS baro_alt_max_m
  FROM s GROUP BY source, flight_id),
st AS (SELECT source, flight_id, duration_s, n_fix, path_km, extent_km, dt_s, baro_present_frac, max_vxy_mps, max_vz_mps, baro_alt_min_m, baro_alt_max_m,
    CASE WHEN dt_s > 0 THEN max_gap_s / dt_s END AS max_gap_ratio, CASE WHEN dt_s > 0 THEN greatest(0.0, 1 - n_fix / (duration_s / dt_s + 1)) END AS missing_fraction
  FROM a WHERE n_fix >= 2)
""".strip()

MERGED = """
d AS (SELECT source, flight_id, t, min(fix_no) AS fix_no, avg(lat) AS lat, avg(lon) AS lon, bool_and(valid) AS valid,
    coalesce(avg(CASE WHEN baro_alt <> 0 THEN baro_alt END), 0.0) AS baro_alt, coalesce(avg(CASE WHEN gnss_alt <> 0 THEN gnss_alt END), 0.0) AS gnss_alt, count(*) AS n_merged
  FROM v GROUP BY source, flight_id, t)
""".strip()


def r(expression: str, name: str | None = None) -> str:
    """Rounded to six places, without a negative zero."""
    return f"round({expression}, 6) + 0.0 AS {name or expression}"


def query(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
