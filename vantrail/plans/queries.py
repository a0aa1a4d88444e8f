"""The query registry: every operator over the driver's tables, with its SQL. Computed doubles are rounded to six places on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantrail.config import FlightLevel, FixLevel, Sampling, Thresholds, Trimming
from vantrail.functions import naming, records, stats
from vantrail.operators import catalog, census, clean, observables
from vantrail.operators.ranks import exact_quantiles
from vantrail.plans.sql import STATS, STEPS, VIEW, query, r
from vantrail.session import shared_dir
from vantrail.sources import catalog as sources
from vantrail.sources import tracks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Overrides for the view, whose fixes are about 27 s apart and whose speeds jump with the values.
LIMITS = Thresholds(
    fix_level=FixLevel(max_horizontal_speed_mps={"paragliders": 45.0, "hang gliders": 55.0}, hampel_window_s=200.0, min_altitude_m=100.0, max_altitude_m=4000.0, max_vertical_speed_mps=40.0),
    flight_level=FlightLevel(min_path_km=30.0, min_alt_range_m=75.0),
    trimming=Trimming(takeoff_speed_mps=12.0, sustained_s=60.0, interior_ground_s=100.0, ground_flatness_m=3000.0),
    sampling=Sampling(max_gap_factor=4.0, max_gap_seconds=20.0, gap_floor_ratio=3.0, max_missing_fraction=0.4, min_segment_duration_s=90.0),
)


#: For the view with sound altitudes: published thresholds but for windows and bounds that follow from its interval of about 27 s.
SOUND = Thresholds(
    fix_level=FixLevel(hampel_window_s=200.0),
    flight_level=FlightLevel(min_duration_s=1800.0),
    trimming=Trimming(interior_ground_s=300.0),
    sampling=Sampling(max_gap_factor=4.0, max_gap_seconds=20.0, gap_floor_ratio=3.0, max_missing_fraction=0.4, min_segment_duration_s=90.0),
)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema])


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.track_view(table(spark, sf_dir, "events"))


def sound_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track view with smooth climbs and the defects that cleaning looks for, each on the flights of a residue: a late start on the
    ground, a stop that jitters, a frozen receiver, a backward clock, single spikes and bursts, and altitudes that jump or leave the band."""
    v, f, n, t = view(spark, sf_dir), F.col("flight_id"), F.col("fix_no"), F.col("t")
    held = lambda since, long: F.least(F.greatest(t - since, F.lit(0.0)), F.lit(float(long)))  # noqa: E731  how long of it is over
    late, stop, frozen = f % 7 == 1, f % 11 == 5, f % 11 == 3
    still = F.when(late, held(0, 300)).otherwise(0.0) + F.when(stop, held(1000, 450)).otherwise(0.0) + F.when(frozen, held(700, 160)).otherwise(0.0)
    flown = t - still
    jitter = F.when((late & (t < 300)) | (stop & t.between(1000, 1450)), 3e-4 * (n % 2)).otherwise(0.0)
    off = F.when((f % 5 == 1) & (n == 12), 0.05).when((f % 5 == 3) & n.between(20, 21), 0.05).otherwise(0.0)
    east = F.sin(flown / 90) * 0.004  # it circles on its way
    alt = F.round(1500 + 400 * F.sin(flown / 300), 1)
    jump = F.when(n % 53 == 7, 800.0).when(n % 71 == 9, 20_000.0).otherwise(0.0)
    no_baro = f % 3 == 0
    return v.select(
        "source",
        "flight_id",
        "fix_no",
        F.when((f % 5 == 2) & (n == 15), F.greatest(t - 400, F.lit(0.0))).otherwise(t).alias("t"),
        (45 + F.lit(1e-4) * flown + jitter + off).alias("lat"),
        (5 + F.lit(1e-4) * flown * ((f % 7) - 3) / 3 + east).alias("lon"),
        "valid",
        F.when(no_baro, F.lit(0.0)).otherwise(alt + jump).alias("baro_alt"),
        (alt + 50 + jump).alias("gnss_alt"),
    )


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.merge_duplicates(view(spark, sf_dir)).drop("n_merged")


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.track_stats(view(spark, sf_dir))


_STAT = ["duration_s", "path_km", "extent_km", "dt_s", "baro_present_frac", "max_vxy_mps", "max_vz_mps", "baro_alt_min_m", "baro_alt_max_m", "max_gap_ratio", "missing_fraction"]


# ---------------------------------------------------------------- per-flight statistics
@register("a6_track_stats", query(f"SELECT source, flight_id, n_fix, {', '.join(map(r, _STAT))} FROM st", VIEW, STEPS, STATS))
def a6(spark, d):
    return statistics(spark, d)


@register("t1_track_view", query(f"SELECT source, flight_id, fix_no, {r('t')}, {r('lat * 10', 'lat_x10')}, {r('lon', 'lon')}, valid, {r('baro_alt')}, {r('gnss_alt')} FROM v", VIEW))
def t1(spark, d):
    return view(spark, d).withColumn("lat", F.col("lat") * 10).withColumnRenamed("lat", "lat_x10")  # its seventh place counts


@register("t4_step_distance", query(f"SELECT source, flight_id, fix_no, {r('dt')}, {r('step_m')}, {r('dz')} FROM s", VIEW, STEPS))
def t4(spark, d):
    return tracks.with_steps(view(spark, d)).select("source", "flight_id", "fix_no", "dt", "step_m", "dz")


@register("t5_fix_quantities", query(f"""SELECT source, flight_id, fix_no, quantity, {r('value')} FROM (
  SELECT source, flight_id, fix_no, 'v_xy' AS quantity, CASE WHEN dt > 0 THEN step_m / dt END AS value FROM q
  UNION ALL SELECT source, flight_id, fix_no, 'v_z', CASE WHEN dt > 0 AND b THEN abs(dz) / dt END FROM q
  UNION ALL SELECT source, flight_id, fix_no, 'alt', CASE WHEN b THEN baro_alt END FROM q) WHERE value IS NOT NULL""", VIEW, STEPS, "q AS (SELECT *, avg(CASE WHEN baro_alt <> 0 THEN 1.0::DOUBLE ELSE 0.0 END) OVER (PARTITION BY source, flight_id) >= 0.5 AS b FROM s)"))
def t5(spark, d):
    return census.fix_quantities(view(spark, d))


_QUANT = (VIEW, STEPS, "q AS (SELECT *, avg(CASE WHEN baro_alt <> 0 THEN 1.0::DOUBLE ELSE 0.0 END) OVER (PARTITION BY source, flight_id) >= 0.5 AS b FROM s)", """u AS (
  SELECT source, 'v_xy' AS quantity, CASE WHEN dt > 0 THEN step_m / dt END AS value FROM q
  UNION ALL SELECT source, 'v_z', CASE WHEN dt > 0 AND b THEN abs(dz) / dt END FROM q
  UNION ALL SELECT source, 'alt', CASE WHEN b THEN baro_alt END FROM q)""")


@register("t6_pooled", query(f"SELECT source, quantity, count(value) AS n, {r('avg(value)', 'mean')}, {r('quantile_cont(value, 0.5)', 'median')} FROM u WHERE value IS NOT NULL GROUP BY ALL", *_QUANT))
def t6(spark, d):
    q = census.fix_quantities(view(spark, d))
    means = q.groupBy("source", "quantity").agg(F.avg("value").alias("mean"))
    middle = exact_quantiles(q, "value", [0.5], ["source", "quantity"]).select("source", "quantity", "n", F.col("xs")[0].alias("median"))
    return means.join(middle, ["source", "quantity"])


@register("a9_baro_fraction", query(f"SELECT source, flight_id, {r('coalesce(avg(CASE WHEN baro_alt <> 0 THEN 1.0::DOUBLE ELSE 0.0 END), 0.0)', 'frac')} FROM v GROUP BY ALL", VIEW))
def a9(spark, d):
    return view(spark, d).groupBy("source", "flight_id").agg(F.coalesce(F.avg((F.col("baro_alt") != 0).cast("double")), F.lit(0.0)).alias("frac"))


@register("a10_median_period", query(f"SELECT source, flight_id, {r('quantile_cont(dt, 0.5)', 'dt_s')} FROM s GROUP BY ALL", VIEW, STEPS))
def a10(spark, d):
    return tracks.with_steps(view(spark, d)).groupBy("source", "flight_id").agg(F.median("dt").alias("dt_s"))


@register("a11_baro_absent_scan", query("SELECT source, CAST(sum(CASE WHEN f < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_absent, count(*) AS n FROM (SELECT source, flight_id, count(*) AS c, avg(CASE WHEN baro_alt <> 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS f FROM v GROUP BY ALL) WHERE c >= 3 GROUP BY source", VIEW))
def a11(spark, d):
    return census.baro_absent(view(spark, d))


@register("a12_baro_absent_census", query("SELECT source, CAST(sum(CASE WHEN baro_present_frac < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_absent, count(*) AS n FROM st GROUP BY source", VIEW, STEPS, STATS))
def a12(spark, d):
    return census.baro_absent_census(statistics(spark, d))


@register("a13_modal_dt", query("SELECT r AS modal_dt_s FROM (SELECT round_even(dt_s, 0) + 0.0 AS r, count(*) AS n FROM st WHERE dt_s >= 0.5 GROUP BY 1) ORDER BY n DESC, r LIMIT 1", VIEW, STEPS, STATS))
def a13(spark, d):
    return census.modal_interval(statistics(spark, d))


@register("a14_representative", query("SELECT source, flight_id, n_fix FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_fix DESC, flight_id) AS k FROM st) WHERE k = 1", VIEW, STEPS, STATS))
def a14(spark, d):
    return census.representative(statistics(spark, d))


_P = lambda mask: f"coalesce(100 * avg(CASE WHEN {mask} THEN 1.0::DOUBLE WHEN NOT ({mask}) THEN 0.0 END), 0.0)"
_PO = lambda mask, of: f"coalesce(100 * avg(CASE WHEN {of} THEN CASE WHEN {mask} THEN 1.0::DOUBLE ELSE 0.0 END END), 0.0)"
_SOUND_DT, _SOUND_RATIO = "isfinite(dt_s) AND dt_s > 0", "isfinite(max_gap_ratio) AND max_gap_ratio > 0"


def mixed_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A census with many kinds of flights: an order is a flight, whose price and lines give intervals of a whole, half and tenth of a second
    and none, gaps of whole and broken ratios, overlong and short flights, and barometers that are there, absent and both."""
    o = F.col("o_orderkey")
    dt = F.get(F.array(*[F.lit(x) for x in (1.0, 1.0, 2.0, 2.5, 5.0, 10.0, 0.0, 4.0, 1.5)]), (o % 9).cast("int"))
    ratio = F.get(F.array(*[F.lit(x) for x in (1.0, 2.5, 3.0, 8.0, 12.0, 40.0, 0.0)]), (o % 7).cast("int"))
    frac = F.get(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.9, 1.0)]), (o % 5).cast("int"))
    price = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(F.when(o % 4 == 0, "hang gliders").otherwise("paragliders").alias("source"), o.alias("flight_id"), (price / 5).alias("duration_s"), (10 + o % 20).alias("n_fix"), (price / 2000).alias("path_km"), (price / 4000 + o % 13).alias("extent_km"), dt.alias("dt_s"), F.when(dt > 0, ratio).alias("max_gap_ratio"), frac.alias("baro_present_frac"))
    return rows


_MIXED = """mx AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'hang gliders' ELSE 'paragliders' END AS source, o_orderkey AS flight_id, o_totalprice / 5 AS duration_s, 10 + o_orderkey % 20 AS n_fix, o_totalprice / 2000 AS path_km, o_totalprice / 4000 + o_orderkey % 13 AS extent_km,
  ([1.0, 1.0, 2.0, 2.5, 5.0, 10.0, 0.0, 4.0, 1.5]::DOUBLE[])[o_orderkey % 9 + 1] AS dt_s, CASE WHEN o_orderkey % 9 <> 6 THEN ([1.0, 2.5, 3.0, 8.0, 12.0, 40.0, 0.0]::DOUBLE[])[o_orderkey % 7 + 1] END AS max_gap_ratio, ([0.0, 0.25, 0.5, 0.9, 1.0]::DOUBLE[])[o_orderkey % 5 + 1] AS baro_present_frac FROM orders)"""


def _census_sql(rows: str, factor: str, floor: str, floor_ratio: str) -> str:
    gap = f"CASE WHEN {_SOUND_DT} AND {_SOUND_RATIO} THEN max_gap_ratio * dt_s END"
    return "SELECT source, count(*) AS tracks, " + ", ".join([
        r(_P("baro_present_frac < 0.5"), "no_baro_pct"), r(_PO("baro_present_frac = 0", "baro_present_frac < 0.5"), "baro_zero_pct"), r(_PO("baro_present_frac = 1", "baro_present_frac >= 0.5"), "baro_full_pct"),
        r(_PO("m > 0", "baro_present_frac >= 0.5"), "baro_miss_flights_pct"), r("quantile_cont(CASE WHEN baro_present_frac >= 0.5 AND m > 0 THEN m END, 0.5)", "baro_miss_median_fixes"), r("max(CASE WHEN baro_present_frac >= 0.5 THEN m END)", "baro_miss_max_fixes"),
        r("quantile_cont(duration_s, 0.5) / 3600", "median_dur_h"), r("quantile_cont(path_km, 0.5)", "median_path_km"), r(_PO("dt_s = round_even(dt_s, 0)", _SOUND_DT), "dt_int_pct"),
        *[r(_PO(f"dt_s = {k}", _SOUND_DT), f"dt_{k}_pct") for k in (1, 2, 5, 10)], r(_PO("abs(max_gap_ratio - round_even(max_gap_ratio, 0)) < 1e-9", _SOUND_RATIO), "gap_int_pct"), r(_P(f"{gap} > {factor} * dt_s"), "gap_split_rel_pct"),
        r(_P(f"{gap} > least({factor} * dt_s, greatest({floor}, {floor_ratio} * dt_s))"), "gap_split_comb_pct")]) + f" FROM (SELECT *, round_even((1 - baro_present_frac) * n_fix, 0) AS m FROM {rows}) GROUP BY source"


@register("a21_census_macros", query(_census_sql("st", "4", "20.0", "3"), VIEW, STEPS, STATS))
def a21(spark, d):
    return census.census_measures(statistics(spark, d), LIMITS)


@register("a21_census_mixed", query(_census_sql("mx", "10", "20.0", "2"), _MIXED))
def a21_mixed(spark, d):
    return census.census_measures(mixed_census(spark, d))


def _filter_sql(rows: str, overlong: str, least: str, path: str) -> str:
    return f"""SELECT source, CAST(sum(CASE WHEN duration_s >= {least} THEN 1 ELSE 0 END) AS BIGINT) AS long_enough, CAST(sum(CASE WHEN duration_s > {overlong} THEN 1 ELSE 0 END) AS BIGINT) AS overlong,
  CAST(sum(CASE WHEN duration_s >= {least} AND path_km < {path} THEN 1 ELSE 0 END) AS BIGINT) AS short_path, coalesce(floor(min(CASE WHEN duration_s > {overlong} THEN duration_s / 3600 END)), 0.0::DOUBLE) AS overlong_min_h,
  coalesce(floor(max(CASE WHEN duration_s > {overlong} THEN duration_s / 3600 END)), 0.0::DOUBLE) AS overlong_max_h, coalesce(round_even(max(CASE WHEN duration_s > {overlong} THEN path_km END), 0), 0.0::DOUBLE) AS overlong_max_path_km,
  {r(f'coalesce(quantile_cont(CASE WHEN duration_s >= {least} AND path_km < {path} THEN extent_km END, 0.5), 0.0)', 'short_path_median_extent_km')} FROM {rows} GROUP BY source"""


@register("a22_filter_macros", query(_filter_sql("st", "57600", "2400", "30"), VIEW, STEPS, STATS))
def a22(spark, d):
    return census.filtering_measures(statistics(spark, d), LIMITS)


@register("a22_filter_mixed", query(_filter_sql("mx", "57600", "2400", "20"), _MIXED))
def a22_mixed(spark, d):
    return census.filtering_measures(mixed_census(spark, d), Thresholds())


_TH = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]


@register("a24_fraction", query(f"SELECT 40.0::DOUBLE AS threshold, {r('coalesce(avg(CASE WHEN duration_s / 60 >= 40 THEN 1.0::DOUBLE ELSE 0.0 END), 0.0)', 'retained')} FROM st WHERE isfinite(duration_s)", VIEW, STEPS, STATS))
def a24(spark, d):
    return census.fraction_retained(statistics(spark, d).withColumn("m", F.col("duration_s") / 60), "m", 40.0)


@register("a25_retention_curve", query(f"SELECT th AS threshold, {r('avg(CASE WHEN path_km >= th THEN 1.0::DOUBLE ELSE 0.0 END)', 'retained')} FROM st, (SELECT unnest({_TH}::DOUBLE[]) AS th) GROUP BY th", VIEW, STEPS, STATS))
def a25(spark, d):
    return census.retention_curve(statistics(spark, d), "path_km", _TH)


@register("j5_retention", query(f"SELECT th AS threshold, {r('avg(CASE WHEN max_gap_ratio <= th THEN 1.0::DOUBLE ELSE 0.0 END)', 'retained')} FROM st, (SELECT unnest([2, 3, 5, 8, 13]::DOUBLE[]) AS th) WHERE max_gap_ratio IS NOT NULL GROUP BY th", VIEW, STEPS, STATS))
def j5(spark, d):
    return census.retention_curve(statistics(spark, d), "max_gap_ratio", [2, 3, 5, 8, 13], "at_most")


_EDGES = [float(x) for x in range(0, 105001, 5000)]


def _edges(name: str, edges: str) -> str:
    """A table of bins (b, lo, hi, top) over a list of edges."""
    return f"{name} AS (SELECT i - 1 AS b, e[i] AS lo, e[i + 1] AS hi, i = len(e) - 1 AS top FROM (SELECT {edges} AS e), (SELECT unnest(range(1, 5000)) AS i) WHERE i < len(e))"


def _bars(panel: str, rows: str, edges: str) -> str:
    return f"SELECT '{panel}' AS panel, source, CAST(b AS INTEGER) AS bin, {r('lo')}, {r('hi')}, count(*) AS n, {r('count(*) / (sum(count(*)) OVER (PARTITION BY source) * (hi - lo))', 'value')} FROM (SELECT source, b, lo, hi FROM ({rows}) JOIN {edges} ON x >= lo AND (x < hi OR top AND x = hi)) GROUP BY source, b, lo, hi"


def _curve(panel: str, rows: str, grid: str, sign: str = ">=") -> str:
    return f"SELECT '{panel}' AS panel, source, CAST(NULL AS INTEGER) AS bin, {r('th', 'lo')}, CAST(NULL AS DOUBLE) AS hi, CAST(NULL AS BIGINT) AS n, {r(f'100 * avg(CASE WHEN x {sign} th THEN 1.0::DOUBLE ELSE 0.0 END)', 'value')} FROM ({rows}), (SELECT unnest({grid}) AS th) GROUP BY source, th"


_list = lambda values: "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"
_line = lambda lo, hi, n: f"list_transform(range(0, {n}), lambda i: CASE WHEN i = {n - 1} THEN {hi} ELSE i * (({hi} - {lo}) / {n - 1}) + {lo} END)"


@register("f1_flight_tables", query(
    " UNION ALL ".join([_bars("duration_h", "SELECT source, duration_s / 3600 AS x FROM st WHERE duration_s > 0", "de"), _bars("path_km", "SELECT source, path_km AS x FROM st WHERE path_km > 0", "pe"), _curve("kept_min", "SELECT source, duration_s / 60 AS x FROM st WHERE duration_s > 0", _list(census.KEPT_MINUTES)), _curve("kept_km", "SELECT source, path_km AS x FROM st WHERE path_km > 0", _list(census.KEPT_KM))]),
    VIEW, STEPS, STATS, _edges("de", _list(census.DURATION_EDGES)), _edges("pe", _list(census.PATH_EDGES))))
def f1(spark, d):
    return census.flight_tables(statistics(spark, d))


@register("f2_gap_tables", query(
    " UNION ALL ".join([_bars("gap_ratio", "SELECT source, max_gap_ratio AS x FROM st WHERE max_gap_ratio > 0", "ge"), _bars("missing", "SELECT source, missing_fraction AS x FROM st WHERE missing_fraction IS NOT NULL", "me"), _curve("kept_gap", "SELECT source, max_gap_ratio AS x FROM st WHERE max_gap_ratio > 0", "(SELECT list_transform(range(0, 80), lambda i: pow(10.0::DOUBLE, i * (log10(greatest(200.0, g)) / 79))) FROM ax)", "<="), _curve("kept_missing", "SELECT source, missing_fraction AS x FROM st WHERE missing_fraction IS NOT NULL", f"(SELECT {_line('0.0', 'greatest(0.6, m)', 80)} FROM ax)", "<=")]),
    VIEW, STEPS, STATS, "ax AS (SELECT greatest(quantile_cont(CASE WHEN max_gap_ratio > 0 THEN max_gap_ratio END, 0.9), 2 * 4.0) AS g, greatest(quantile_cont(missing_fraction, 0.9), 1.1::DOUBLE * 0.4::DOUBLE) AS m FROM st)", _edges("ge", f"(SELECT {_line('1.0', 'g', 50)} FROM ax)"), _edges("me", f"(SELECT {_line('0.0', 'm', 50)} FROM ax)")))
def f2(spark, d):
    return census.gap_tables(statistics(spark, d), LIMITS)


def _axis(quantity: str, cuts: str, far: str) -> str:
    return f"(SELECT lo - 0.02::DOUBLE * (hi - lo) AS a, hi + 0.02::DOUBLE * (hi - lo) AS b FROM (SELECT least((SELECT quantile_cont(value, 0.001) FROM uu WHERE quantity = '{quantity}'), {cuts}) AS lo, {far} AS hi))"


_SPEED_AXIS = _axis("v_xy", "45.0::DOUBLE, 55.0::DOUBLE", "greatest((SELECT max(q) FROM (SELECT quantile_cont(value, 0.9999) AS q FROM uu WHERE quantity = 'v_xy' GROUP BY source)), 1.8::DOUBLE * 55.0::DOUBLE)")
_CLIMB_AXIS = _axis("v_z", "40.0::DOUBLE", "greatest((SELECT max(q) FROM (SELECT quantile_cont(value, 0.9999) AS q FROM uu WHERE quantity = 'v_z' GROUP BY source)), 1.8::DOUBLE * 40.0::DOUBLE)")
_ALT_AXIS = _axis("alt", "100.0::DOUBLE, 4000.0::DOUBLE", "greatest((SELECT quantile_cont(value, 0.999) FROM uu WHERE quantity = 'alt'), 1.05::DOUBLE * 4000.0::DOUBLE)")


@register("f4_fix_tables", query(
    " UNION ALL ".join(_bars(n, f"SELECT source, value AS x FROM uu WHERE quantity = '{n}'", e) for n, e in (("v_xy", "xe"), ("v_z", "ze"), ("alt", "ae"))),
    *_QUANT, "uu AS (SELECT * FROM u WHERE value IS NOT NULL)", _edges("xe", f"(SELECT {_line('a', 'b', 60)} FROM {_SPEED_AXIS})"), _edges("ze", f"(SELECT list_transform(range(0, CAST(ceil(b) - floor(a) + 2 AS BIGINT)), lambda i: floor(a) - 0.5 + i) FROM {_CLIMB_AXIS})"), _edges("ae", f"(SELECT {_line('a', 'b', 60)} FROM {_ALT_AXIS})")))
def f4(spark, d):
    return census.fix_tables(census.fix_quantities(view(spark, d)), LIMITS)


@register("r6_speed_by_rate", query(f"SELECT round_even(dt_s, 0) AS rate_s, count(*) AS n, {r('avg(step_m / dt)', 'v_xy_mps')}, {r('avg(abs(dz) / dt)', 'v_z_mps')} FROM s JOIN (SELECT source, flight_id, dt_s FROM st WHERE dt_s > 0) USING (source, flight_id) WHERE dt > 0 GROUP BY 1", VIEW, STEPS, STATS))
def r6(spark, d):
    return census.speed_by_rate(tracks.with_steps(view(spark, d)), statistics(spark, d))


@register("j6_known_else_scan", query("SELECT source, CAST(sum(CASE WHEN f < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_absent, count(*) AS n FROM (SELECT source, flight_id, avg(CASE WHEN baro_alt <> 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS f FROM v WHERE source = 'paragliders' AND fix_no <= 20 GROUP BY ALL HAVING count(*) >= 3) GROUP BY source UNION ALL SELECT source, CAST(sum(CASE WHEN baro_present_frac < 0.5 THEN 1 ELSE 0 END) AS BIGINT), count(*) FROM st WHERE source <> 'paragliders' GROUP BY source", VIEW, STEPS, STATS))
def j6(spark, d):
    """One discipline's counts are known from an earlier look at the first twenty fixes; the other's come from the census."""
    known = census.baro_absent(view(spark, d).where("source = 'paragliders' and fix_no <= 20"))
    return census.absent_or_known(known, census.baro_absent_census(statistics(spark, d)))


@register("a26_histogram", f"""WITH b AS (SELECT l_returnflag, least(floor(l_extendedprice / 5000), {len(_EDGES) - 2}) AS bin FROM lineitem WHERE l_extendedprice BETWEEN 0 AND {_EDGES[-1]}),
c AS (SELECT l_returnflag, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY ALL)
SELECT l_returnflag, bin, {r('bin * 5000.0::DOUBLE', 'lo')}, {r('(bin + 1) * 5000.0::DOUBLE', 'hi')}, n, {r('n / (sum(n) OVER (PARTITION BY l_returnflag) * 5000.0)', 'density')} FROM c""")
def a26(spark, d):
    return census.density_histogram(table(spark, d, "lineitem"), "l_extendedprice", _EDGES, "l_returnflag")


@register("a27_sampling_hist", query(f"SELECT source, CAST(bin AS BIGINT) AS bin, n, {r('n / sum(n) OVER (PARTITION BY source)', 'density')} FROM (SELECT source, floor(least(dt_s, 40.0) + 0.5) AS bin, count(*) AS n FROM st WHERE isfinite(dt_s) AND dt_s > 0 GROUP BY ALL)", VIEW, STEPS, STATS))
def a27(spark, d):
    return census.interval_histogram(statistics(spark, d), 40)


@register("a28_cut_fraction", query(f"""SELECT source, quantity, count(*) AS n, {r("100 * avg(CASE WHEN CASE quantity WHEN 'v_xy' THEN value > CASE source WHEN 'paragliders' THEN 45.0 ELSE 55.0 END WHEN 'v_z' THEN value > 40.0 ELSE NOT (value BETWEEN 100 AND 4000) END THEN 1.0::DOUBLE ELSE 0.0 END)", 'removed_pct')} FROM u WHERE value IS NOT NULL GROUP BY ALL""", *_QUANT))
def a28(spark, d):
    return census.cut_fractions(census.fix_quantities(view(spark, d)), LIMITS)


@register("a29_axis_quantiles", f"SELECT l_returnflag, q, {r('quantile_cont(l_extendedprice, q)', 'x')} FROM (SELECT l_returnflag, l_extendedprice, 0.001::DOUBLE AS q FROM lineitem) GROUP BY ALL" + "".join(f" UNION ALL SELECT l_returnflag, {q}::DOUBLE, {r(f'quantile_cont(l_extendedprice, {q})', 'x')} FROM lineitem GROUP BY ALL" for q in (0.9, 0.999, 0.9999)))
def a29(spark, d):
    return census.quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.001, 0.9, 0.999, 0.9999], "l_returnflag")


ORACLE["a29_axis_quantiles"] = " UNION ALL ".join(f"SELECT l_returnflag, {q}::DOUBLE AS q, {r(f'quantile_cont(l_extendedprice, {q})', 'x')} FROM lineitem GROUP BY l_returnflag" for q in (0.001, 0.9, 0.999, 0.9999))
_Z = repr(stats.z_of(0.95))


@register("a30_proportion_ci", query(f"SELECT source, n_absent, n, {r('p')}, {r(f'{_Z} * sqrt(p * (1 - p) / n)', 'half_width')} FROM (SELECT source, CAST(sum(CASE WHEN baro_present_frac < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_absent, count(*) AS n, avg(CASE WHEN baro_present_frac < 0.5 THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM st GROUP BY source)", VIEW, STEPS, STATS))
def a30(spark, d):
    p, h = stats.proportion_ci(F.col("n_absent"), F.col("n"))
    return census.baro_absent_census(statistics(spark, d)).withColumns({"p": p, "half_width": h})


@register("a31_sample_size", query(f"SELECT source, CAST(ceil(pow({_Z}, 2) * 0.25 / pow(0.02, 2)) AS BIGINT) AS needed, count(*) >= ceil(pow({_Z}, 2) * 0.25 / pow(0.02, 2)) AS enough FROM st GROUP BY source", VIEW, STEPS, STATS))
def a31(spark, d):
    needed = stats.required_sample_size(0.02)
    return statistics(spark, d).groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit(needed).cast("bigint").alias("needed"), (F.col("n") >= needed).alias("enough"))


# The published thresholds, and this engine's own beside them.
_MACROS = """
alt_channel.baro_min_range_m 30, alt_channel.baro_present_frac 0.5, fix_level.block_max_s 60, fix_level.frozen_delta_z_m 5, fix_level.frozen_eps_m 15, fix_level.frozen_tau_s 60,
fix_level.hampel_eps_min_m 15, fix_level.hampel_k 5, fix_level.hampel_min_window_fixes 5, fix_level.hampel_window_s 20, fix_level.integrity_max_fraction 0.1, fix_level.max_altitude_m 6000,
fix_level.max_horizontal_speed_mps.hang gliders 55, fix_level.max_horizontal_speed_mps.paragliders 45, fix_level.max_vertical_speed_mps 13, fix_level.min_altitude_m -100,
flight_level.max_duration_s 57600, flight_level.min_alt_range_m 75, flight_level.min_duration_s 2400, flight_level.min_path_km 20, sampling.gap_floor_ratio 2, sampling.max_gap_factor 10,
sampling.max_gap_seconds 20, sampling.max_missing_fraction 0.1, sampling.min_segment_duration_s 90, savgol.polyorder 3, savgol.tau_c_horizontal_s 5, savgol.tau_c_vertical_baro_s 5,
savgol.tau_c_vertical_gnss_s 5, savgol.window_min 5, trimming.ground_flatness_m 5, trimming.interior_ground_s 600, trimming.sustained_s 30, trimming.takeoff_speed_mps 5
"""
_MACRO_ROWS = ", ".join("('{}', {}::DOUBLE)".format(*x.strip().rsplit(" ", 1)) for x in _MACROS.split(","))


_COUNTS = ("long_enough", "overlong", "short_path", "overlong_min_h", "overlong_max_h", "overlong_max_path_km", "short_path_median_extent_km")


@register("k7_config_macros", query(f"SELECT * FROM (VALUES {_MACRO_ROWS}) v(name, value) UNION ALL SELECT 'census.' || source || '.' || measure AS name, value FROM (UNPIVOT (SELECT source, {', '.join(f'{c}::DOUBLE AS {c}' for c in _COUNTS)} FROM fm) ON {', '.join(_COUNTS)} INTO NAME measure VALUE value)", _MIXED, f"fm AS ({_filter_sql('mx', '57600', '2400', '20')})"))
def k7(spark, d):
    """The thresholds as named values, and beside them what the flight-level ones leave of a census."""
    limits = Thresholds()
    left = census.filtering_measures(mixed_census(spark, d), limits)
    named = left.select("source", *[F.col(c).cast("double").alias(c) for c in _COUNTS]).unpivot(["source"], list(_COUNTS), "measure", "value")
    return spark.createDataFrame(limits.table(), "name string, value double").unionByName(named.select(F.concat_ws(".", F.lit("census"), "source", "measure").alias("name"), "value"))


# ---------------------------------------------------------------- parsing and files
def _record_rows(spark, d):
    v = view(spark, d)
    second = (F.col("t") * 30 + 43000 + F.col("flight_id") * 7) % 86400
    line = tracks.record_line(second, F.col("lat"), F.when(F.col("flight_id") % 2 == 0, -F.col("lon")).otherwise(F.col("lon")), F.col("valid"), F.col("baro_alt") - 300, F.col("gnss_alt"))
    bad = F.when(F.col("fix_no") % 97 == 5, F.concat(F.lit("X"), line)).when(F.col("fix_no") % 89 == 7, F.substring(line, 1, 30)).when(F.col("fix_no") % 83 == 11, F.overlay(line, F.lit("99"), F.lit(2))).when(F.col("fix_no") % 79 == 13, F.overlay(line, F.lit("Q"), F.lit(15))).when(F.col("fix_no") % 73 == 17, F.overlay(line, F.lit("12x45"), F.lit(26))).otherwise(line)
    return v.select("source", "flight_id", F.col("fix_no").alias("line_no"), F.explode(F.array(bad)).alias("line"))  # text is made once, then read


def _angle_sql(x: str, digits: int, pos: str, neg: str) -> str:
    m = f"round_even((abs({x}) - floor(abs({x}))) * 60000, 0)"
    return f"(lpad(CAST(CAST(floor(abs({x})) + CASE WHEN {m} >= 60000 THEN 1 ELSE 0 END AS INTEGER) AS VARCHAR), {digits}, '0') || lpad(CAST(CAST(CASE WHEN {m} >= 60000 THEN 0 ELSE {m} END AS INTEGER) AS VARCHAR), 5, '0') || CASE WHEN {x} < 0 THEN '{neg}' ELSE '{pos}' END)"


_HIGH = lambda x: f"(CASE WHEN {x} < 0 THEN '-' || lpad(CAST(CAST(abs({x}) AS INTEGER) AS VARCHAR), 4, '0') ELSE lpad(CAST(CAST({x} AS INTEGER) AS VARCHAR), 5, '0') END)"
_TWO = lambda x: f"lpad(CAST(CAST(floor({x}) AS INTEGER) AS VARCHAR), 2, '0')"
_INT = lambda x: f"(CASE WHEN regexp_full_match({x}, '\\s*[+-]?[0-9]+\\s*') THEN TRY_CAST({x} AS INTEGER) END)"


def _angle_back(start: int, digits: int, pos: str, neg: str, limit: int) -> str:
    deg, mins, h = _INT(f"substr(line, {start}, {digits})"), _INT(f"substr(line, {start + digits}, 5)"), f"upper(substr(line, {start + digits + 5}, 1))"
    value = f"({deg} + {mins} / 60000.0::DOUBLE)"
    return f"(CASE WHEN {mins} < 60000 AND {h} IN ('{pos}', '{neg}') AND {value} <= {limit} THEN CASE WHEN {h} = '{neg}' THEN -{value} ELSE {value} END END)"


_RECORDS = f"""l0 AS (SELECT source, flight_id, fix_no AS line_no, fix_no, CAST(t * 30 + 43000 + flight_id * 7 AS BIGINT) % 86400 AS sec, lat, CASE WHEN flight_id % 2 = 0 THEN -lon ELSE lon END AS lon, valid, baro_alt - 300 AS ba, gnss_alt AS ga FROM v),
l1 AS (SELECT source, flight_id, line_no, 'B' || {_TWO('sec / 3600')} || {_TWO('sec % 3600 / 60')} || {_TWO('sec % 60')} || {_angle_sql('lat', 2, 'N', 'S')} || {_angle_sql('lon', 3, 'E', 'W')} || CASE WHEN valid THEN 'A' ELSE 'V' END || {_HIGH('ba')} || {_HIGH('ga')} AS line FROM l0),
l2 AS (SELECT source, flight_id, line_no, CASE WHEN line_no % 97 = 5 THEN 'X' || line WHEN line_no % 89 = 7 THEN substr(line, 1, 30) WHEN line_no % 83 = 11 THEN substr(line, 1, 1) || '99' || substr(line, 4)
  WHEN line_no % 79 = 13 THEN substr(line, 1, 14) || 'Q' || substr(line, 16) WHEN line_no % 73 = 17 THEN substr(line, 1, 25) || '12x45' || substr(line, 31) ELSE line END AS line FROM l1),
l3 AS (SELECT source, flight_id, line_no, CASE WHEN {_INT('substr(line, 2, 2)')} BETWEEN 0 AND 23 AND {_INT('substr(line, 4, 2)')} BETWEEN 0 AND 59 AND {_INT('substr(line, 6, 2)')} BETWEEN 0 AND 59
    THEN {_INT('substr(line, 2, 2)')} * 3600 + {_INT('substr(line, 4, 2)')} * 60 + {_INT('substr(line, 6, 2)')} END AS sod, {_angle_back(8, 2, 'N', 'S', 90)} AS lat, {_angle_back(16, 3, 'E', 'W', 180)} AS lon,
    substr(line, 25, 1) IN ('A', 'a') AS valid, {_INT('substr(line, 26, 5)')}::DOUBLE AS baro_alt, {_INT('substr(line, 31, 5)')}::DOUBLE AS gnss_alt
  FROM l2 WHERE line LIKE 'B%' AND length(line) >= 35),
l4 AS (SELECT *, CASE WHEN sod - lag(sod) OVER (PARTITION BY source, flight_id ORDER BY line_no) < -43200 THEN 1 ELSE 0 END AS mid FROM l3 WHERE sod IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND baro_alt IS NOT NULL AND gnss_alt IS NOT NULL),
l5 AS (SELECT *, sod + 86400 * sum(mid) OVER (PARTITION BY source, flight_id ORDER BY line_no) AS clock FROM l4),
l6 AS (SELECT *, max(clock) OVER (PARTITION BY source, flight_id ORDER BY line_no) AS c, row_number() OVER (PARTITION BY source, flight_id ORDER BY line_no) AS fix_no FROM l5)"""


@register("s2_parse_records", query(f"SELECT source, flight_id, fix_no, CAST(c - first_value(c) OVER (PARTITION BY source, flight_id ORDER BY line_no) AS DOUBLE) AS t, {r('lat')}, {r('lon')}, valid, baro_alt, gnss_alt FROM l6", VIEW, _RECORDS))
def s2(spark, d):
    return tracks.parse_records(_record_rows(spark, d))


@register("p1_record_lines", query("SELECT source, count(*) AS lines, CAST(sum(CASE WHEN line LIKE 'B%' AND length(line) >= 35 THEN 1 ELSE 0 END) AS BIGINT) AS records FROM l2 GROUP BY source", VIEW, _RECORDS))
def p1(spark, d):
    rows = _record_rows(spark, d)
    return rows.groupBy("source").agg(F.count("*").alias("lines"), F.sum(records.is_record(F.col("line")).cast("bigint")).alias("records"))


@register("s14_seeded_sample")
def s14(spark, d):
    return tracks.seeded_sample(table(spark, d, "events").select("event_id", "user_id"), 200, "event_id", 42)


_SOUND = "octet_length(encode(coalesce(text, ''))) >= 100 AND coalesce(list_filter(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: trim(x) <> '')[1] LIKE 'T%', false) AND len(list_filter(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: starts_with(x, 'A'))) > 0"


def _doc_lines(spark, d):
    content = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.split(content, "\r\n|\r|\n").alias("lines"), F.octet_length(content).alias("n_bytes"))


@register("p8_content_validity", f"SELECT doc_id, {_SOUND} AS sound FROM documents")
def p8(spark, d):
    return _doc_lines(spark, d).select("doc_id", records.looks_like_track(F.col("lines"), F.col("n_bytes"), record="T", body="A").alias("sound"))


@register("p9_file_check", f"SELECT doc_id, c AS category, c IN ('too_small', 'invalid_structure', 'unreadable', 'leftover') AS failure FROM (SELECT doc_id, CASE WHEN octet_length(encode(coalesce(text, ''))) < 100 THEN 'too_small' WHEN NOT ({_SOUND}) THEN 'invalid_structure' END AS c FROM documents) WHERE c IS NOT NULL")
def p9(spark, d):
    found = _doc_lines(spark, d).select("doc_id", records.file_problem(F.col("lines"), F.col("n_bytes"), record="T", body="A").alias("category"))
    return found.where(F.col("category").isNotNull()).withColumn("failure", records.is_integrity_failure(F.col("category")))


@register("p10_entry_kind", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN starts_with(n, '._') THEN 'sidecar' WHEN lower(n) LIKE '%.part' THEN 'leftover' WHEN lower(n) LIKE '%.igc' THEN 'check' ELSE 'other' END AS kind FROM (SELECT CASE WHEN event_id % 5 = 0 THEN '._' ELSE '' END || event_id || CASE WHEN event_id % 3 = 0 THEN '.igc' WHEN event_id % 3 = 1 THEN '.igc.part' ELSE '.txt' END AS n FROM events)) GROUP BY kind")
def p10(spark, d):
    e = F.col("event_id")
    name = F.concat(F.when(e % 5 == 0, "._").otherwise(""), e.cast("string"), F.when(e % 3 == 0, ".igc").when(e % 3 == 1, ".igc.part").otherwise(".txt"))
    return table(spark, d, "events").select(records.entry_kind(name).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@register("p12_clean_link", "SELECT page_id, CASE WHEN lower(trim(coalesce(url, ''))) LIKE '%.html' THEN trim(coalesce(url, '')) ELSE '' END AS link, lower(trim(coalesce(url, ''))) LIKE '%.html' AS has FROM pages")
def p12(spark, d):
    link = naming.clean_link(F.col("url"), ".html")
    return table(spark, d, "pages").select("page_id", link.alias("link"), (link != "").alias("has"))


@register("p14_lenient_numbers", r"""WITH x AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ' ' || CAST(CAST(value * 100 AS BIGINT) AS VARCHAR) || '.5 ' WHEN event_id % 4 = 1 THEN CAST(event_id AS VARCHAR) || 'd' WHEN event_id % 4 = 2 THEN '-' || CAST(event_id AS VARCHAR) || '.75' ELSE '' END AS s FROM events)
SELECT event_id, CASE WHEN regexp_full_match(s, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') THEN CAST(trim(s) AS DOUBLE) END AS f, CASE WHEN regexp_full_match(s, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') THEN CAST(trunc(CAST(trim(s) AS DOUBLE)) AS BIGINT) END AS i FROM x""")
def p14(spark, d):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, F.concat(F.lit(" "), F.rint(F.col("value") * 100).cast("bigint").cast("string"), F.lit(".5 "))).when(e % 4 == 1, F.concat(e.cast("string"), F.lit("d"))).when(e % 4 == 2, F.concat(F.lit("-"), e.cast("string"), F.lit(".75"))).otherwise("")
    return table(spark, d, "events").select("event_id", naming.lenient_double(text).alias("f"), naming.lenient_long(text).alias("i"))


@register("p16_year_filter", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1993, 1995, 1996, 1997) GROUP BY 1")
def p16(spark, d):
    years = naming.parse_seasons("1997-1995,1993", 1990, 2000)
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).where(F.col("y").isin(years)).groupBy("y").agg(F.count("*").alias("n"))


@register("c5_names", "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) + 1 AS VARCHAR) AS season, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%Y-%m-%d') || '_' || o_orderkey || '.igc' AS name, CAST(o_orderkey AS VARCHAR) AS back FROM orders")
def c5(spark, d):
    date = F.date_format("o_orderdate", "yyyy/MM/dd")
    name = naming.track_name(date, F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", naming.season_label(F.year("o_orderdate")).alias("season"), naming.name_parts(name)[0].alias("date"), name.alias("name"), naming.name_parts(name)[1].alias("back"))


# ---------------------------------------------------------------- catalog
def _catalog(spark, d):
    """Orders as flights, and the large ones of their lines as the listing of landed files."""
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    link = F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.col("o_orderpriority"))
    flights = table(spark, d, "orders").select(F.year("o_orderdate").alias("season_year"), date.alias("date"), F.col("o_orderkey").alias("flight_id"), link.alias("igc_link"))
    sizes = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("flight_id")).agg(F.max("l_quantity").alias("length"))
    files = sizes.join(flights, "flight_id").select(naming.track_path("/archive", F.col("season_year"), F.col("date"), F.col("flight_id")).alias("path"), "length")
    return catalog.build_catalog(flights, files, "/archive").select("season_year", "flight_id", "igc_link", "downloaded", "file_size")


_CAT = "c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season_year, o_orderkey AS flight_id, CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE o_orderpriority END AS igc_link, size IS NOT NULL AS downloaded, size AS file_size FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS size FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_orderkey = o_orderkey)"


@register("j1_catalog_files", query(f"SELECT season_year, flight_id, igc_link, downloaded, {r('file_size')} FROM c", _CAT))
def j1(spark, d):
    return _catalog(spark, d)


@register("j2_already_present", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def j2(spark, d):
    present = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(present, "o_orderkey", "left_anti")


@register("j3_present_with_track", query("SELECT season_year, count(*) AS n FROM c WHERE igc_link <> '' AND downloaded GROUP BY 1", _CAT))
def j3(spark, d):
    cat = _catalog(spark, d)
    with_track = cat.where("igc_link <> ''").select("flight_id")
    return cat.where("downloaded").join(with_track, "flight_id", "left_semi").groupBy("season_year").agg(F.count("*").alias("n"))


@register("j7_id_intersection", "SELECT c_custkey AS flight_id FROM customer INTERSECT SELECT o_custkey FROM orders")
def j7(spark, d):
    return catalog.shared_ids(table(spark, d, "customer").select(F.col("c_custkey").alias("flight_id")), table(spark, d, "orders").select(F.col("o_custkey").alias("flight_id")))


@register("a1_season_counts", query("SELECT season_year, count(*) AS n_flights, CAST(sum(CASE WHEN igc_link <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_with_igc, CAST(sum(CASE WHEN downloaded THEN 1 ELSE 0 END) AS BIGINT) AS n_downloaded, season_year || '-' || (season_year + 1) AS season FROM c GROUP BY season_year", _CAT))
def a1(spark, d):
    return catalog.season_index(_catalog(spark, d))


@register("a2_status_rollup", query("SELECT season_year, count(*) AS n_flights, CAST(sum(CASE WHEN igc_link <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_with_igc, CAST(sum(CASE WHEN igc_link <> '' AND downloaded THEN 1 ELSE 0 END) AS BIGINT) AS n_downloaded, CAST(sum(CASE WHEN igc_link <> '' AND NOT downloaded THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM c GROUP BY ROLLUP (season_year)", _CAT))
def a2(spark, d):
    return catalog.status(_catalog(spark, d), F.col("igc_link") != "", F.col("downloaded"))


@register("a3_problem_counts", "SELECT event_type AS category, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def a3(spark, d):
    return catalog.problem_counts(table(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("category")))


@register("s10_season_index", query("SELECT season_year, season_year || '-' || (season_year + 1) AS season, 'https://host.invalid/list/' || season_year || '-' || (season_year + 1) AS list_url, 'https://host.invalid/list/' || season_year || '-' || (season_year + 1) || '/xml' AS xml_url, count(*) AS n_flights, CAST(sum(CASE WHEN igc_link <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_with_igc, CAST(sum(CASE WHEN downloaded THEN 1 ELSE 0 END) AS BIGINT) AS n_downloaded FROM c GROUP BY season_year", _CAT))
def s10(spark, d):
    """The season index written as CSV and read back by its own reader."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index = catalog.season_index(_catalog(spark, d))
    url = lambda suffix: naming.season_url("https://host.invalid/list", F.col("season_year"), suffix)
    sources.write_csv(index.select("season_year", "season", url("").alias("list_url"), url("/xml").alias("xml_url"), "n_flights", "n_with_igc", "n_downloaded"), path)
    return sources.read_season_index(spark, path)


_INDEX = "i AS (SELECT CASE WHEN season_year % 2 = 0 THEN 'even' ELSE 'odd' END AS discipline, season_year, count(*) AS n_flights, sum(CASE WHEN igc_link <> '' THEN 1 ELSE 0 END) AS n_with_igc, sum(CASE WHEN igc_link <> '' AND downloaded THEN 1 ELSE 0 END) AS n_downloaded FROM c GROUP BY ALL)"
_PCTS = "CAST(sum(n_flights) AS BIGINT) AS n_flights, CAST(sum(n_with_igc) AS BIGINT) AS n_with_igc, CAST(sum(n_downloaded) AS BIGINT) AS n_downloaded"


def _index(spark, d):
    status = catalog.status(_catalog(spark, d), F.col("igc_link") != "", F.col("downloaded")).where(F.col("season_year").isNotNull())
    return status.withColumn("discipline", F.when(F.col("season_year") % 2 == 0, "even").otherwise("odd"))


@register("a4_percentages", query(f"SELECT discipline, {_PCTS}, CASE WHEN sum(n_flights) = 0 THEN 0.0 ELSE round(100 * sum(n_with_igc)::DOUBLE / sum(n_flights), 1) END AS with_igc_pct, CASE WHEN sum(n_with_igc) = 0 THEN 0.0 ELSE round(100 * sum(n_downloaded)::DOUBLE / sum(n_with_igc), 1) END AS downloaded_pct FROM i GROUP BY ROLLUP (discipline)", _CAT, _INDEX))
def a4(spark, d):
    return catalog.percentages(_index(spark, d), "discipline")


@register("a5_season_table", query(f"SELECT discipline, season_year, {_PCTS} FROM i GROUP BY ROLLUP (discipline, season_year)", _CAT, _INDEX))
def a5(spark, d):
    return _index(spark, d).rollup("discipline", "season_year").agg(*[F.sum(c).alias(c) for c in ("n_flights", "n_with_igc", "n_downloaded")])


@register("a32_download_counts", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM k WHERE k <= 150 GROUP BY 1")
def a32(spark, d):
    first = catalog.first_of_each(table(spark, d, "events"), "event_type", "event_id", 150)
    return first.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("bigint")).alias("high"))


@register("b17_class_labels", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN lower(trim(p_type)) LIKE 'std%' OR lower(trim(p_type)) LIKE 'standard%' THEN 'standard' WHEN lower(trim(p_type)) LIKE 'eco%' THEN 'economy' WHEN lower(trim(p_type)) LIKE 'promo%' THEN 'promo' ELSE 'other' END AS class FROM part) GROUP BY class")
def b17(spark, d):
    names = {"std": "standard", "standard": "standard", "eco": "economy", "promo": "promo"}
    return table(spark, d, "part").select(observables.normalized_class(F.col("p_type"), names).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@register("b18_recodes", "SELECT o_orderkey AS flight_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS speed, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def b18(spark, d):
    o = table(spark, d, "orders")
    made = o.select(F.col("o_orderkey").alias("flight_id"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(0).cast("bigint")).otherwise(F.col("o_orderkey")).alias("speed"), F.when(F.col("o_orderkey") % 3 == 0, "2000-00-00").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return catalog.recoded(made, ["speed"])


@register("b19_duplicate_uploads", "WITH f AS (SELECT o_custkey AS pilot, strftime(o_orderdate, '%Y') AS date, o_orderkey AS flight_id, o_totalprice / 1000 AS km FROM orders) SELECT a.pilot, a.date, a.flight_id AS flight_a, b.flight_id AS flight_b FROM f a JOIN f b ON a.pilot = b.pilot AND a.date = b.date AND a.flight_id < b.flight_id AND abs(a.km - b.km) <= 5")
def b19(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("pilot"), F.date_format("o_orderdate", "yyyy").alias("date"), F.col("o_orderkey").alias("flight_id"), (F.col("o_totalprice") / 1000).alias("distance_km"))
    return catalog.near_uploads(o, 5.0)
