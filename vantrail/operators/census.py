"""Statistics a flight and over flights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantrail.config import Thresholds
from vantrail.functions.geo import great_circle_m
from vantrail.functions.stats import finite, percent
from vantrail.operators.ranks import exact_quantiles
from vantrail.sources.tracks import by_flight, with_steps

KEYS = ["source", "flight_id"]


def track_stats(fixes: DataFrame) -> DataFrame:
    """Twelve measures a flight of at least two fixes; undefined ones are null. One shuffle: the windows and the
    aggregation share the flight key."""
    first = lambda c: F.first(c).over(by_flight("fix_no"))
    steps = with_steps(fixes).withColumn("from_start", great_circle_m(first("lat"), first("lon"), F.col("lat"), F.col("lon")))
    moving = F.col("dt") > 0
    stats = steps.groupBy(*KEYS).agg(
        (F.max("t") - F.min("t")).alias("duration_s"),
        F.count("*").alias("n_fix"),
        (F.coalesce(F.sum("step_m"), F.lit(0.0)) / 1000).alias("path_km"),
        (F.max("from_start") / 1000).alias("extent_km"),
        F.median("dt").alias("dt_s"),
        F.max("dt").alias("max_gap_s"),
        F.avg((F.col("baro_alt") != 0).cast("double")).alias("baro_present_frac"),
        F.max(F.when(moving, F.col("step_m") / F.col("dt"))).alias("max_vxy_mps"),
        F.max(F.when(moving, F.abs("dz") / F.col("dt"))).alias("max_vz_mps"),
        F.min("baro_alt").alias("baro_alt_min_m"),
        F.max("baro_alt").alias("baro_alt_max_m"),
    )
    known = F.col("dt_s") > 0
    missing = 1 - F.col("n_fix") / (F.col("duration_s") / F.col("dt_s") + 1)
    return stats.where("n_fix >= 2").withColumns({"max_gap_ratio": F.when(known, F.col("max_gap_s") / F.col("dt_s")), "missing_fraction": F.when(known, F.greatest(F.lit(0.0), missing))}).drop("max_gap_s")


def baro_absent(fixes: DataFrame, least: int = 3, present: float = 0.5) -> DataFrame:
    """(source, n_absent, n) from fixes, over flights of at least ``least`` fixes. The census counts those of two as well."""
    flights = fixes.groupBy(*KEYS).agg(F.count("*").alias("n_fix"), F.avg((F.col("baro_alt") != 0).cast("double")).alias("frac"))
    return baro_absent_census(flights.where(F.col("n_fix") >= least), "frac", present)


def baro_absent_census(census: DataFrame, frac: str = "baro_present_frac", present: float = 0.5) -> DataFrame:
    return census.groupBy("source").agg(F.sum((F.col(frac) < present).cast("bigint")).alias("n_absent"), F.count("*").alias("n"))


def modal_interval(census: DataFrame) -> DataFrame:
    """The most frequent whole sampling interval, the smallest of several; intervals that round to zero are left out."""
    counts = census.where("dt_s >= 0.5").groupBy(F.rint("dt_s").alias("r")).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("r", F.struct(F.col("n"), -F.col("r"))).alias("modal_dt_s"))


def representative(census: DataFrame) -> DataFrame:
    """A source's flight of the most fixes, the first id of several; ids of any type that sorts."""
    return census.groupBy("source").agg(F.min_by("flight_id", F.struct(-F.col("n_fix"), F.col("flight_id"))).alias("flight_id"), F.max("n_fix").alias("n_fix"))


def _medians(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(source, a column a measure): medians of the measures' values that are not null, without a source's values in one task."""
    named = rows.select("source", *[c.cast("double").alias(n) for n, c in measures.items()]).unpivot(["source"], list(measures), "measure", "value")
    found = exact_quantiles(named, "value", [0.5], ["source", "measure"])
    at = F.get("xs", F.lit(0))
    return found.groupBy("source").agg(*[F.max(F.when(F.col("measure") == n, at)).alias(n) for n in measures])


def census_measures(census: DataFrame, limits: Thresholds | None = None) -> DataFrame:
    """The published shares and medians of a census, one row a source. Shares of intervals are over positive finite intervals, those of the
    largest gap's ratio over positive finite ratios, and those of split flights over flights that have both."""
    limits = limits or Thresholds()
    s, low = limits.sampling, limits.alt_channel.baro_present_frac
    frac, n = F.col("baro_present_frac"), F.col("n_fix")
    sound = lambda c: F.when(finite(F.col(c)) & (F.col(c) > 0), F.col(c))
    dt, ratio = sound("dt_s"), sound("max_gap_ratio")
    absent, present = frac < low, frac >= low
    missed = F.rint((1 - frac) * n)
    whole = lambda x: F.abs(x - F.rint(x)) < 1e-9
    share = lambda mask, of: F.coalesce(100 * F.avg(F.when(of, mask.cast("double"))), F.lit(0.0))
    gap, bound = ratio * dt, s.max_gap_factor * dt
    shares = census.groupBy("source").agg(
        F.count("*").alias("tracks"),
        percent(absent).alias("no_baro_pct"),
        share(frac == 0, absent).alias("baro_zero_pct"),
        share(frac == 1, present).alias("baro_full_pct"),
        share(missed > 0, present).alias("baro_miss_flights_pct"),
        F.max(F.when(present, missed)).alias("baro_miss_max_fixes"),
        percent(whole(dt)).alias("dt_int_pct"),
        *[percent(dt == k).alias(f"dt_{k}_pct") for k in (1, 2, 5, 10)],
        percent(whole(ratio)).alias("gap_int_pct"),
        percent(gap > bound).alias("gap_split_rel_pct"),
        percent(gap > F.least(bound, F.greatest(F.lit(s.max_gap_seconds), s.gap_floor_ratio * dt))).alias("gap_split_comb_pct"),
    )
    middle = _medians(census, {"baro_miss_median_fixes": F.when(present & (missed > 0), missed), "median_dur_h": F.col("duration_s") / 3600, "median_path_km": F.col("path_km")})
    return shares.join(middle, "source", "left")


def filtering_measures(census: DataFrame, limits: Thresholds) -> DataFrame:
    """What the flight-level cuts leave, one row a source; zeros where nothing is met."""
    f = limits.flight_level
    duration, path = F.col("duration_s"), F.col("path_km")
    over, short = duration > f.max_duration_s, (duration >= f.min_duration_s) & (path < f.min_path_km)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    counts = census.groupBy("source").agg(
        F.sum((duration >= f.min_duration_s).cast("bigint")).alias("long_enough"),
        F.sum(over.cast("bigint")).alias("overlong"),
        F.sum(short.cast("bigint")).alias("short_path"),
        zero(F.floor(F.min(F.when(over, duration / 3600))).cast("double")).alias("overlong_min_h"),
        zero(F.floor(F.max(F.when(over, duration / 3600))).cast("double")).alias("overlong_max_h"),
        zero(F.rint(F.max(F.when(over, path)))).alias("overlong_max_path_km"),
    )
    middle = _medians(census, {"short_path_median_extent_km": F.when(short, F.col("extent_km"))})
    return counts.join(middle, "source", "left").withColumn("short_path_median_extent_km", zero(F.col("short_path_median_extent_km")))


def fraction_retained(rows: DataFrame, value: str, threshold: float, mode: str = "at_least") -> DataFrame:
    return retention_curve(rows, value, [threshold], mode)


#: Edges and thresholds of the flight-level figure.
DURATION_EDGES, PATH_EDGES = list(np.linspace(0.0, 12.0, 70)), list(np.logspace(np.log10(0.5), 3.0, 70))
KEPT_MINUTES, KEPT_KM = list(np.linspace(5.0, 150.0, 80)), list(np.logspace(0.0, np.log10(500.0), 80))


def retention_curve(rows: DataFrame, value: str, thresholds: Sequence[float], mode: str = "at_least") -> DataFrame:
    """(threshold, retained): the share of finite values on the kept side of each threshold; 0 where none is finite. All
    thresholds are sums of one aggregation, so rows are not multiplied."""
    if mode not in ("at_least", "at_most"):
        raise ValueError(mode)
    x = F.col(value)
    meets = lambda th: x >= th if mode == "at_least" else x <= th
    sums = rows.where(finite(x)).agg(F.array(*[F.struct(F.lit(float(th)).alias("threshold"), F.coalesce(F.avg(meets(th).cast("double")), F.lit(0.0)).alias("retained")) for th in thresholds]).alias("curve"))
    return sums.select(F.inline("curve"))


def density_histogram(rows: DataFrame, value: str, edges: Sequence[float], group: str | None = None) -> DataFrame:
    """(group, bin, lo, hi, n, density) over all bins. The last bin takes its upper edge; what lies outside counts nowhere."""
    x = F.col(value)
    cuts = F.array(*[F.lit(float(e)) for e in edges])
    last = len(edges) - 2
    number = F.when(x == float(edges[-1]), last).otherwise(F.size(F.filter(cuts, lambda e: e <= x)) - 1)
    inside = rows.where(x.between(float(edges[0]), float(edges[-1])))
    keys = [group] if group else []
    counts = inside.groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    lo, hi = F.get(cuts, F.col("bin")), F.get(cuts, F.col("bin") + 1)
    return counts.select(*keys, "bin", lo.alias("lo"), hi.alias("hi"), "n", (F.col("n") / (total * (hi - lo))).alias("density"))


def interval_histogram(census: DataFrame, top: int = 11) -> DataFrame:
    """Shares of whole sampling intervals a source, ``top`` and beyond pooled."""
    b = F.floor(F.least(F.col("dt_s"), F.lit(float(top))) + 0.5)
    counts = census.where(finite(F.col("dt_s")) & (F.col("dt_s") > 0)).groupBy("source", b.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def fix_quantities(fixes: DataFrame, present: float = 0.5) -> DataFrame:
    """(source, flight_id, fix_no, quantity, value): v_xy and |v_z| of steps with dt > 0, and altitudes. The vertical ones
    only of flights whose barometer is present."""
    share = F.avg((F.col("baro_alt") != 0).cast("double")).over(by_flight())
    steps = with_steps(fixes).withColumn("baro", share >= present)
    moving = F.col("dt") > 0
    named = steps.select(*KEYS, "fix_no", F.when(moving, F.col("step_m") / F.col("dt")).alias("v_xy"), F.when(moving & F.col("baro"), F.abs("dz") / F.col("dt")).alias("v_z"), F.when(F.col("baro"), F.col("baro_alt")).alias("alt"))
    return named.unpivot([*KEYS, "fix_no"], ["v_xy", "v_z", "alt"], "quantity", "value").where(F.col("value").isNotNull())


def cut_fractions(quantities: DataFrame, limits: Thresholds) -> DataFrame:
    """Percent of fix-level values that each bound would remove: v_xy a source's own bound, v_z and altitude the shared ones."""
    f = limits.fix_level
    bound = F.create_map(*[F.lit(x) for pair in f.max_horizontal_speed_mps.items() for x in pair])[F.col("source")]
    v = F.col("value")
    removed = F.when(F.col("quantity") == "v_xy", v > bound).when(F.col("quantity") == "v_z", v > f.max_vertical_speed_mps).otherwise(~v.between(f.min_altitude_m, f.max_altitude_m))
    return quantities.groupBy("source", "quantity").agg(F.count("*").alias("n"), percent(removed).alias("removed_pct"))


def quantiles(rows: DataFrame, value: str, at: Sequence[float], *groups: str) -> DataFrame:
    """(groups, q, x): exact quantiles with linear interpolation."""
    found = exact_quantiles(rows, value, at, groups)
    return found.select(*groups, F.posexplode("xs").alias("i", "x")).select(*groups, F.get(F.array(*[F.lit(float(q)) for q in at]), F.col("i")).alias("q"), "x")


def retention_by(rows: DataFrame, value: str, thresholds: Sequence[float], group: str, mode: str = "at_least") -> DataFrame:
    """(group, threshold, retained): a retention curve a group, in one aggregation."""
    x = F.col(value)
    meets = lambda th: x >= th if mode == "at_least" else x <= th
    sums = rows.where(finite(x)).groupBy(group).agg(F.array(*[F.struct(F.lit(float(th)).alias("threshold"), F.avg(meets(float(th)).cast("double")).alias("retained")) for th in thresholds]).alias("curve"))
    return sums.select(group, F.inline("curve"))


def _panel(name: str, table: DataFrame) -> DataFrame:
    """One panel of a figure as rows (panel, source, bin, lo, hi, n, value): a histogram, or a curve whose lo is its abscissa."""
    if "density" in table.columns:
        return table.select(F.lit(name).alias("panel"), "source", F.col("bin").cast("int").alias("bin"), "lo", "hi", "n", F.col("density").alias("value"))
    none = lambda kind: F.lit(None).cast(kind)
    return table.select(F.lit(name).alias("panel"), "source", none("int").alias("bin"), F.col("threshold").alias("lo"), none("double").alias("hi"), none("bigint").alias("n"), (100 * F.col("retained")).alias("value"))


def flight_tables(census: DataFrame) -> DataFrame:
    """The flight-level figure: distributions of duration and path, and what lower bounds on them keep, a source."""
    rows = census.withColumns({"hours": F.col("duration_s") / 3600, "minutes": F.col("duration_s") / 60})
    lasting, moving = rows.where("duration_s > 0"), rows.where("path_km > 0")
    panels = [_panel("duration_h", density_histogram(lasting.where("hours <= 12"), "hours", DURATION_EDGES, "source")), _panel("path_km", density_histogram(moving, "path_km", PATH_EDGES, "source"))]
    panels += [_panel("kept_min", retention_by(lasting, "minutes", KEPT_MINUTES, "source")), _panel("kept_km", retention_by(moving, "path_km", KEPT_KM, "source"))]
    return panels[0].unionByName(panels[1]).unionByName(panels[2]).unionByName(panels[3])


def gap_tables(census: DataFrame, limits: Thresholds) -> DataFrame:
    """The sampling figure: distributions of the largest gap over the interval and of the missing share, and what upper bounds on them keep, a
    source. An axis ends at the 90th percentile, or past the bound where that lies further; two numbers reach the driver."""
    s = limits.sampling
    gaps, missing = census.where(finite(F.col("max_gap_ratio")) & (F.col("max_gap_ratio") > 0)), census.where(finite(F.col("missing_fraction")))
    p90 = lambda rows, value, none: next((r.xs[0] for r in exact_quantiles(rows, value, [0.9]).collect()), none)
    gap_end = max(p90(gaps, "max_gap_ratio", 1.0), 2.0 * s.max_gap_factor)
    missing_end = max(p90(missing, "missing_fraction", 0.0), 1.1 * s.max_missing_fraction)
    panels = [_panel("gap_ratio", density_histogram(gaps, "max_gap_ratio", list(np.linspace(1.0, gap_end, 50)), "source")), _panel("missing", density_histogram(missing, "missing_fraction", list(np.linspace(0.0, missing_end, 50)), "source"))]
    panels += [_panel("kept_gap", retention_by(gaps, "max_gap_ratio", list(np.logspace(0.0, np.log10(max(200.0, gap_end)), 80)), "source", "at_most"))]
    panels += [_panel("kept_missing", retention_by(missing, "missing_fraction", list(np.linspace(0.0, max(0.6, missing_end), 80)), "source", "at_most"))]
    return panels[0].unionByName(panels[1]).unionByName(panels[2]).unionByName(panels[3])


def fix_tables(quantities: DataFrame, limits: Thresholds) -> DataFrame:
    """The fix-level figure: distributions of horizontal speed, vertical speed (a bin a whole metre a second) and altitude, a source. Axes
    keep the bounds in view and reach the far quantiles; those few numbers reach the driver."""
    f = limits.fix_level
    pooled = {r.quantity: r.xs for r in exact_quantiles(quantities, "value", [0.001, 0.999], ["quantity"]).collect()}
    tails = {(r.quantity, r.source): r.xs[0] for r in exact_quantiles(quantities, "value", [0.9999], ["quantity", "source"]).collect()}
    bounds = {"v_xy": list(f.max_horizontal_speed_mps.values()), "v_z": [f.max_vertical_speed_mps], "alt": [f.min_altitude_m, f.max_altitude_m]}
    panels = []
    for name, cuts in bounds.items():
        low, high = pooled.get(name, [0.0, 0.0])
        lo = min(low, *cuts)
        hi = max(high, *[1.05 * c for c in cuts]) if name == "alt" else max([x for (q, _), x in tails.items() if q == name] + [1.8 * c for c in cuts])
        span = (hi - lo) or 1.0
        lo, hi = lo - 0.02 * span, hi + 0.02 * span
        edges = np.arange(np.floor(lo) - 0.5, np.ceil(hi) + 1.5, 1.0) if name == "v_z" else np.linspace(lo, hi, 60)
        panels.append(_panel(name, density_histogram(quantities.where(F.col("quantity") == name), "value", list(edges), "source")))
    return panels[0].unionByName(panels[1]).unionByName(panels[2])


def speed_by_rate(steps: DataFrame, census: DataFrame) -> DataFrame:
    """(rate_s, n, v_xy_mps, v_z_mps): mean finite-difference speeds by the flight's whole sampling interval, since differences shrink with it."""
    rate = census.where("dt_s > 0").select(*KEYS, F.rint("dt_s").alias("rate_s"))
    rows = steps.where("dt > 0").join(rate, KEYS)
    return rows.groupBy("rate_s").agg(F.count("*").alias("n"), F.avg(F.col("step_m") / F.col("dt")).alias("v_xy_mps"), F.avg(F.abs("dz") / F.col("dt")).alias("v_z_mps"))


def absent_or_known(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """(source, n_absent, n): counts that are known beforehand, and scanned ones for the other sources."""
    names = ("n_absent", "n")
    joined = scanned.select("source", *[F.col(c).alias(f"{c}_scan") for c in names]).join(known.select("source", *names), "source", "full")
    return joined.select("source", *[F.coalesce(c, f"{c}_scan").alias(c) for c in names])


def flight_reason(duration: Column, path: Column, alt_range: Column, limits: Thresholds) -> Column:
    """Why a flight is cut, or null."""
    f = limits.flight_level
    return F.when(duration < f.min_duration_s, "too_short").when(duration > f.max_duration_s, "too_long").when(path < f.min_path_km, "short_path").when(alt_range < f.min_alt_range_m, "flat")
