"""Cleaning rules on fix tables. A rule marks or nulls before it deletes; what is deleted carries a reason until trimming has
settled over which window it is counted."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from vantrail.config import Thresholds
from vantrail.functions.geo import EARTH_RADIUS_M, great_circle_m
from vantrail.session import workers_import
from vantrail.sources.tracks import by_flight, with_steps

KEYS = ["source", "flight_id"]


def with_marks(rows: DataFrame, keys: Sequence[str], reads: Sequence[str], names: Sequence[str], find: Callable[..., Sequence[np.ndarray]]) -> DataFrame:
    """``rows`` with a flag a name: the masks that ``find`` gives for the columns ``reads`` of a group, in order of its fixes. A group is a row of
    arrays on its way, so that a batch of many small ones enters Python at once; what is not read stays outside."""
    workers_import(rows.sparkSession)
    own = ["fix_no", *[c for c in rows.columns if c not in keys and c != "fix_no"]]
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("rows"))

    @pandas_udf("array<int>")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([sum(mask.astype(np.int32) << i for i, mask in enumerate(find(*group))) for group in zip(*columns, strict=True)], dtype=object)

    marks = run(*[F.col(f"rows.{c}") for c in reads])
    flag = lambda m, i: (m.bitwiseAND(F.lit(1 << i)) != 0).alias(names[i])
    both = F.zip_with("rows", "marks", lambda r, m: F.struct(*[r[c].alias(c) for c in own], *[flag(m, i) for i in range(len(names))]))
    return whole.withColumn("marks", marks).select(*keys, F.inline(both)).select(*rows.columns, *names)


def altitude_source(fixes: DataFrame, limits: Thresholds) -> DataFrame:
    """Fixes with alt_source, one a flight, and alt: the barometer where it is present and its range is wide enough, else GNSS."""
    a = limits.alt_channel
    w = by_flight()
    share = F.avg((F.col("baro_alt") != 0).cast("double")).over(w)
    wide = F.max("baro_alt").over(w) - F.min("baro_alt").over(w)
    source = F.when((share >= a.baro_present_frac) & (wide >= a.baro_min_range_m), "baro").otherwise("gnss")
    return fixes.withColumn("alt_source", source).withColumn("alt", F.when(F.col("alt_source") == "baro", F.col("baro_alt")).otherwise(F.col("gnss_alt")))


def merge_duplicates(fixes: DataFrame, counters: tuple[str, ...] = ()) -> DataFrame:
    """One fix a second: the centroid of the positions, the mean of the altitudes that are there (a choice of ours), valid if all are.
    Running counters of removals keep their last value."""
    there = lambda c: F.coalesce(F.avg(F.when(F.col(c) != 0, F.col(c))), F.lit(0.0))
    merged = fixes.groupBy(*KEYS, "t").agg(F.min("fix_no").alias("fix_no"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("valid").alias("valid"), there("baro_alt").alias("baro_alt"), there("gnss_alt").alias("gnss_alt"), F.count("*").alias("n_merged"), *[F.max(c).alias(c) for c in counters])
    return merged


def repair_clock(fixes: DataFrame) -> DataFrame:
    """Fixes with ``kept``: false for those outside a longest non-decreasing run of times. Only flights with a backward step go through
    Python, each with its own few thousand numbers; all others pass."""
    w = by_flight("fix_no")
    marked = fixes.withColumn("back", (F.col("t") < F.lag("t").over(w)).cast("int")).withColumn("back", F.coalesce(F.max("back").over(by_flight()), F.lit(0)))
    bad = with_marks(marked.where("back = 1").drop("back"), KEYS, ["t"], ["kept"], lambda t: [longest_run(t)])
    return marked.where("back = 0").drop("back").withColumn("kept", F.lit(True)).unionByName(bad)


def longest_run(t: np.ndarray) -> np.ndarray:
    """Mask of a longest strictly increasing subsequence, with the fixes next to one of its own at the same time."""
    tails: list[float] = []
    at: list[int] = []
    before = np.full(len(t), -1)
    for i, x in enumerate(t):
        k = bisect_left(tails, x)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(x)
            at.append(i)
        else:
            tails[k], at[k] = x, i
    keep = np.zeros(len(t), dtype=bool)
    i = at[-1] if at else -1
    while i >= 0:
        keep[i] = True
        i = before[i]
    for i in [*range(1, len(t)), *range(len(t) - 1, 0, -1)]:  # a repeated second is merged later, not deleted here
        if t[i] == t[i - 1] and keep[i] != keep[i - 1]:
            keep[i] = keep[i - 1] = True
    return keep


def hampel(fixes: DataFrame, limits: Thresholds, half_window: float | None = None) -> DataFrame:
    """Fixes with resid_m and hampel: far from the median position of the window, measured by its median deviation."""
    f = limits.fix_level
    half = int(f.hampel_window_s if half_window is None else half_window)
    w = by_flight().orderBy("t").rangeBetween(-half, half)
    mid = lambda c: F.percentile(F.col(c), F.lit(0.5)).over(w)
    near = fixes.withColumns({"med_lat": mid("lat"), "med_lon": mid("lon"), "n_near": F.count("*").over(w)})
    near = near.withColumn("resid_m", great_circle_m(F.col("med_lat"), F.col("med_lon"), F.col("lat"), F.col("lon")))
    mad = F.percentile(F.col("resid_m"), F.lit(0.5)).over(w)
    flag = (F.col("n_near") >= f.hampel_min_window_fixes) & (F.col("resid_m") > F.greatest(f.hampel_k * 1.4826 * F.col("mad_m"), F.lit(f.hampel_eps_min_m)))
    return near.withColumn("mad_m", mad).withColumn("hampel", flag).drop("med_lat", "med_lon")


def hampel_altitude(fixes: DataFrame, limits: Thresholds, column: str = "baro_alt", half_window: float | None = None) -> DataFrame:
    """Fixes with alt_hampel: the same test on one altitude column; the flag alone nulls the altitude, in altitude_outliers."""
    f = limits.fix_level
    half = int(f.hampel_window_s if half_window is None else half_window)
    w = by_flight().orderBy("t").rangeBetween(-half, half)
    near = fixes.withColumns({"med_alt": F.percentile(F.col(column), F.lit(0.5)).over(w), "n_near": F.count(column).over(w)})
    near = near.withColumn("alt_resid_m", F.abs(F.col(column) - F.col("med_alt")))
    mad = F.percentile(F.col("alt_resid_m"), F.lit(0.5)).over(w)
    return near.withColumn("alt_mad_m", mad).withColumn("alt_hampel", (F.col("n_near") >= f.hampel_min_window_fixes) & (F.col("alt_resid_m") > F.greatest(f.hampel_k * 1.4826 * F.col("alt_mad_m"), F.lit(f.hampel_eps_min_m)))).drop("med_alt")


def speed_bound(limits: Thresholds) -> Column:
    return F.create_map(*[F.lit(x) for pair in limits.fix_level.max_horizontal_speed_mps.items() for x in pair])[F.col("source")]


def impossible(fixes: DataFrame, limits: Thresholds) -> DataFrame:
    """Fixes with v_in, v_out and spike: flagged by the Hampel test and reached and left faster than the source can fly."""
    w = by_flight("fix_no")
    steps = with_steps(fixes)
    v_in = F.when(F.col("dt") > 0, F.col("step_m") / F.col("dt"))
    steps = steps.withColumn("v_in", v_in).withColumn("v_out", F.lead("v_in").over(w))
    return steps.withColumn("spike", F.coalesce(F.col("hampel") & (F.col("v_in") > speed_bound(limits)) & (F.col("v_out") > speed_bound(limits)), F.lit(False))).drop("dt", "step_m", "dz")


def remove_blocks(fixes: DataFrame, limits: Thresholds) -> DataFrame:
    """Fixes with ``kept`` and ``split_before``: a burst of impossible fixes goes as the smallest block whose ends join at a possible
    speed; where no block that lasts up to block_max_s does, the track is split and nothing goes. Flights without an
    impossible step do not enter Python."""
    steps = with_steps(fixes)
    fast = F.coalesce((F.col("dt") > 0) & (F.col("step_m") / F.col("dt") > speed_bound(limits)), F.lit(False))
    marked = steps.withColumn("fast", F.max(fast.cast("int")).over(by_flight())).drop("dt", "step_m", "dz")
    longest = limits.fix_level.block_max_s
    bounded = marked.where("fast = 1").drop("fast").withColumn("bound", speed_bound(limits))
    bad = with_marks(bounded, KEYS, ["t", "lat", "lon", "bound"], ["kept", "split_before"], lambda t, lat, lon, bound: smallest_blocks(t, lat, lon, bound[0], longest)).drop("bound")
    clean = marked.where("fast = 0").drop("fast").withColumns({"kept": F.lit(True), "split_before": F.lit(False)})
    return clean.unionByName(bad)


def _distance(lat1, lon1, lat2, lon2):
    """Great-circle metres, of numbers or arrays."""
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def smallest_blocks(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, bound: float, longest: float) -> tuple[np.ndarray, np.ndarray]:
    keep, split = np.ones(len(t), dtype=bool), np.zeros(len(t), dtype=bool)
    gap = np.diff(t)
    fast = 1 + np.nonzero((gap > 0) & (_distance(lat[:-1], lon[:-1], lat[1:], lon[1:]) > bound * gap))[0]  # fixes that the one before reaches too fast
    at = 0
    while (k := np.searchsorted(fast, at, "right")) < len(fast):
        i = int(fast[k])
        anchor = i - 1
        ends = np.arange(i + 1, min(len(t), i + 1 + np.searchsorted(t[i:], t[i] + longest, "right")))  # while the block lasts no longer
        wait = t[ends] - t[anchor]
        joins = ends[(wait > 0) & (_distance(lat[anchor], lon[anchor], lat[ends], lon[ends]) <= bound * wait)]
        if len(joins):
            at = int(joins[0])
            keep[i:at] = False
        else:
            at = i
            split[i] = True
    return keep, split


def frozen_runs(fixes: DataFrame, limits: Thresholds) -> DataFrame:
    """Fixes with ``frozen``: inside a maximal stretch of small diameter and long span with a witness that the receiver, not the
    aircraft, stood still: a flat barometer between the medians of the stretch's ends, or identical coordinates (without
    a barometer: fixes marked invalid or without altitude, or identical coordinates). Needs alt_source. Only the stretches of fixes
    that lie in some window of the least span and twice the diameter, next to a short step, go through Python, each on its own."""
    f = limits.fix_level
    w, span = by_flight().orderBy("t"), int(f.frozen_tau_s)

    def small(window: Window) -> Column:
        extent = great_circle_m(F.min("lat").over(window), F.min("lon").over(window), F.max("lat").over(window), F.max("lon").over(window))
        return extent < 2 * f.frozen_eps_m

    # a run of some span has more than one fix, so the step that leads on from its first, or to its last, is short
    by_no = by_flight("fix_no")
    step = great_circle_m(F.lag("lat").over(by_no), F.lag("lon").over(by_no), F.col("lat"), F.col("lon"))
    stepped = fixes.withColumn("short", F.coalesce(step < 2 * f.frozen_eps_m, F.lit(False)))
    leads = F.coalesce(F.lead("short").over(by_no), F.lit(False))
    begins = leads & small(w.rangeBetween(0, span)) & (F.max("t").over(by_flight()) - F.col("t") >= f.frozen_tau_s)
    ends = F.col("short") & small(w.rangeBetween(-span, 0)) & (F.col("t") - F.min("t").over(by_flight()) >= f.frozen_tau_s)
    marked = stepped.withColumns({"begins": begins.cast("int"), "ends": ends.cast("int")})
    still = (F.max("begins").over(w.rangeBetween(-span, 0)) == 1) | (F.max("ends").over(w.rangeBetween(0, span)) == 1)
    marked = marked.withColumn("still", still).drop("begins", "ends", "short")
    marked = marked.withColumn("stretch", F.when(F.col("still") == F.lag("still").over(by_no), 0).otherwise(1)).withColumn("stretch", F.sum("stretch").over(by_no.rowsBetween(Window.unboundedPreceding, 0)))
    diameter, least, flat = f.frozen_eps_m, f.frozen_tau_s, f.frozen_delta_z_m

    def scan(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, baro: np.ndarray, has_baro: np.ndarray, bad: np.ndarray) -> list[np.ndarray]:
        return [frozen_mask(t, lat, lon, baro if has_baro[0] else None, bad, diameter, least, flat)]

    moving = marked.where("not still").drop("still", "stretch").withColumn("frozen", F.lit(False))
    seen = marked.where("still").drop("still").withColumns({"has_baro": F.col("alt_source") == "baro", "bad": ~F.col("valid") | (F.col("gnss_alt") == 0)})
    held = with_marks(seen, [*KEYS, "stretch"], ["t", "lat", "lon", "baro_alt", "has_baro", "bad"], ["frozen"], scan)
    return moving.unionByName(held.select(*moving.columns))


def _last_within(lat: np.ndarray, lon: np.ndarray, i: int, diameter: float) -> int:
    """The last fix of the longest run from i whose bounding box stays below the diameter."""
    end, size = i, 64
    lo_lat = hi_lat = lat[i]
    lo_lon = hi_lon = lon[i]
    while end + 1 < len(lat):
        a, b = lat[end + 1 : end + 1 + size], lon[end + 1 : end + 1 + size]
        south, north = np.minimum(np.minimum.accumulate(a), lo_lat), np.maximum(np.maximum.accumulate(a), hi_lat)
        west, east = np.minimum(np.minimum.accumulate(b), lo_lon), np.maximum(np.maximum.accumulate(b), hi_lon)
        over = np.nonzero(_distance(south, west, north, east) >= diameter)[0]
        if len(over):
            return end + int(over[0])
        end, size = end + len(a), 2 * size
        lo_lat, hi_lat, lo_lon, hi_lon = south[-1], north[-1], west[-1], east[-1]
    return end


def frozen_mask(t, lat, lon, baro, bad, diameter: float, span: float, flat: float) -> np.ndarray:
    out = np.zeros(len(t), dtype=bool)
    i = 0
    while i < len(t) and t[-1] - t[i] >= span:
        j = _last_within(lat, lon, i, diameter)
        if t[j] - t[i] >= span:
            same = _longest_identical(t[i : j + 1], lat[i : j + 1], lon[i : j + 1]) >= span
            end = max(1, min(5, (j - i + 1) // 2))
            still = baro is not None and abs(np.median(baro[i : i + end]) - np.median(baro[j + 1 - end : j + 1])) < flat
            if same or still or (baro is None and bad[i : j + 1].all()):
                out[i : j + 1] = True
            i = j + 1
        else:
            i += 1
    return out


def _longest_identical(t, lat, lon) -> float:
    """Seconds of the longest run of identical coordinates."""
    new = np.concatenate([[True], (lat[1:] != lat[:-1]) | (lon[1:] != lon[:-1])])
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:] - 1, [len(t) - 1]])
    return float((t[last] - t[first]).max())


def identical_runs(fixes: DataFrame, least_s: float = 0.0) -> DataFrame:
    """(flight, run, first_fix, n, span_s) of maximal stretches of more than one fix with identical coordinates."""
    w = by_flight("fix_no")
    new = F.when((F.col("lat") == F.lag("lat").over(w)) & (F.col("lon") == F.lag("lon").over(w)), 0).otherwise(1)
    runs = fixes.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*KEYS, "run").agg(F.min("fix_no").alias("first_fix"), F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span_s"), F.min("baro_alt").alias("baro_min"), F.max("baro_alt").alias("baro_max"))
    return found.where((F.col("n") > 1) & (F.col("span_s") >= least_s))


def bad_altitudes(fixes: DataFrame, limits: Thresholds) -> DataFrame:
    """Fixes with alt nulled outside the band and, on a barometer, where it climbs faster than the bound; positions stay. Needs alt_source and alt."""
    f = limits.fix_level
    w = by_flight("fix_no")
    rate = (F.col("alt") - F.lag("alt").over(w)) / F.nullif(F.col("t") - F.lag("t").over(w), F.lit(0.0))
    steep = F.coalesce((F.col("alt_source") == "baro") & (F.abs(rate) > f.max_vertical_speed_mps), F.lit(False))
    outside = ~F.col("alt").between(f.min_altitude_m, f.max_altitude_m)
    return fixes.withColumn("alt_reason", F.when(outside, "band").when(steep, "steep")).withColumn("alt", F.when(F.col("alt_reason").isNull(), F.col("alt")))


def altitude_outliers(fixes: DataFrame, limits: Thresholds) -> DataFrame:
    """Fixes with alt nulled where the altitude Hampel test flags the adopted channel; positions stay. Needs alt and alt_reason, so that
    values outside the bounds do not enter the medians."""
    flagged = F.coalesce(F.col("alt_hampel"), F.lit(False))
    seen = hampel_altitude(fixes, limits, "alt").withColumn("alt_reason", F.coalesce("alt_reason", F.when(flagged, "hampel")))
    return seen.withColumn("alt", F.when(~flagged, F.col("alt"))).drop("n_near", "alt_resid_m", "alt_mad_m", "alt_hampel")


def trim_window(fixes: DataFrame, limits: Thresholds) -> DataFrame:
    """(flight, t_on, t_off, reason): from the first start to the last end of a run faster than v_on that lasts long enough;
    no such run is a reason to discard."""
    tr = limits.trimming
    w = by_flight("fix_no")
    steps = with_steps(fixes).withColumn("moving", F.coalesce((F.col("dt") > 0) & (F.col("step_m") / F.col("dt") > tr.takeoff_speed_mps), F.lit(False)))
    new = F.when(F.col("moving") == F.lag("moving").over(w), 0).otherwise(1)
    steps = steps.withColumn("t_before", F.coalesce(F.lag("t").over(w), F.col("t"))).withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = steps.groupBy(*KEYS, "run").agg(F.min("moving").alias("moving"), F.min("t_before").alias("t0"), F.max("t").alias("t1"))
    holds = F.col("moving") & (F.col("t1") - F.col("t0") >= tr.sustained_s)
    window = runs.groupBy(*KEYS).agg(F.min(F.when(holds, F.col("t0"))).alias("t_on"), F.max(F.when(holds, F.col("t1"))).alias("t_off"))
    return window.withColumn("reason", F.when(F.col("t_on").isNull(), "never_moves"))


def interior_ground(fixes: DataFrame, limits: Thresholds) -> DataFrame:
    """(flight, t0, t1, kind): slow stretches whose altitude stays within the bound (inclusive, a choice of ours); long ones are
    ``ground``, to be cut out, the shorter ones ``suspect``."""
    tr = limits.trimming
    w = by_flight("fix_no")
    steps = with_steps(fixes).withColumn("slow", F.coalesce((F.col("dt") > 0) & (F.col("step_m") / F.col("dt") < tr.takeoff_speed_mps), F.lit(False)))
    new = F.when(F.col("slow") == F.lag("slow").over(w), 0).otherwise(1)
    steps = steps.withColumn("t_before", F.coalesce(F.lag("t").over(w), F.col("t"))).withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = steps.where("slow").groupBy(*KEYS, "run").agg(F.min("t_before").alias("t0"), F.max("t").alias("t1"), (F.max("baro_alt") - F.min("baro_alt")).alias("alt_range"))
    kind = F.when(F.col("t1") - F.col("t0") >= tr.interior_ground_s, "ground").otherwise("suspect")
    return runs.where(F.col("alt_range") <= tr.ground_flatness_m).select(*KEYS, "t0", "t1", kind.alias("kind"))


def removed(fixes: DataFrame, gone: Column, counter: str) -> DataFrame:
    """``fixes`` without those that are gone; those that stay carry in ``counter`` how many of the flight have gone before them."""
    upto = by_flight("fix_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return fixes.withColumn(counter, F.sum(gone.cast("bigint")).over(upto)).where(~gone)


def airborne_counts(fixes: DataFrame, counters: tuple[str, ...]) -> DataFrame:
    """Trimmed fixes, each counter now what its rule removed between the flight's first and last, with nulled_alt, and n_airborne, the
    fixes there were before removal."""
    w = by_flight()
    counts = {c: F.max(c).over(w) - F.min(c).over(w) for c in counters}
    nulled = F.sum(F.col("alt_reason").isNotNull().cast("bigint")).over(w)
    return fixes.withColumns({"n_airborne": F.count("*").over(w) + sum(counts.values(), F.lit(0)), "nulled_alt": nulled, **counts})


def removal_passes(removed: Column, n: Column, limits: Thresholds) -> Column:
    return removed / n <= limits.fix_level.integrity_max_fraction


def removal_counts(fixes: DataFrame, reason: str, limits: Thresholds) -> DataFrame:
    """(flight, n, removed, passes, one count a reason): the gate on the share a flight loses."""
    counts = fixes.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(F.col(reason).isNotNull().cast("bigint")).alias("removed"))
    return counts.withColumn("passes", removal_passes(F.col("removed"), F.col("n"), limits))


def ground_overlap(phases: DataFrame, suspects: DataFrame) -> DataFrame:
    """Phases (flight, t0, t1) that overlap a suspect interval (flight, t0, t1)."""
    s = suspects.select(*KEYS, F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    return phases.join(s, KEYS).where((F.col("t0") < F.col("s1")) & (F.col("s0") < F.col("t1")))
