"""The seven-stage cleaning plan: altitude channel, fixes (clock, duplicates, spikes, frozen fixes, altitudes), trimming, flight cuts
with the integrity gate, local frame, segments and native grids, smoothing with derivatives. Every stage is a function from
DataFrame to DataFrame; nothing is collected."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantrail.config import Thresholds
from vantrail.functions.geo import great_circle_m
from vantrail.operators import census, clean, resample
from vantrail.session import written
from vantrail.sources.tracks import by_flight

KEYS = ["source", "flight_id"]
#: Running counts of the fixes that a rule has removed.
COUNTERS = ("removed_clock", "removed_spike", "removed_block", "removed_frozen")


class Cleaned(NamedTuple):
    fixes: DataFrame
    segments: DataFrame
    flights: DataFrame


def clean_tracks(fixes: DataFrame, limits: Thresholds, interpolate: bool = True, cut: Callable[[DataFrame], DataFrame] = written) -> Cleaned:
    """``fixes`` on native grids, smoothed, one row a segment, and one row a flight with the reason it was cut, if it was, and what each
    rule removed or nulled of its airborne fixes. Without ``interpolate`` the fixes of the segments as they are.

    A segment has the share of its grid that is interpolated and whether it is cut off at its start and its end by a split, so that a
    phase there is censored. A flight has its origin, its signal's and its own time and its interval. What more than one branch reads,
    such as the fixes that a rule sends to Python or passes, is written once by ``cut``, or every branch would plan and run all before it."""
    raw = fixes.groupBy(*KEYS).agg(F.count("*").alias("n_raw"))
    fixes = clean.removed(clean.repair_clock(fixes), ~F.col("kept"), "removed_clock").drop("kept")
    fixes = cut(clean.merge_duplicates(fixes, ("removed_clock",)).drop("n_merged"))
    fixes = clean.altitude_source(clean.hampel(fixes, limits), limits)
    fixes = cut(clean.removed(clean.impossible(fixes, limits), F.col("spike"), "removed_spike").drop("spike", "hampel", "resid_m", "mad_m", "n_near", "v_in", "v_out"))
    fixes = cut(clean.removed(clean.remove_blocks(fixes, limits), ~F.col("kept"), "removed_block").drop("kept"))
    fixes = clean.frozen_runs(fixes, limits)
    after = F.lag("frozen").over(by_flight("fix_no"))
    fixes = fixes.withColumn("split_before", F.col("split_before") | (F.coalesce(after, F.lit(False)) & ~F.col("frozen")))
    fixes = clean.removed(fixes, F.col("frozen"), "removed_frozen").drop("frozen")
    fixes = cut(clean.altitude_outliers(clean.bad_altitudes(fixes, limits), limits))
    window = cut(clean.trim_window(fixes, limits))
    ground = clean.interior_ground(fixes, limits).where("kind = 'ground'").groupBy(*KEYS).agg(F.collect_list(F.struct("t0", "t1")).alias("ground"))
    fixes = fixes.join(window, KEYS).join(ground, KEYS, "left").where(F.col("reason").isNull() & F.col("t").between(F.col("t_on"), F.col("t_off")))
    fixes = clean.airborne_counts(fixes, COUNTERS)
    inside = F.coalesce(F.exists("ground", lambda g: (F.col("t") > g["t0"]) & (F.col("t") < g["t1"])), F.lit(False))
    landed = F.coalesce(F.exists("ground", lambda g: F.col("t") == g["t1"]), F.lit(False))
    fixes = cut(fixes.withColumn("split_before", F.col("split_before") | landed).where(~inside).drop("ground", "t_on", "t_off", "reason"))
    w = by_flight("fix_no")
    step = great_circle_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    flights = fixes.withColumn("step", step).groupBy(*KEYS).agg(F.count("*").alias("n_clean"), (F.max("t") - F.min("t")).alias("duration_s"), (F.sum("step") / 1000).alias("path_km"), (F.max("alt") - F.min("alt")).alias("alt_range_m"), F.first("alt_source").alias("alt_source"), F.min_by(F.struct("lat", "lon", "alt"), "fix_no").alias("origin"), *[F.first(c).alias(c) for c in ("n_airborne", *COUNTERS, "nulled_alt")])
    flights = raw.join(flights, KEYS, "left").join(window.select(*KEYS, "t_on", "t_off", "reason"), KEYS, "left")
    short = census.flight_reason(F.col("duration_s"), F.col("path_km"), F.col("alt_range_m"), limits)
    changed = sum((F.col(c) for c in COUNTERS), F.col("nulled_alt"))
    rebuilt = F.when(~clean.removal_passes(changed, F.col("n_airborne"), limits), "removed_fraction")
    flights = cut(flights.withColumn("reason", F.coalesce("reason", rebuilt, short)))
    kept = fixes.join(flights.where(F.col("reason").isNull()).select(*KEYS), KEYS, "left_semi")
    placed = cut(resample.with_segments(resample.with_enu(kept), limits, "split_before"))
    segments = resample.segment_table(placed, limits)
    good = placed.join(segments.where("passes").select(*resample.SEGMENT), resample.SEGMENT, "left_semi")
    grid = cut(resample.native_grid(good, limits))
    filled = grid.groupBy(*resample.SEGMENT).agg(F.avg(F.col("interpolated").cast("double")).alias("frac_interpolated"))
    last = F.max("segment_id").over(Window.partitionBy(*KEYS))
    segments = segments.withColumns({"cut_start": F.col("segment_id") > 0, "cut_end": F.col("segment_id") < last}).join(filled, resample.SEGMENT, "left")
    interval = placed.groupBy(*KEYS).agg(F.max("dt_s").alias("dt_native_s"))
    flights = flights.join(interval, KEYS, "left").select("*", F.col("origin.lat").alias("lat0"), F.col("origin.lon").alias("lon0"), F.col("origin.alt").alias("alt0")).drop("origin")
    if interpolate:
        good = resample.smooth(grid.join(flights.select(*KEYS, "alt_source"), KEYS), limits)
    return Cleaned(good, segments, flights)
