"""Segments, frames, uniform grids and smoothing."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from vantrail.config import Thresholds
from vantrail.functions.geo import enu, local_en, trig
from vantrail.session import workers_import
from vantrail.sources.tracks import by_flight

KEYS = ["source", "flight_id"]
SEGMENT = [*KEYS, "segment_id"]


def with_enu(fixes: DataFrame, angles: Callable[[Column], Column] = trig) -> DataFrame:
    """Fixes with east_m and north_m about the flight's first fix, which lies at exactly (0, 0). ``angles`` gives sines and cosines: ``c_trig``
    where last bits count."""
    workers_import(fixes.sparkSession)
    first = lambda c: F.first(c).over(by_flight("fix_no"))
    if angles is not trig:  # once a fix, the origin's among them
        fixes, own = fixes.withColumns({"phi": angles(F.radians("lat")), "lam": angles(F.radians("lon"))}), lambda c, at: F.col({"lat": "phi", "lon": "lam"}[c] + at)
        origin = {"lat0": first("lat"), "lon0": first("lon"), "phi0": first("phi"), "lam0": first("lam")}
    else:
        own, origin = lambda c, at: trig(F.radians(c + at)), {"lat0": first("lat"), "lon0": first("lon")}
    e, n = enu(own("lat", ""), own("lon", ""), own("lat", "0"), own("lon", "0"))
    at_origin = (F.col("lat") == F.col("lat0")) & (F.col("lon") == F.col("lon0"))
    zero = lambda c: F.when(at_origin, 0.0).otherwise(c)
    return fixes.withColumns(origin).withColumns({"east_m": zero(e), "north_m": zero(n)}).drop(*origin, "phi", "lam")


def with_local(fixes: DataFrame) -> DataFrame:
    """Fixes with equirectangular metres about the flight's mean position."""
    mean = lambda c: F.avg(c).over(by_flight())
    x, y = local_en(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return fixes.withColumns({"lat0": mean("lat"), "lon0": mean("lon")}).withColumns({"x_m": x, "y_m": y}).drop("lat0", "lon0")


def gap_bound(dt: Column, limits: Thresholds) -> Column:
    s = limits.sampling
    return F.least(s.max_gap_factor * dt, F.greatest(F.lit(s.max_gap_seconds), s.gap_floor_ratio * dt))


def with_segments(fixes: DataFrame, limits: Thresholds, split: str | None = None) -> DataFrame:
    """Fixes with dt_s (the flight's median interval) and segment_id, from 0: a new one after a gap over the bound or where ``split`` is
    set. Segments keep the flight's clock and origin."""
    w = by_flight("fix_no")
    gaps = fixes.withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("dt_s", F.percentile(F.col("gap"), F.lit(0.5)).over(by_flight()))
    new = F.col("gap") > gap_bound(F.col("dt_s"), limits)
    if split:
        new = new | F.col(split)
    return gaps.withColumn("new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("segment_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("smallint")).drop("new", "gap")


def segment_table(fixes: DataFrame, limits: Thresholds) -> DataFrame:
    """A row a segment: start, end, fixes, the share of its grid that is missing, and whether it passes the gates."""
    s = limits.sampling
    rows = fixes.groupBy(*SEGMENT).agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n_fix"), F.max("dt_s").alias("dt_s"))
    missing = F.when(F.col("dt_s") > 0, F.greatest(F.lit(0.0), 1 - F.col("n_fix") / ((F.col("t_end") - F.col("t_start")) / F.col("dt_s") + 1)))
    rows = rows.withColumn("missing", missing)
    return rows.withColumn("passes", F.coalesce((F.col("missing") <= s.max_missing_fraction) & (F.col("t_end") - F.col("t_start") >= s.min_segment_duration_s), F.lit(False)))


def _intervals(rows: DataFrame, keys: list[str], values: list[str], dt: Column, closed: bool) -> DataFrame:
    """Each row with the next one and the grid numbers of its interval: as-of fill without a join."""
    w = Window.partitionBy(*keys).orderBy("t")
    rows = rows.withColumn("t0", F.min("t").over(Window.partitionBy(*keys))).withColumn("t_next", F.lead("t").over(w)).withColumn("step", dt)
    rows = rows.withColumns({f"{v}_next": F.lead(v).over(w) for v in values}).where(F.col("step") > 0)
    k0 = F.ceil((F.col("t") - F.col("t0")) / F.col("step"))
    k1 = F.ceil((F.col("t_next") - F.col("t0")) / F.col("step")) - 1
    last = F.when((F.col("t") - F.col("t0")) == k0 * F.col("step"), k0) if closed else F.lit(None).cast("bigint")
    return rows.withColumn("k0", k0).withColumn("k1", F.when(F.col("t_next").isNull(), last).otherwise(k1))


def linear_grid(rows: DataFrame, keys: list[str], values: list[str], dt: Column, closed: bool = True) -> DataFrame:
    """(keys, k, t, values) on the grid t0 + k dt, linear between neighbours. ``closed`` keeps a grid point that meets the
    last time; an open grid ends before it. Rows of one key have distinct times (merge duplicates first)."""
    spans = _intervals(rows, keys, values, dt, closed)
    grid = spans.where(F.col("k1") >= F.col("k0")).withColumn("k", F.explode(F.sequence("k0", "k1")))
    t = F.col("t0") + F.col("k") * F.col("step")
    part = F.when(F.col("t_next").isNull(), 0.0).otherwise((t - F.col("t")) / (F.col("t_next") - F.col("t")))
    return grid.select(*keys, "k", t.alias("grid_t"), *[(F.col(v) + F.coalesce(part * (F.col(f"{v}_next") - F.col(v)), F.lit(0.0))).alias(v) for v in values])


def native_grid(fixes: DataFrame, limits: Thresholds | None = None) -> DataFrame:
    """(segment, k, grid_t, east_m, north_m, alt, interpolated) on each segment's native grid: shape-preserving cubic Hermite for the
    positions, linear for the altitude; measured where a fix lies within half a step. With ``limits`` null altitudes are filled from the
    nearest ones before and after where these are no further apart than the gap bound, and marked interpolated. Needs segment_id,
    dt_s, east_m, north_m, alt."""
    w = Window.partitionBy(*SEGMENT).orderBy("t")
    rows = fixes
    h, h_before = F.lead("t").over(w) - F.col("t"), F.col("t") - F.lag("t").over(w)
    rows = rows.withColumns({"h": h, "hb": h_before})
    for v in ("east_m", "north_m"):
        rows = rows.withColumn(f"{v}_d", (F.lead(v).over(w) - F.col(v)) / F.col("h")).withColumn(f"{v}_db", F.lag(f"{v}_d").over(w))
        rows = rows.withColumns({f"{v}_dn": F.lead(f"{v}_d").over(w), f"{v}_dbb": F.lag(f"{v}_db").over(w)})
    rows = rows.withColumns({"hn": F.lead("h").over(w), "hbb": F.lag("hb").over(w)})
    for v in ("east_m", "north_m"):
        d, db = F.col(f"{v}_d"), F.col(f"{v}_db")
        w1, w2 = 2 * F.col("h") + F.col("hb"), F.col("h") + 2 * F.col("hb")
        inner = F.when(d * db <= 0, 0.0).otherwise((w1 + w2) / (w1 / db + w2 / d))
        first = _end_slope(F.col("h"), F.col("hn"), d, F.col(f"{v}_dn"))
        last = _end_slope(F.col("hb"), F.col("hbb"), db, F.col(f"{v}_dbb"))
        slope = F.when(db.isNull() & d.isNull(), 0.0).when(db.isNull(), first).when(d.isNull(), last).otherwise(inner)
        rows = rows.withColumn(f"{v}_m", slope)
    values = ["east_m", "north_m", "alt", "east_m_m", "north_m_m"]
    own = ["alt_t", "alt_a", "alt_b", "t_a", "t_b"]
    before, after = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("alt_t", F.when(F.col("alt").isNotNull(), F.col("t")))
    rows = rows.withColumns({"alt_a": F.last("alt", True).over(before), "t_a": F.last("alt_t", True).over(before), "alt_b": F.first("alt", True).over(after), "t_b": F.first("alt_t", True).over(after)})
    spans = _intervals(rows.select(*SEGMENT, "t", "dt_s", *values, *own), SEGMENT, values, F.col("dt_s"), True)
    grid = spans.where(F.col("k1") >= F.col("k0")).withColumn("k", F.explode(F.sequence("k0", "k1")))
    t = F.col("t0") + F.col("k") * F.col("step")
    wide = F.col("t_next") - F.col("t")
    u = F.when(F.col("t_next").isNull(), 0.0).otherwise((t - F.col("t")) / wide)

    def hermite(v: str) -> Column:
        a, b, m, q = F.col(v), F.col(f"{v}_next"), F.col(f"{v}_m"), F.col(f"{v}_m_next")
        cubic = (1 + 2 * u) * (1 - u) * (1 - u) * a + u * (1 - u) * (1 - u) * wide * m + u * u * (3 - 2 * u) * b + u * u * (u - 1) * wide * q
        return F.when(F.col("t_next").isNull(), a).otherwise(cubic)

    linear = F.col("alt") + F.coalesce(u * (F.col("alt_next") - F.col("alt")), F.lit(0.0))
    far = F.least(t - F.col("t"), F.coalesce(F.col("t_next") - t, t - F.col("t")))
    filled = far > F.col("step") / 2
    if limits is not None:
        over = F.col("alt_a") + (t - F.col("t_a")) / (F.col("t_b") - F.col("t_a")) * (F.col("alt_b") - F.col("alt_a"))
        short = F.col("t_b") - F.col("t_a") <= gap_bound(F.col("dt_s"), limits)
        nearest = F.when(F.col("t_next") - t < t - F.col("t"), F.col("alt_next")).otherwise(F.col("alt"))
        linear, filled = F.coalesce(F.when(t == F.col("t_a"), F.col("alt_a")), F.when(short, over), linear), filled | nearest.isNull()
    return grid.select(*SEGMENT, "k", t.alias("grid_t"), "dt_s", hermite("east_m").alias("east_m"), hermite("north_m").alias("north_m"), linear.alias("alt"), filled.alias("interpolated"))


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """The three-point slope at an end, kept from changing sign or overshooting; a lone interval takes its secant."""
    three = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    kept = F.when(three * d0 <= 0, 0.0).when((d0 * d1 <= 0) & (F.abs(three) > 3 * F.abs(d0)), 3 * d0).otherwise(three)
    return F.when(d1.isNull(), d0).otherwise(kept)


@lru_cache(maxsize=64)
def savgol_weights(window: int, order: int, at: int, derivative: int) -> tuple[float, ...]:
    """Weights of the least-squares polynomial of a window, its derivative taken at position ``at`` of it; unit step."""
    x = np.arange(window) - at
    powers = np.vander(x, order + 1, increasing=True)
    return tuple(float(v) for v in np.linalg.pinv(powers)[derivative] * [1, 1, 2][derivative])


@lru_cache(maxsize=4096)
def _weights(window: int, order: int, at: int, derivative: int) -> np.ndarray:
    return np.array(savgol_weights(window, order, at, derivative))


def savgol5(grid: DataFrame, value: str, keys: list[str], step: Column, order: str = "k") -> DataFrame:
    """Position, velocity and acceleration by a five-point cubic; near the ends of a segment the cubic of its first or last window is
    evaluated off its centre. Segments below five points have nulls."""
    w = Window.partitionBy(*keys).orderBy(order)
    n, i = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(w) - 1
    rows = grid.withColumns({"n_grid": n, "i_grid": i})
    whole = w.rowsBetween(-4, 4)
    rows = rows.withColumn("near", F.collect_list(value).over(whole)).withColumn("first_near", F.greatest(F.col("i_grid") - 4, F.lit(0)))
    start = F.least(F.greatest(F.col("i_grid") - 2, F.lit(0)), F.col("n_grid") - 5)
    at = F.col("i_grid") - start
    points = [F.get(F.col("near"), (start - F.col("first_near") + j).cast("int")) for j in range(5)]
    out = {}
    for d, name in enumerate(("pos", "vel", "acc")):
        value_at = F.when(F.lit(False), 0.0)
        for a in range(5):
            weights = savgol_weights(5, 3, a, d)
            total = sum((float(weights[j]) * points[j] for j in range(1, 5)), float(weights[0]) * points[0])
            value_at = value_at.when(at == a, total)
        out[f"{value}_{name}"] = F.when(F.col("n_grid") >= 5, value_at / F.pow(step, d))
    return rows.withColumns(out).drop("near", "first_near", "n_grid", "i_grid")


def window_for(tau: float, dt: float, least: int = 5) -> int:
    n = int(np.ceil(tau / dt))
    return max(n + (n % 2 == 0), least)


def savgol(values: np.ndarray, dt: float, window: int, order: int = 3) -> np.ndarray:
    """(3, n): position, velocity and acceleration for any odd window; nothing for fewer points than a window."""
    values = np.asarray(values, dtype=float)
    out = np.full((3, len(values)), np.nan)
    if len(values) < window:
        return out
    half = window // 2
    blocks = np.lib.stride_tricks.sliding_window_view(values, window)
    for d in range(3):
        out[d, half : len(values) - half] = blocks @ _weights(window, order, half, d)
        for j in range(half):
            out[d, j] = values[:window] @ _weights(window, order, j, d)
            out[d, len(values) - 1 - j] = values[-window:] @ _weights(window, order, window - 1 - j, d)
        out[d] /= dt**d
    return out


def savgol_column(values: Column, dt: Column, window: Column, order: int = 3) -> Column:
    """[position, velocity, acceleration] of an array column under any odd window, in Arrow batches."""

    @pandas_udf("array<array<double>>")
    def run(series: pd.Series, step: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([list(savgol(np.asarray(v, dtype=float), float(d), int(w), order)) for v, d, w in zip(series, step, width, strict=True)])

    return run(values, dt, window)


def smooth(grid: DataFrame, limits: Thresholds, values: tuple[str, ...] = ("east_m", "north_m", "alt")) -> DataFrame:
    """The grid with position, velocity and acceleration of each value ({value}_pos, _vel, _acc), smoothed within each segment; the window
    is the channel's noise time in grid steps, odd, and at least window_min. The altitude's time is that of its source where the grid has
    alt_source, and of the barometer else. Null where a window meets a null or does not fit."""
    workers_import(grid.sparkSession)
    s = limits.savgol
    gnss = F.col("alt_source") == "gnss" if "alt_source" in grid.columns else F.lit(False)
    vertical = F.when(gnss, s.tau_c_vertical_gnss_s).otherwise(s.tau_c_vertical_baro_s)

    def window(value: str) -> Column:
        n = F.ceil((vertical if value == "alt" else F.lit(s.tau_c_horizontal_s)) / F.col("dt_s"))
        return F.greatest(n + F.when(n % 2 == 0, 1).otherwise(0), F.lit(s.window_min))

    flight = [c for c in ("dt_s", "alt_source") if c in grid.columns]
    others = [c for c in grid.columns if c not in SEGMENT and c not in ("k", *flight)]
    rows = grid.groupBy(*SEGMENT).agg(*[F.max(c).alias(c) for c in flight], F.array_sort(F.collect_list(F.struct("k", *others))).alias("rows"))
    rows = rows.withColumns({f"{v}_all": savgol_column(F.col(f"rows.{v}"), F.col("dt_s"), window(v), s.polyorder) for v in values})
    names = {f"{v}_{name}": F.get(F.col(f"{v}_all"), F.lit(d)) for v in values for d, name in enumerate(("pos", "vel", "acc"))}
    rows = rows.withColumns(names).select(*SEGMENT, *flight, F.inline(F.arrays_zip("rows", *names)))  # no point carries its segment's arrays
    smoothed = [F.when(~F.isnan(n), F.col(n)).alias(n) for n in names]
    kept = [F.col(c) if c in flight else F.col(f"rows.{c}").alias(c) for c in grid.columns if c not in SEGMENT]
    return rows.select(*SEGMENT, *kept, *smoothed)
