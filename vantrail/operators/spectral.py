"""Power spectra of uniformly sampled channels, and their ensembles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from vantrail.functions.geo import local_en
from vantrail.operators.ranks import exact_quantiles
from vantrail.operators.resample import KEYS, linear_grid
from vantrail.session import workers_import, written

#: Samples of a segment, the band whose median is the noise floor, and the factor over it at the knee.
NPERSEG, FLOOR_BAND, KNEE_FACTOR = 256, (0.35, 0.5), 3.0


def welch(x: np.ndarray, fs: float, nperseg: int = NPERSEG) -> np.ndarray:
    """One-sided density: half-overlapping segments, straight line removed, periodic Hann window, averaged."""
    x = np.asarray(x, dtype=float)
    n = min(nperseg, len(x))
    if n < 1:
        return np.empty(0)
    segments = np.lib.stride_tricks.sliding_window_view(x, n)[:: max(1, n - n // 2)]
    i = np.arange(n) - (n - 1) / 2
    flat = segments - segments.mean(axis=1, keepdims=True)
    if n > 1:
        flat = flat - np.outer(flat @ i / (i @ i), i)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
    power = np.abs(np.fft.rfft(flat * window, axis=1)) ** 2 / (fs * (window**2).sum())
    power[:, 1 : len(power[0]) - (n % 2 == 0)] *= 2
    return power.mean(axis=0)


def welch_column(values: Column, fs: Column | float, nperseg: int = NPERSEG) -> Column:
    """The density of an array column, in Arrow batches; null or shorter than two samples gives null."""

    @pandas_udf("array<double>")
    def run(series: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or len(v) < 2 else welch(np.asarray(v, dtype=float), float(r), nperseg) for v, r in zip(series, rate, strict=True)])

    return run(values.cast("array<double>"), F.lit(fs) if not isinstance(fs, Column) else fs)


def ensemble(spectra: DataFrame, bins: int, pxx: str, at: Sequence[float] = (0.1, 0.5, 0.9), groups: Sequence[str] = ("discipline", "channel"), pool: str | None = None) -> DataFrame:
    """(groups, k, n, mean, q_*) over curves of exactly ``bins`` values; others are left out, whatever comes first. With ``pool``, rows
    that sum over that group have it null. Values are counted and ranked in ranges, so no task holds a bin's values of all curves."""
    curves = spectra.where(F.size(pxx) == bins).select(*groups, F.posexplode(pxx).alias("k", "v"))

    def over(keys: list[str]) -> DataFrame:
        means = curves.groupBy(*keys).agg(F.avg("v").alias("mean"))
        return exact_quantiles(curves, "v", at, keys).join(means, keys).select(*keys, "n", "mean", *[F.get("xs", F.lit(i)).alias(f"q_{round(100 * q)}") for i, q in enumerate(at)])

    found = over([*groups, "k"])
    if pool is not None:
        pooled = over([*[g for g in groups if g != pool], "k"]).withColumn(pool, F.lit(None).cast(curves.schema[pool].dataType))
        found = found.unionByName(pooled)
    return found


def knee(curve: DataFrame, f: str, pxx: str, *groups: str, band: tuple[float, float] = FLOOR_BAND, factor: float = KNEE_FACTOR) -> DataFrame:
    """(groups, floor, f_c, tau): the floor is the median over the band, the knee the lowest frequency above 0 at most ``factor`` floors high."""
    floor = curve.where(F.col(f).between(*band)).groupBy(*groups).agg(F.median(pxx).alias("floor"))
    joined = curve.join(floor, list(groups)) if groups else curve.crossJoin(F.broadcast(floor))  # one row
    low = joined.groupBy(*groups).agg(F.max("floor").alias("floor"), F.min(F.when((F.col(f) > 0) & (F.col(pxx) <= factor * F.col("floor")), F.col(f))).alias("f_c"))
    return low.withColumn("tau", 1 / F.col("f_c"))


def eligible(census: DataFrame, modal: DataFrame, tolerance: float = 0.25, least: int = NPERSEG, present: float = 0.5) -> DataFrame:
    """Flights whose spectra are pooled: barometer present, sampling near the modal interval, enough fixes."""
    near = census.crossJoin(F.broadcast(modal))  # one row
    return near.where((F.col("n_fix") >= least) & (F.col("baro_present_frac") >= present) & (F.abs(F.col("dt_s") - F.col("modal_dt_s")) <= tolerance)).drop("modal_dt_s")


def channel_spectra(fixes: DataFrame, channels: dict[str, Column], step: Column, nperseg: int, closed: bool) -> DataFrame:
    """(source, flight_id, channel, pxx): each channel of each flight put on a uniform grid of ``step`` seconds, and its density. Flights whose
    grid is shorter than a segment are left out. ``step`` reads columns of the fixes that are the same throughout a flight."""
    workers_import(fixes.sparkSession)
    rows = fixes.select(*KEYS, "t", step.alias("every"), *[c.alias(n) for n, c in channels.items()])
    merged = rows.groupBy(*KEYS, "t").agg(F.max("every").alias("every"), *[F.avg(n).alias(n) for n in channels])
    grid = linear_grid(merged.withColumn("own_step", F.col("every")), [*KEYS, "own_step"], list(channels), F.col("every"), closed)
    flat = grid.groupBy(*KEYS, "own_step").agg(F.array_sort(F.collect_list(F.struct("k", *channels))).alias("rows")).where(F.size("rows") >= nperseg)
    named = flat.select(*KEYS, "own_step", F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(f"rows.{n}").alias("x")) for n in channels])).alias("c"))
    return named.select(*KEYS, "c.channel", welch_column(F.col("c.x"), 1 / F.col("own_step"), nperseg).alias("pxx"))


def altitude_spectra(fixes: DataFrame, census: DataFrame, modal: DataFrame, tolerance: float = 0.25, least: int = NPERSEG, nperseg: int = NPERSEG) -> DataFrame:
    """(source, flight_id, channel, pxx) of both altitudes of the eligible flights, on grids of the modal interval: ``modal``, one row, comes
    from a first pass over the census, so all spectra have the same frequencies."""
    flights = eligible(census, modal, tolerance, least).select(*KEYS)
    chosen = fixes.join(flights, KEYS, "left_semi").crossJoin(F.broadcast(modal))  # one row
    return channel_spectra(chosen, {"baro": F.col("baro_alt"), "gnss": F.col("gnss_alt")}, F.col("modal_dt_s"), nperseg, True)


def noise_panel(fixes: DataFrame, flights: DataFrame, window_s: float = 1800.0) -> DataFrame:
    """(source, flight_id, t, baro_alt, gnss_alt, offset_m) over the first ``window_s`` seconds of the flight of the most fixes, the first source
    and id of several; the offset is GNSS over barometer without its mean."""
    one = flights.orderBy(F.desc("n_fix"), *KEYS).limit(1).select(*KEYS)
    rows = fixes.join(F.broadcast(one), KEYS, "left_semi")
    first = rows.agg(F.min("t").alias("t0"))
    rows = rows.crossJoin(F.broadcast(first)).where(F.col("t") <= F.col("t0") + window_s)  # one flight's window
    offset = F.col("gnss_alt") - F.col("baro_alt")
    mean = rows.agg(F.avg(offset).alias("mean"))
    return rows.crossJoin(F.broadcast(mean)).select(*KEYS, "fix_no", (F.col("t") - F.col("t0")).alias("t"), "baro_alt", "gnss_alt", (offset - F.col("mean")).alias("offset_m"))


def timescales(fixes: DataFrame, census: DataFrame, cadence: float = 1.0, tolerance: float = 0.25, sample: int | None = 900, seed: int = 42, nperseg: int = NPERSEG, least: int = NPERSEG) -> DataFrame:
    """(channel, n_flights, floor, f_c, tau, tau_p90): the knee of the median spectrum of each channel, and of its 90th percentile, over a
    seeded sample of flights a source, or all of them where ``sample`` is None, that sampled near ``cadence``. East and north are one channel; a flight gives the altitude of the
    barometer where that is present, and of GNSS else."""
    from pyspark.sql import Window

    if sample is not None:
        drawn = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("flight_id", F.lit(seed)), "flight_id"))
        census = census.withColumn("drawn", drawn).where(F.col("drawn") <= sample).drop("drawn")
    chosen = census.where((F.col("n_fix") >= least) & (F.abs(F.col("dt_s") - cadence) <= tolerance))
    rows = fixes.join(chosen.select(*KEYS, (F.col("baro_present_frac") >= 0.5).alias("has_baro")), KEYS)
    of_flight = Window.partitionBy(*KEYS)
    east, north = local_en(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    rows = rows.withColumns({"lat0": F.avg("lat").over(of_flight), "lon0": F.avg("lon").over(of_flight)}).withColumns({"east": east, "north": north, "up": F.when(F.col("has_baro"), F.col("baro_alt")).otherwise(F.col("gnss_alt"))})
    spectra = channel_spectra(rows, {c: F.col(c) for c in ("east", "north", "up")}, F.lit(cadence), nperseg, False)
    spectra = spectra.join(chosen.select(*KEYS, "baro_present_frac"), KEYS)
    vertical = F.when(F.col("baro_present_frac") >= 0.5, "vertical_baro").otherwise("vertical_gnss")
    spectra = written(spectra.withColumn("channel", F.when(F.col("channel") == "up", vertical).otherwise("horizontal")))
    counts = spectra.groupBy("channel").agg(F.count_distinct(*KEYS).alias("n_flights"))
    curve = written(ensemble(spectra, nperseg // 2 + 1, "pxx", [0.5, 0.9], ["channel"]).withColumn("f", F.col("k") / (nperseg * cadence)))
    band = (FLOOR_BAND[0] / cadence, FLOOR_BAND[1] / cadence)
    middle = knee(curve, "f", "q_50", "channel", band=band)
    noisy = knee(curve, "f", "q_90", "channel", band=band).select("channel", F.col("tau").alias("tau_p90"))
    return counts.join(middle, "channel").join(noisy, "channel")
