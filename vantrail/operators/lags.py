"""Lags in time: time-averaged displacement and velocity correlation of segments on their grids, at every lag in n log n.

A segment's sum of squared displacements at lag m is sum |r_i|^2 + |r_(i+m)|^2 - 2 r_i . r_(i+m): the first part are prefix sums,
the second an autocorrelation, which two Fourier transforms give for all lags at once. Pairs never leave their segment. Sums
and counts of a flight's segments are added lag by lag, so a flight's average weighs every pair alike.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from vantrail.session import workers_import

KEYS = ["source", "flight_id"]
SEGMENT = [*KEYS, "segment_id"]


def autocorrelation_sums(x: np.ndarray) -> np.ndarray:
    """Of each row: the sums of x_i x_(i+m) over i, for m from 0 to n - 1."""
    n = x.shape[-1]
    size = 1 << max(1, 2 * n - 1).bit_length()
    power = np.abs(np.fft.rfft(x, size)) ** 2
    return np.fft.irfft(power, size)[..., :n]


def displacement_sums(east: np.ndarray, north: np.ndarray) -> np.ndarray:
    """The sums of squared displacements at lags 0 to n - 1; n - m pairs have lag m."""
    r = np.array([east, north], dtype=float)
    if not r.shape[1]:
        return np.empty(0)
    r -= r.mean(axis=1, keepdims=True)  # displacements stay, and the numbers that cancel are smaller
    squares = (r * r).sum(axis=0)
    upto = np.concatenate([[0.0], np.cumsum(squares)])
    n = len(squares)
    m = np.arange(n)
    sums = upto[n - m] + upto[n] - upto[m] - 2 * autocorrelation_sums(r).sum(axis=0)
    sums[0] = 0.0
    return np.maximum(sums, 0.0)


def _lagged(grid: DataFrame, values: Sequence[str], run) -> DataFrame:
    """(segment, dt_s, n, sums): ``run`` over the segment's values in the order of k. A segment fits in a row."""
    workers_import(grid.sparkSession)
    rows = grid.groupBy(*SEGMENT).agg(F.max("dt_s").alias("dt_s"), F.array_sort(F.collect_list(F.struct("k", *values))).alias("rows"))

    @pandas_udf("array<double>")
    def sums(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([run(np.asarray(a, dtype=float), np.asarray(b, dtype=float)) for a, b in zip(first, second, strict=True)])

    return rows.select(*SEGMENT, "dt_s", F.size("rows").alias("n"), sums(*[F.col(f"rows.{v}") for v in values]).alias("sums"))


def _by_flight(whole: DataFrame, lags: Sequence[int] | None, name: str) -> DataFrame:
    if lags is None:
        spread = whole.select(*KEYS, "dt_s", "n", F.posexplode("sums").alias("lag", "total"))
    else:
        wanted = F.array(*[F.struct(F.lit(int(m)).alias("lag"), F.get("sums", F.lit(int(m))).alias("total")) for m in lags])
        spread = whole.select(*KEYS, "dt_s", "n", F.inline(wanted)).where(F.col("total").isNotNull())
    found = spread.groupBy(*KEYS, "lag").agg(F.max("dt_s").alias("dt_s"), F.sum(F.col("n") - F.col("lag")).alias("n"), F.sum("total").alias("total"))
    return found.select(*KEYS, "lag", (F.col("lag") * F.col("dt_s")).alias("lag_s"), "n", (F.col("total") / F.col("n")).alias(name))


def time_averaged_msd(grid: DataFrame, lags: Sequence[int] | None = None) -> DataFrame:
    """(source, flight_id, lag, lag_s, n, tamsd): the mean square displacement over all pairs of grid points of one segment that are ``lag`` steps
    apart; all lags there are where none are named. ``grid`` has segment, k, dt_s (one a flight), east_m and north_m, without gaps."""
    return _by_flight(_lagged(grid, ["east_m", "north_m"], displacement_sums), lags, "tamsd")


def velocity_autocorrelation(grid: DataFrame, lags: Sequence[int] | None = None, vx: str = "vx", vy: str = "vy") -> DataFrame:
    """(source, flight_id, lag, lag_s, n, vacf): the mean of v(t) . v(t + lag) over the pairs of each flight's segments."""
    return _by_flight(_lagged(grid, [vx, vy], lambda x, y: autocorrelation_sums(np.array([x, y])).sum(axis=0) if len(x) else x), lags, "vacf")


def lag_class(lag_s: Column) -> Column:
    """The power of two seconds at or below a lag, so that flights of any interval meet; null for lag 0."""
    return F.when(lag_s > 0, F.floor(F.log2(lag_s) + 1e-9).cast("int"))


def over_flights(curves: DataFrame, value: str, strata: DataFrame | None = None, stratum: str = "stratum") -> DataFrame:
    """(stratum, lag_class, flights, mean, eb) of a lag curve (source, flight_id, lag_s, n, value): each flight counts once a class, with its mean over the
    class's pairs; ``mean`` is over flights, and ``eb`` their variance by the squared mean, which tells whether flights agree. ``strata``
    (source, flight_id, stratum), such as classes of duration, shows aging; without it all flights are one stratum, null."""
    rows = curves.withColumn("lag_class", lag_class(F.col("lag_s"))).where(F.col("lag_class").isNotNull())
    own = rows.groupBy(*KEYS, "lag_class").agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("v"))
    own = own.withColumn(stratum, F.lit(None).cast("string")) if strata is None else own.join(strata.select(*KEYS, stratum), KEYS)
    found = own.groupBy(stratum, "lag_class").agg(F.count("*").alias("flights"), F.avg("v").alias("mean"), F.var_pop("v").alias("spread"))
    return found.select(stratum, "lag_class", "flights", "mean", F.when(F.col("mean") != 0, F.col("spread") / (F.col("mean") * F.col("mean"))).alias("eb"))


def duration_strata(grid: DataFrame, edges_s: Sequence[float]) -> DataFrame:
    """(source, flight_id, stratum): the class of the time that a flight's grid covers, "below 600", "600 to 1200", "1200 on" for two edges."""
    spans = grid.groupBy(*KEYS).agg((F.max("grid_t") - F.min("grid_t")).alias("span"))
    edges = [float(e) for e in edges_s]
    name = F.when(F.col("span") < edges[0], f"below {edges[0]:g}")
    for a, b in zip(edges, edges[1:], strict=False):
        name = name.when(F.col("span") < b, f"{a:g} to {b:g}")
    return spans.select(*KEYS, name.otherwise(f"{edges[-1]:g} on").alias("stratum"))
