"""Flights from a stream of fixes: each flight is gathered in keyed state and closed by a timeout, and only then split, by its own gap bound.

A session window with a fixed gap can't do this: a flight's bound follows from its median interval, which needs the whole
flight. A flight is closed where no fix of it has come for ``close_s`` seconds of event time; the watermark allows fixes to come
``late`` out of order. Rows later than that are dropped before they reach the state, so a closed flight is not opened again by them;
rows that are in time but come after their flight was closed begin a new flight of the same key, a row of which says so in
``part``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vantrail.config import Thresholds
from vantrail.session import workers_import

OUT = "source string, flight_id {kind}, part int, fix_no int, t double, lat double, lon double, dt_s double, segment_id short"
STATE = "part int, closed boolean, at array<double>, lat array<double>, lon array<double>"


def split(at: np.ndarray, limits: Thresholds) -> tuple[float | None, np.ndarray]:
    """The median interval of times in order, and the segment of each: a new one after a gap over the bound."""
    gaps = np.diff(at)
    if not len(gaps):
        return None, np.zeros(len(at), dtype=np.int16)
    s, dt = limits.sampling, float(np.median(gaps))
    bound = min(s.max_gap_factor * dt, max(s.max_gap_seconds, s.gap_floor_ratio * dt))
    return dt, np.concatenate([[0], np.cumsum(gaps > bound)]).astype(np.int16)


def assemble(fixes: DataFrame, limits: Thresholds, close_s: float = 3600.0, late: str = "10 minutes") -> DataFrame:
    """(source, flight_id, part, fix_no, t, lat, lon, dt_s, segment_id) of closed flights, from a stream (source, flight_id, ts timestamp, lat, lon). Fixes are in the order of
    their times; t counts from the first; of several fixes at one time the one of the least position comes first. A flight fits in a state row."""
    workers_import(fixes.sparkSession)
    kind = fixes.schema["flight_id"].dataType.simpleString()

    def closed(key: tuple, part: int, at: list, lat: list, lon: list) -> pd.DataFrame:
        order = np.lexsort((lon, lat, at))
        times, n = np.array(at)[order], len(at)
        dt, segments = split(times, limits)
        return pd.DataFrame({"source": key[0], "flight_id": key[1], "part": np.full(n, part, np.int32), "fix_no": np.arange(1, n + 1, dtype=np.int32), "t": times - times[0], "lat": np.array(lat)[order], "lon": np.array(lon)[order], "dt_s": dt, "segment_id": segments})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part, is_closed, at, lat, lon = state.get if state.exists else (0, True, [], [], [])
        if state.hasTimedOut:
            if not is_closed:
                yield closed(key, part, at, lat, lon)
            state.update((part, True, [], [], []))  # only the number of the part stays
            return
        at, lat, lon = list(at), list(lat), list(lon)
        if is_closed:
            part += 1
        for f in frames:
            at += f["at"].tolist()
            lat += f["lat"].tolist()
            lon += f["lon"].tolist()
        state.update((part, False, at, lat, lon))
        until = int((max(at) + close_s) * 1000)
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    seconds = (F.unix_micros("ts") / 1e6).alias("at")
    stream = fixes.select("source", "flight_id", "ts", seconds, "lat", "lon").withWatermark("ts", late)
    return stream.groupBy("source", "flight_id").applyInPandasWithState(step, OUT.format(kind=kind), STATE, "append", GroupStateTimeout.EventTimeTimeout)

