"""Flight phases by a hidden Markov model that is trained here: glide, search and climb from three binary features a grid point.

Training is Baum-Welch. Sequences, one a segment, are gathered once and written; every iteration is one pass over them, in
which each task runs forward and backward over its sequences, many at a time, and adds up their expected counts: first states,
moves, emissions. Spark sums these few numbers a task, and the driver divides them. The likelihood of held-out flights, chosen by a
hash, is taken in the same pass and never enters the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantrail.session import workers_import, written

SEGMENT = ["source", "flight_id", "segment_id"]
GLIDE, SEARCH, CLIMB = PHASES = ("glide", "search", "climb")
#: Symbols are 4 rising + 2 turning + straight.
SYMBOLS = 8
#: Sequences that are taken forward and backward together, and how many steps they may have in all.
TOGETHER, STEPS = 256, 1 << 20


class Model(NamedTuple):
    """Probabilities of the first state, of moves (from, to) and of symbols (state, symbol)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model() -> Model:
    """Where training begins: states persist, gliding is straight and sinking, climbing turns and rises, searching turns and sinks."""
    share = {GLIDE: (0.2, 0.15, 0.8), SEARCH: (0.35, 0.5, 0.4), CLIMB: (0.85, 0.8, 0.15)}  # rising, turning, straight
    bits = np.array([[(s >> 2) & 1, (s >> 1) & 1, s & 1] for s in range(SYMBOLS)])
    emit = np.array([np.prod(np.where(bits == 1, np.array(share[p]), 1 - np.array(share[p])), axis=1) for p in PHASES])
    move = np.full((3, 3), 0.05) + 0.85 * np.eye(3)
    return Model(np.full(3, 1 / 3), move, emit)


def features(grid: DataFrame, half_s: float = 20.0, turn_rad_s: float = 0.05, straight: float = 0.9) -> DataFrame:
    """``grid`` (segment, k, grid_t, dt_s, east_m, north_m, alt) with rising, turning, straight and ``symbol``. All are taken over the points within
    ``half_s`` seconds (at least one step either way) and inside the segment: rising where the altitude ends higher than it began, turning where
    the heading keeps turning one way at the given rate on average, straight where the net way is that share of the way flown. Where a
    feature is undefined, at a lone point, at a standstill or for null altitudes, it is false."""
    w = Window.partitionBy(*SEGMENT).orderBy("k")
    ahead = lambda c: F.lead(c).over(w) - F.col(c)
    steps = grid.withColumns({"step_e": ahead("east_m"), "step_n": ahead("north_m")}).withColumns({"last_e": F.lag("step_e").over(w), "last_n": F.lag("step_n").over(w)})
    cross, dot = F.col("last_e") * F.col("step_n") - F.col("last_n") * F.col("step_e"), F.col("last_e") * F.col("step_e") + F.col("last_n") * F.col("step_n")
    way = F.sqrt(F.col("step_e") * F.col("step_e") + F.col("step_n") * F.col("step_n"))
    reach = F.greatest(F.lit(half_s), F.col("dt_s")) * (1 + 1e-9)
    steps = steps.withColumns({"way": F.coalesce(way, F.lit(0.0)), "turn": F.coalesce(F.atan2(cross, dot), F.lit(0.0)), "scaled_t": F.col("grid_t") / reach})
    near = Window.partitionBy(*SEGMENT).orderBy("scaled_t").rangeBetween(-1, 1)
    point = F.struct("east_m", "north_m", "alt", "grid_t", "way", "turn")
    rows = steps.withColumn("point", point).withColumns({"a": F.first("point").over(near), "b": F.last("point").over(near), "flown": F.sum("way").over(near), "turned": F.sum("turn").over(near)})
    a, b = F.col("a"), F.col("b")
    flown, turned = F.col("flown") - b["way"], F.col("turned") - a["turn"] - F.when(b["grid_t"] > a["grid_t"], b["turn"]).otherwise(0.0)  # the last step leads out, and so do the turns at the ends
    east, north, seconds = b["east_m"] - a["east_m"], b["north_m"] - a["north_m"], b["grid_t"] - a["grid_t"]
    no = lambda c: F.coalesce(c, F.lit(False))
    found = rows.withColumns({"rising": no(b["alt"] > a["alt"]), "turning": no((seconds > 0) & (F.abs(turned) >= turn_rad_s * seconds)), "straight": no((flown > 0) & (F.sqrt(east * east + north * north) >= straight * flown))})
    symbol = 4 * F.col("rising").cast("int") + 2 * F.col("turning").cast("int") + F.col("straight").cast("int")
    return found.select(*grid.columns, "rising", "turning", "straight", symbol.alias("symbol"))


def sequences(rows: DataFrame, held_out: float = 0.2) -> DataFrame:
    """(segment, held, symbols): the symbols of each segment in order, and whether its flight is held out. A segment fits in a row."""
    held = F.pmod(F.xxhash64("source", "flight_id"), F.lit(1000)) < int(1000 * held_out)
    whole = rows.groupBy(*SEGMENT).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "symbol"))), lambda r: r["symbol"]).alias("symbols"))
    return whole.select(*SEGMENT, held.alias("held"), "symbols")


def expected_counts(batch: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood of each sequence, and over all of them the expected first states, moves and emissions), forward and backward together."""
    start, move, emit = model
    lengths = np.array([len(s) for s in batch])
    n, longest, states = len(batch), int(lengths.max(initial=0)), len(start)
    symbols = np.zeros((n, longest), np.int64)
    for i, s in enumerate(batch):
        symbols[i, : len(s)] = s
    alive = np.arange(longest)[None, :] < lengths[:, None]
    forward, scale = np.zeros((longest, n, states)), np.ones((longest, n))
    for t in range(longest):
        into = np.broadcast_to(start, (n, states)) if t == 0 else forward[t - 1] @ move
        forward[t] = np.where(alive[:, t, None], into * emit[:, symbols[:, t]].T, forward[t - 1] if t else 0.0)
        scale[t] = np.where(alive[:, t], forward[t].sum(axis=1), 1.0)
        forward[t] /= np.where(scale[t] > 0, scale[t], 1.0)[:, None]
    first, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((states, emit.shape[1]))
    backward = np.ones((n, states))
    for t in range(longest - 1, -1, -1):
        own = forward[t] * backward
        own = np.where(alive[:, t, None], own / np.maximum(own.sum(axis=1, keepdims=True), 1e-300), 0.0)
        np.add.at(emitted.T, symbols[:, t], own)
        if t == 0:
            first += own.sum(axis=0)
            break
        ahead = emit[:, symbols[:, t]].T * backward / np.maximum(scale[t], 1e-300)[:, None]
        pair = forward[t - 1][:, :, None] * move[None] * ahead[:, None, :]
        moves += np.where(alive[:, t, None, None], pair, 0.0).sum(axis=0)
        backward = np.where(alive[:, t, None], ahead @ move.T, backward)
    return np.log(np.maximum(scale, 1e-300)).sum(axis=0), first, moves, emitted


def _together(symbols: pa.ListArray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Places and sequences in groups of about equal lengths; empty ones are left out."""
    flat, at = symbols.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(symbols.value_lengths().to_numpy(zero_copy_only=False))])
    lengths = np.diff(at)
    order = [i for i in np.argsort(lengths, kind="stable") if lengths[i]]
    while order:
        take = max(1, min(TOGETHER, STEPS // int(lengths[order[-1]])))
        order, own = order[:-take], order[-take:]
        yield np.array(own), [flat[at[i] : at[i + 1]] for i in own]


def train(whole: DataFrame, model: Model | None = None, iterations: int = 20, tolerance: float = 1e-4) -> tuple[Model, list[tuple[int, float, float, int, int]]]:
    """The trained model and (iteration, log likelihood of training a step, of held-out a step, steps of either) before each update.

    ``whole`` is what ``sequences`` gave, written. Training ends after ``iterations`` updates or where the likelihood a step grows by less than
    ``tolerance``. What a model never saw keeps a little weight, so no symbol is impossible. Without sequences the model stays.
    """
    spark = whole.sparkSession
    workers_import(spark)
    model = model or first_model()
    states, size = model.emit.shape
    history = []
    for i in range(iterations + 1):

        def counted(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total: dict[str, float] = {}

            def add(name: str, values: np.ndarray) -> None:
                for j, v in enumerate(np.ravel(values)):
                    total[f"{name}:{j}"] = total.get(f"{name}:{j}", 0.0) + float(v)

            for batch in batches:
                for held in (False, True):
                    own = batch.filter(pa.compute.equal(batch.column("held"), held))
                    for _, group in _together(own.column("symbols")):
                        likelihood, *counts = expected_counts(group, model)
                        add(f"likelihood{int(held)}", likelihood.sum())
                        add(f"steps{int(held)}", np.array(sum(map(len, group))))
                        if not held:
                            for name, c in zip(("start", "move", "emit"), counts, strict=True):
                                add(name, c)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], names=["name", "total"])

        sums = {r.name: r.total for r in whole.select("held", "symbols").mapInArrow(counted, "name string, total double").groupBy("name").agg(F.sum("total").alias("total")).collect()}  # a row a parameter
        steps, held_steps = (int(sums.get(f"steps{h}:0", 0)) for h in (0, 1))
        if not steps:
            break
        history.append((i, sums["likelihood0:0"] / steps, sums.get("likelihood1:0", 0.0) / held_steps if held_steps else 0.0, steps, held_steps))
        if i == iterations or (i and history[-1][1] - history[-2][1] < tolerance):
            break
        of = lambda name, shape: np.array([sums.get(f"{name}:{j}", 0.0) for j in range(int(np.prod(shape)))]).reshape(shape)
        share = lambda c: (c + 1e-9) / (c + 1e-9).sum(axis=-1, keepdims=True)
        model = Model(share(of("start", (states,))), share(of("move", (states, states))), share(of("emit", (states, size))))
    return model, history


def viterbi(batch: list[np.ndarray], model: Model) -> list[np.ndarray]:
    """The likeliest states of each sequence, those of lower states among equals; sequences are taken together."""
    with np.errstate(divide="ignore"):
        start, move, emit = (np.log(x) for x in model)
    lengths = np.array([len(s) for s in batch])
    n, longest = len(batch), int(lengths.max(initial=0))
    symbols = np.zeros((n, longest), np.int64)
    for i, s in enumerate(batch):
        symbols[i, : len(s)] = s
    score, back = np.zeros((n, len(start))), np.zeros((longest, n, len(start)), np.int8)
    for t in range(longest):
        if t == 0:
            score = start + emit[:, symbols[:, 0]].T
            continue
        through = score[:, :, None] + move[None]
        alive = (t < lengths)[:, None]
        back[t] = np.where(alive, through.argmax(axis=1), np.arange(len(start)))
        score = np.where(alive, through.max(axis=1) + emit[:, symbols[:, t]].T, score)
    path = np.zeros((n, longest), np.int32)
    state = score.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        path[:, t] = state
        state = back[t][np.arange(n), state] if t else state
    return [path[i, : lengths[i]] for i in range(n)]


def label(whole: DataFrame, model: Model) -> DataFrame:
    """(segment, i, phase): the likeliest phase of each place of each segment, from 0; ``whole`` is what ``sequences`` gave."""
    workers_import(whole.sparkSession)
    names = np.array(PHASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[str] | None] = [None] * batch.num_rows
            for places, group in _together(batch.column("symbols")):
                for at, path in zip(places, viterbi(group, model), strict=True):
                    found[at] = names[path].tolist()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in SEGMENT], pa.array(found, pa.list_(pa.string()))], names=[*SEGMENT, "phases"])

    kinds = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in SEGMENT)
    return whole.mapInArrow(run, f"{kinds}, phases array<string>").select(*SEGMENT, F.posexplode("phases").alias("i", "phase"))


def with_phases(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (with symbol) and their likeliest ``phase``."""
    place = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("k")) - 1
    return rows.withColumn("i", place).join(label(written(sequences(rows)), model), [*SEGMENT, "i"]).drop("i")


def as_table(model: Model) -> list[tuple[str, str, str, float]]:
    """(part, from, to, probability) of a model, for a report."""
    rows = [("start", "", PHASES[i], float(p)) for i, p in enumerate(model.start)]
    rows += [("move", PHASES[i], PHASES[j], float(model.move[i, j])) for i in range(3) for j in range(3)]
    return rows + [("emit", PHASES[i], str(s), float(model.emit[i, s])) for i in range(3) for s in range(SYMBOLS)]
