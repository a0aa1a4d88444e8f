"""Near-identical tracks: one flight that was uploaded twice, perhaps shifted a little, cut in other intervals or begun later by the clock.

Two tracks are near where their discrete Frechet distance on a common time grid is at most ``metres``. Then their first points
lie within that distance, their last ones too, and so do their northernmost, southernmost, easternmost and westernmost values: cells of that size, with
their neighbours, are blocking keys that lose nothing, and the other extremes are a cheap test before any distance. Equal
tracks are one candidate, whatever their number. The tracks of a cell are dealt into parts of bounded size, and two parts meet in one place: a track is
sent once for a part it meets, not once for a pair, and no table of candidates is broadcast. Distances are found diagonal by diagonal of the coupling, for many pairs together, which ends where no point
can be reached any more.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantrail.functions.geo import EARTH_RADIUS_M
from vantrail.operators.resample import linear_grid
from vantrail.session import workers_import, written

KEYS = ["source", "flight_id"]
#: Pairs whose distances are found together, and how many points they may have in all.
TOGETHER, POINTS = 1024, 1 << 18
#: Tracks and points of a part of a cell, and what a task compares and reads, about.
PART_TRACKS, PART_POINTS = 256, 1 << 17
TASK_PAIRS, TASK_POINTS = 1 << 17, 1 << 22


def frechet_many(pairs: Sequence[tuple[np.ndarray, np.ndarray]], most: float) -> list[float | None]:
    """The discrete Frechet distance of each pair of polylines, a row a point, where it is at most ``most``. Pairs of about equal lengths are
    taken together, a diagonal of their tables at a time."""
    out: list[float | None] = [None] * len(pairs)
    order = sorted((i for i, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda i: tuple(map(len, pairs[i])))
    while order:
        take = max(1, min(TOGETHER, POINTS // max(map(len, pairs[order[-1]]))))
        order, own = order[:-take], order[-take:]
        for i, d in zip(own, _together([pairs[i] for i in own], (most * (1 + 1e-12)) ** 2), strict=True):
            out[i] = float(np.sqrt(d)) if np.isfinite(d) else None
    return out


def _together(pairs: list[tuple[np.ndarray, np.ndarray]], most: float) -> np.ndarray:
    """The squared distances of pairs; infinite where over ``most``. On a diagonal only the places that some pair can still reach are kept,
    so tables of tracks that stay apart end early, and those of near ones cost their breadth of near points."""
    n, m = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    rows, columns, count = int(n.max()), int(m.max()), len(pairs)
    a, b = np.full((2, rows, count), np.inf), np.full((2, columns, count), -np.inf)  # padding is out of reach
    for i, (p, q) in enumerate(pairs):
        a[:, : len(p), i], b[:, : len(q), i] = p.T, q.T
    b = b[:, ::-1]
    out = np.full(count, np.inf)
    # place i + 1 of a diagonal k is the cell of point i of the one and point k - i of the other; places outside of what a diagonal wrote stay infinite
    before, last = np.full((rows + 1, count), np.inf), np.full((rows + 1, count), np.inf)
    low, high = 0, 0  # the places to look at
    wrote, reached = [(0, -1), (0, -1)], []  # by the last two diagonals, and what the last one reached
    ends = set((n + m - 2).tolist())
    for k in range(rows + columns - 1):
        low, high = max(low, k - columns + 1), min(high, k, rows - 1)
        if low > high:
            break
        d = a[:, low : high + 1] - b[:, columns - 1 - k + low : columns - k + high]
        d *= d
        own = d[0] + d[1]
        if k:
            np.maximum(own, np.minimum(np.minimum(last[low + 1 : high + 2], last[low : high + 1]), before[low : high + 1]), out=own)
        own[own > most] = np.inf
        before, last = last, before
        last[wrote[0][0] + 1 : wrote[0][1] + 2] = np.inf
        last[low + 1 : high + 2] = own
        wrote = [wrote[1], (low, high)]
        if k in ends:
            done = n + m - 2 == k
            out[done] = last[n[done], done]
        alive = np.nonzero(np.isfinite(own).any(axis=1))[0]
        reached, old = [int(i) + low for i in alive[[0, -1]]] if len(alive) else [], reached
        if not reached and not old:
            break
        low, high = min(reached + old), max(reached + old) + 1
    return out


def frechet(a: np.ndarray, b: np.ndarray, most: float) -> float | None:
    """The discrete Frechet distance where it is at most ``most``."""
    return frechet_many([(a, b)], most)[0]


def track_shapes(fixes: DataFrame, step_s: float, latitude: float = 45.0) -> DataFrame:
    """(source, flight_id, n, shape, signature): positions every ``step_s`` seconds in plane metres, true at ``latitude``, as an array of [x, y] to the
    decimetre, and their hash. A track fits in a row. Fixes of one second are averaged first."""
    scale = EARTH_RADIUS_M * np.pi / 180
    merged = fixes.groupBy(*KEYS, "t").agg(F.avg(F.col("lon") * float(scale * np.cos(np.radians(latitude)))).alias("x"), F.avg(F.col("lat") * float(scale)).alias("y"))
    grid = linear_grid(merged, KEYS, ["x", "y"], F.lit(float(step_s)))
    shape = F.transform(F.array_sort(F.collect_list(F.struct("k", F.round("x", 1).alias("x"), F.round("y", 1).alias("y")))), lambda p: F.array(p["x"], p["y"]))
    return grid.groupBy(*KEYS).agg(F.count("*").alias("n"), shape.alias("shape")).withColumn("signature", F.xxhash64("shape"))


def near_tracks(fixes: DataFrame, metres: float = 100.0, step_s: float = 10.0, latitude: float = 45.0) -> tuple[DataFrame, DataFrame]:
    """Pairs of near tracks and who they stand for.

    (class_a, class_b, frechet_m): pairs of different tracks, each named by the least (source, flight_id) of its class, a before b; and
    (source, flight_id, class, size): the class of every track, those whose positions are equal. Within a class all distances are 0. Tracks
    without positions take no part.
    """
    spark = fixes.sparkSession
    workers_import(spark)
    shapes = written(track_shapes(fixes, step_s, latitude))
    key = F.struct(*[F.col(k) for k in KEYS])
    named = written(shapes.groupBy("signature", "shape").agg(F.min(key).alias("class"), F.count("*").alias("size")))
    cell = lambda c: F.floor(c / metres).cast("bigint")
    most = lambda i: F.array_max(F.transform("shape", lambda p: p[i]))
    cells = {"x0": cell(F.col("shape")[0][0]), "y0": cell(F.col("shape")[0][1]), "north": cell(most(1)), "east": cell(most(0))}
    places = written(named.select("class", F.size("shape").alias("n"), F.struct(*[c.alias(n) for n, c in cells.items()]).alias("cell")))
    parted = written(_parted(places))
    units = written(_units(parted))
    sent = units.select("unit", F.explode(F.when(F.col("part_a") == F.col("part_b"), F.array(_side("a", 0))).otherwise(F.array(_side("a", 0), _side("b", 1)))).alias("s")).select("unit", "s.*")
    work = units.agg(F.sum(F.col("tracks_a") * F.col("tracks_b")).alias("pairs"), F.sum(F.col("points_a") + F.col("points_b")).alias("points")).first()
    tasks = 1 + max((work["pairs"] or 0) // TASK_PAIRS, (work["points"] or 0) // TASK_POINTS)
    tracks = named.select("class", "shape").join(parted.select("class", "part").hint("merge"), "class")
    rows = tracks.join(sent.hint("merge"), "part").select("unit", "side", F.col("class.source").alias("source"), F.col("class.flight_id").alias("id"), "shape")

    def compare(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        lines = _lines(unit.column("shape").chunk(0))
        i, j = _close(lines, unit.column("side").to_numpy(), metres + 0.01)
        found = []
        for at in range(0, len(i), 4096):
            found += frechet_many([(lines[p], lines[q]) for p, q in zip(i[at : at + 4096], j[at : at + 4096], strict=True)], metres)
        ids = [unit.column(c).take(pa.array(side)) for side in (i, j) for c in ("source", "id")]
        out = pa.Table.from_arrays([*ids, pa.array(found, pa.float64())], names=["source_a", "id_a", "source_b", "id_b", "frechet_m"])
        return out.filter(pa.compute.is_valid(out.column("frechet_m")))

    kind = fixes.schema["flight_id"].dataType.simpleString()
    found = rows.repartition(tasks, "unit").groupBy("unit").applyInArrow(compare, f"source_a string, id_a {kind}, source_b string, id_b {kind}, frechet_m double")
    ends = [F.struct(F.col(f"source_{s}").alias("source"), F.col(f"id_{s}").alias("flight_id")) for s in "ab"]
    members = shapes.select(*KEYS, "signature", "shape").join(named.hint("merge"), ["signature", "shape"]).select(*KEYS, "class", "size")
    return found.select(F.least(*ends).alias("class_a"), F.greatest(*ends).alias("class_b"), "frechet_m"), members


def _parted(places: DataFrame) -> DataFrame:
    """``places`` (class, n, cell) with ``part``: the cell and a number, by which the tracks of a cell are dealt into parts of about equal sizes."""
    cells = places.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / PART_TRACKS), F.ceil(F.sum("n") / PART_POINTS)).alias("parts"))
    number = F.pmod(F.xxhash64("class"), F.col("parts"))
    return places.join(cells.hint("merge"), "cell").select("class", "n", F.struct("cell", number.alias("number")).alias("part"))


def _units(parted: DataFrame) -> DataFrame:
    """(unit, part_a, part_b, tracks_a, ...): the pairs of parts that may hold near tracks, each once, and a part of several tracks with itself."""
    parts = parted.groupBy("part").agg(F.count("*").alias("tracks"), F.sum("n").alias("points"))
    side = lambda s: parts.select(*[F.col(c).alias(f"{c}_{s}") for c in parts.columns])
    names = parted.schema["part"].dataType["cell"].dataType.names
    own, around = side("a").withColumns({n: F.col(f"part_a.cell.{n}") for n in names}), side("b")
    for n in names:
        around = around.withColumn(n, F.explode(F.sequence(F.col(f"part_b.cell.{n}") - 1, F.col(f"part_b.cell.{n}") + 1)))
    met = own.join(around.hint("merge"), names).where((F.col("part_a") < F.col("part_b")) | ((F.col("part_a") == F.col("part_b")) & (F.col("tracks_a") > 1)))
    return met.drop(*names).withColumn("unit", F.monotonically_increasing_id())


def _side(name: str, number: int) -> Column:
    return F.struct(F.col(f"part_{name}").alias("part"), F.lit(number).alias("side"))


def _lines(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def _close(lines: list[np.ndarray], side: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of the pairs of a line of side 0 and one of side 1, or of two of side 0 where there is no other, whose ends and extremes are
    at most ``most`` apart."""
    boxes = np.array([[*p[0], *p[-1], *p.min(axis=0), *p.max(axis=0)] for p in lines])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    right = left if alone else right
    near = np.ones((len(left), len(right)), bool)
    for at in range(boxes.shape[1]):
        near &= np.abs(boxes[left, None, at] - boxes[None, right, at]) <= most
    i, j = np.nonzero(np.triu(near, 1) if alone else near)
    return left[i], right[j]
