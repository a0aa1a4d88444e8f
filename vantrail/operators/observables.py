"""Transport observables of segments on uniform grids and of phases."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantrail.operators.ranks import running_sums
from vantrail.session import workers_import

KEYS = ["source", "flight_id"]


def _along(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def msd(points: DataFrame, time: str, east: str = "east_m", north: str = "north_m") -> DataFrame:
    """(time, n, msd, non_gaussian): mean square displacement from the origin over the flights that last so long, and the
    fourth-moment excess of its two-dimensional distribution."""
    r2 = F.col(east) * F.col(east) + F.col(north) * F.col(north)
    found = points.groupBy(time).agg(F.count("*").alias("n"), F.avg(r2).alias("msd"), F.avg(r2 * r2).alias("m4"))
    return found.withColumn("non_gaussian", F.when(F.col("msd") > 0, F.col("m4") / (2 * F.col("msd") * F.col("msd")) - 1)).drop("m4")


def turning_angles(points: DataFrame, keys: Sequence[str] = KEYS, order: str = "fix_no", x: str = "east_m", y: str = "north_m") -> DataFrame:
    """Points with ``turn``, radians between the step that ends and the step that begins here; null next to an end or a standstill."""
    w = _along(keys, order)
    steps = points.withColumns({"ax": F.col(x) - F.lag(x).over(w), "ay": F.col(y) - F.lag(y).over(w)}).withColumns({"bx": F.lead("ax").over(w), "by": F.lead("ay").over(w)})
    moves = (F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") > 0) & (F.col("bx") * F.col("bx") + F.col("by") * F.col("by") > 0)
    turn = F.atan2(F.col("ax") * F.col("by") - F.col("ay") * F.col("bx"), F.col("ax") * F.col("bx") + F.col("ay") * F.col("by"))
    return steps.withColumn("turn", F.when(moves, turn)).drop("ax", "ay", "bx", "by")


def first_passage(points: DataFrame, radii: Sequence[float], keys: Sequence[str] = KEYS, time: str = "t", x: str = "east_m", y: str = "north_m") -> DataFrame:
    """(keys, radius, t): when a flight first lies at least so far from its origin; null if never. One aggregation for all radii."""
    r = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    found = points.groupBy(*keys).agg(F.array(*[F.struct(F.lit(float(q)).alias("radius"), F.min(F.when(r >= float(q), F.col(time))).alias("t")) for q in radii]).alias("passes"))
    return found.select(*keys, F.inline("passes"))


def isotropy(points: DataFrame, time: str, x: str = "east_m", y: str = "north_m") -> DataFrame:
    return points.groupBy(time).agg(F.count("*").alias("n"), (F.avg(F.col(x) * F.col(x)) / F.nullif(F.avg(F.col(y) * F.col(y)), F.lit(0.0))).alias("ratio"))


def ks_distance(samples: DataFrame, value: str, side: Column, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n_a, n_b, ks): the greatest gap between the distributions of the rows where ``side`` holds and the others; null where either has
    none. Values are counted first and ranked in ranges, so no task holds them all."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.sum(side.cast("bigint")).alias("a"), F.sum((~side).cast("bigint")).alias("b"))
    ranked = running_sums(counts, value, ["a", "b"], groups)
    share = lambda c: F.col(f"{c}_upto") / F.nullif(F.col(f"{c}_all"), F.lit(0))
    return ranked.groupBy(*groups).agg(F.max("a_all").alias("n_a"), F.max("b_all").alias("n_b"), F.max(F.abs(share("a") - share("b"))).alias("ks"))


def isotropy_ks(points: DataFrame, time: str, x: str = "east_m", y: str = "north_m") -> DataFrame:
    """(time, n, ks): how far the distributions of the two coordinates lie apart at each time."""
    both = points.select(time, F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col(x).alias("v")), F.struct(F.lit(False).alias("first"), F.col(y).alias("v")))).alias("p")).select(time, "p.first", "p.v")
    return ks_distance(both, "v", F.col("first"), [time]).select(time, F.col("n_a").alias("n"), "ks")


def scaling_exponent(curve: DataFrame, x: str, y: str) -> DataFrame:
    """(alpha, hurst) from the slope of log y against log x over positive points."""
    good = curve.where((F.col(x) > 0) & (F.col(y) > 0))
    return good.agg(F.regr_slope(F.log(y), F.log(x)).alias("alpha")).withColumn("hurst", F.col("alpha") / 2)


def propagator(points: DataFrame, time: str, value: str, width: float) -> DataFrame:
    """(time, bin, n, density): the distribution of one coordinate at each time; bin 0 is centred, its density the return probability."""
    b = F.floor(F.col(value) / width + 0.5)
    counts = points.groupBy(time, b.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(time)) * width))


def phase_runs(rows: DataFrame, phase: str, keys: Sequence[str] = KEYS, order: str = "fix_no", time: str = "t") -> DataFrame:
    """(keys, run, phase, t0, t1, n, censored): maximal stretches of one phase; the first and last of a flight are cut off by it."""
    w = _along(keys, order)
    new = F.when(F.col(phase) == F.lag(phase).over(w), 0).otherwise(1)
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*keys, "run").agg(F.first(phase).alias("phase"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("n"))
    return found.withColumn("censored", (F.col("run") == 1) | (F.col("run") == F.max("run").over(Window.partitionBy(*keys))))


def phase_kinematics(rows: DataFrame, phase: str, keys: Sequence[str] = KEYS, order: str = "fix_no", time: str = "t", x: str = "east_m", y: str = "north_m", alt: str = "alt") -> DataFrame:
    """(phase, n, duration_s, v_xy_mps, v_z_mps) over the phase runs that a flight does not cut off and that last: means of the duration and
    of each run's horizontal and vertical speed between its ends."""
    w = _along(keys, order)
    new = F.when(F.col(phase) == F.lag(phase).over(w), 0).otherwise(1)
    numbered = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    end = lambda f, c: f(F.struct(order, F.col(c).alias("v")))["v"]
    runs = numbered.groupBy(*keys, "run").agg(F.first(phase).alias("phase"), (F.max(time) - F.min(time)).alias("dt"), *[(end(F.max, c) - end(F.min, c)).alias(f"d{i}") for i, c in enumerate((x, y, alt))])
    inner = runs.withColumn("last", F.max("run").over(Window.partitionBy(*keys))).where((F.col("run") > 1) & (F.col("run") < F.col("last")) & (F.col("dt") > 0))
    flat = F.sqrt(F.col("d0") * F.col("d0") + F.col("d1") * F.col("d1")) / F.col("dt")
    return inner.groupBy("phase").agg(F.count("*").alias("n"), F.avg("dt").alias("duration_s"), F.avg(flat).alias("v_xy_mps"), F.avg(F.col("d2") / F.col("dt")).alias("v_z_mps"))


def step_wait_correlation(runs: DataFrame, wait: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(n, corr): between the time of each phase ``wait`` and that of the phase after it, over runs that a flight does not cut off."""
    w = _along(keys, "run")
    after = runs.withColumns({"next": F.lead(F.col("t1") - F.col("t0")).over(w), "next_censored": F.lead("censored").over(w)})
    pairs = after.where((F.col("phase") == wait) & ~F.col("censored") & ~F.col("next_censored"))
    return pairs.agg(F.count("*").alias("n"), F.corr((F.col("t1") - F.col("t0")).cast("double"), F.col("next").cast("double")).alias("corr"))


def transitions(runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(from, to, n, share) between consecutive phases; shares of each phase's departures."""
    after = runs.select(*keys, "run", F.col("phase").alias("from"), F.lead("phase").over(_along(keys, "run")).alias("to")).where(F.col("to").isNotNull())
    counts = after.groupBy("from", "to").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def phase_features(fixes: DataFrame, climb: float = 0.5, turn: float = 0.1) -> DataFrame:
    """Fixes with ``symbol`` 0 to 3 from two binary features, rising and circling (the features are our choice)."""
    w = _along(KEYS, "fix_no")
    dt = F.nullif(F.col("t") - F.lag("t").over(w), F.lit(0.0))
    rising = F.coalesce((F.col("baro_alt") - F.lag("baro_alt").over(w)) / dt > climb, F.lit(False)).cast("int")
    circling = F.coalesce(F.abs("turn") > turn, F.lit(False)).cast("int")
    return turning_angles(fixes).withColumn("symbol", 2 * rising + circling)


def segment_phases(fixes: DataFrame, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> DataFrame:
    """Fixes (with symbol) and ``phase``: the likeliest path of a hidden Markov model, one flight a group."""
    workers_import(fixes.sparkSession)
    start, move, emit = (np.log(np.asarray(x, dtype=float)) for x in (start, move, emit))
    schema = fixes.withColumn("phase", F.lit(0)).schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("fix_no", kind="stable")
        return group.assign(phase=viterbi(group["symbol"].to_numpy(), start, move, emit).astype(np.int32))

    return fixes.groupBy(*KEYS).applyInPandas(run, schema)


def viterbi(symbols: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """All in logarithms; of equal paths the one of lower states."""
    if not len(symbols):
        return np.empty(0, dtype=np.int64)
    score, back = start + emit[:, symbols[0]], np.zeros((len(symbols), len(start)), dtype=np.int64)
    for i in range(1, len(symbols)):
        through = score[:, None] + move
        back[i] = through.argmax(axis=0)
        score = through.max(axis=0) + emit[:, symbols[i]]
    path = np.empty(len(symbols), dtype=np.int64)
    path[-1] = score.argmax()
    for i in range(len(symbols) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def normalized_class(label: Column, table: dict[str, str], other: str = "other") -> Column:
    """A class label through a mapping of lower-case prefixes, first match first."""
    low = F.lower(F.trim(label))
    out = F.when(F.lit(False), "")
    for prefix, name in table.items():
        out = out.when(low.startswith(prefix), name)
    return out.otherwise(other)
