"""Laws of phase durations, and how much they owe to suspect waits.

Durations are counted first, so all that follows works on distinct values. One running sum a group, of counts, of logarithms and
of values, gives every lower cut its number of durations, its exponent and its empirical distribution; each candidate cut then
meets the distinct values above it. What a flight or a split cuts off is a lower bound, no measurement: it is left out, and its
share is reported.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantrail.operators.ranks import running_sums

KEYS = ["source", "flight_id"]
#: Lower cuts that are tried for a group, and the durations that must lie at or above one.
CUTS, LEAST = 64, 10


def duration_laws(runs: DataFrame, group: str = "phase", duration: str = "duration_s", censored: str = "censored", cuts: int = CUTS, least: int = LEAST) -> DataFrame:
    """(group, n, censored_share, x_min, n_tail, alpha, ks, rate, ratio, z): the power law above the lower cut of least Kolmogorov-Smirnov distance,
    against the exponential law above the same cut.

    ``alpha`` and ``rate`` are maximum likelihood, ``ratio`` is the log likelihood of the power law less that of the exponential, and ``z`` the
    ratio by its standard deviation: above 2 the power law is the better one, below -2 the exponential. Cuts are every distinct
    duration, or each m-th of many, so that at most about ``cuts`` are tried; of equal distances the lowest counts. Only positive durations count; a group
    in which none has ``least`` durations above it, or only one value there, has a row without a law.
    """
    gone = F.coalesce(F.col(censored), F.lit(False))
    shares = runs.groupBy(group).agg(F.count("*").alias("all_runs"), F.avg(gone.cast("double")).alias("censored_share"))
    own = runs.where(~gone & (F.col(duration) > 0)).select(group, F.col(duration).cast("double").alias("x"))
    counts = own.groupBy(group, "x").agg(F.count("*").alias("n")).withColumns({"nl": F.col("n") * F.log("x"), "nx": F.col("n") * F.col("x"), "one": F.lit(1)})
    ranked = running_sums(counts, "x", ["n", "nl", "nx", "one"], [group])
    tail = lambda c: F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c)
    every = F.ceil(F.col("one_all") / cuts)
    tried = ranked.where(((F.col("one_upto") - 1) % every == 0) & (tail("n") >= least) & (F.col("one_upto") < F.col("one_all")))
    tried = tried.select(group, F.col("x").alias("x_min"), tail("n").alias("n_tail"), (tail("nl") - tail("n") * F.log("x")).alias("logs"), (tail("nx") - tail("n") * F.col("x")).alias("over"), (F.col("n_upto") - F.col("n")).alias("below"))
    tried = tried.withColumns({"alpha": 1 + F.col("n_tail") / F.col("logs"), "rate": F.col("n_tail") / F.col("over")})
    met = ranked.select(group, "x", "n", "n_upto").join(tried, group).where(F.col("x") >= F.col("x_min"))
    law = 1 - F.pow(F.col("x") / F.col("x_min"), 1 - F.col("alpha"))
    upto = (F.col("n_upto") - F.col("below")) / F.col("n_tail")
    gap = F.greatest(F.abs(upto - law), F.abs(upto - F.col("n") / F.col("n_tail") - law))
    power = F.log((F.col("alpha") - 1) / F.col("x_min")) - F.col("alpha") * F.log(F.col("x") / F.col("x_min"))
    exponential = F.log("rate") - F.col("rate") * (F.col("x") - F.col("x_min"))
    met = met.withColumns({"gap": gap, "d": power - exponential})
    fits = met.groupBy(group, "x_min").agg(*[F.first(c).alias(c) for c in ("n_tail", "alpha", "rate")], F.max("gap").alias("ks"), F.sum(F.col("n") * F.col("d")).alias("ratio"), F.sum(F.col("n") * F.col("d") * F.col("d")).alias("squares"))
    best = fits.groupBy(group).agg(F.min_by(F.struct("x_min", "n_tail", "alpha", "ks", "rate", "ratio", "squares"), F.struct(F.round("ks", 12), F.col("x_min"))).alias("b")).select(group, "b.*")
    spread = F.sqrt(F.greatest(F.col("squares") - F.col("ratio") * F.col("ratio") / F.col("n_tail"), F.lit(0.0)))
    totals = counts.groupBy(group).agg(F.sum("n").alias("n"))
    found = shares.join(totals, group, "left").join(best.withColumn("z", F.when(spread > 0, F.col("ratio") / spread)), group, "left")
    return found.select(group, F.coalesce("n", F.lit(0)).alias("n"), "censored_share", "x_min", "n_tail", "alpha", "ks", "rate", "ratio", "z")


def merged_intervals(intervals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t0, t1): the union of each key's intervals as disjoint ones; those that touch are one."""
    w = Window.partitionBy(*keys).orderBy("t0", "t1")
    reach = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("t0") <= reach, 0).otherwise(1)
    numbered = intervals.select(*keys, "t0", "t1").withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("island")


def without_intervals(runs: DataFrame, intervals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``runs`` (keys, t0, t1, ...) with ``covered_s``, the seconds of each that the union of the key's intervals covers, and ``touched``, whether one
    overlaps it at all."""
    union = merged_intervals(intervals, keys).groupBy(*keys).agg(F.collect_list(F.struct("t0", "t1")).alias("union_of"))  # disjoint intervals of one flight
    joined = runs.join(union, list(keys), "left")
    inside = lambda g: F.least(g["t1"], F.col("t1")) - F.greatest(g["t0"], F.col("t0"))
    hits = F.filter(F.coalesce("union_of", F.array()), lambda g: (g["t0"] < F.col("t1")) & (F.col("t0") < g["t1"]))
    covered = F.aggregate(F.transform(hits, inside), F.lit(0.0), lambda a, x: a + x)
    return joined.withColumns({"covered_s": covered, "touched": F.size(hits) > 0}).drop("union_of")


def sensitivity(runs: DataFrame, suspects: DataFrame, group: str = "phase", keys: Sequence[str] = KEYS) -> DataFrame:
    """(group, variant, n, mean_s, total_s) of the runs that are not censored: ``all`` of them, ``without`` those that a suspect interval overlaps, and
    ``subtracted``, each less the seconds that suspect intervals cover, where any are left."""
    marked = without_intervals(runs.where(~F.col("censored")), suspects, keys).withColumn("d", (F.col("t1") - F.col("t0")).cast("double"))
    left = F.col("d") - F.col("covered_s")
    seconds = {"all": F.col("d"), "without": F.when(~F.col("touched"), F.col("d")), "subtracted": F.when(~F.col("touched") | (left > 0), left)}
    spread = marked.select(group, F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), s.alias("s")) for n, s in seconds.items()])))
    return spread.groupBy(group, "variant").agg(F.count("s").alias("n"), F.avg("s").alias("mean_s"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("total_s"))
