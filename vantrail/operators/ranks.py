"""Running sums in value order, exact quantiles and distribution distances without all values of a group in one task.

Values are counted first, so what follows sees distinct values. Splitters from a quantile sketch of bounded size cut each group
into ``PARTS`` ranges of about as many distinct values; sums a range give each range's start, and running sums inside a
range the rest. A sketch depends on the order of what it merges, so the splitters are written once: two evaluations could
place a value in two ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantrail.session import written

#: Ranges of a group.
PARTS = 128
#: Splitters are looked up by every so many first.
STRIDE = 12


def running_sums(counts: DataFrame, value: str, sums: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """``counts``, one row a group and value, with {sum}_upto, the sum over values up to the row's own, and {sum}_all, over the group. Groups are
    those of a report: their splitters, a kilobyte a group, are broadcast, since by key the values of a group would meet in one task. The
    counts are written first, or each of the three passes over them would count anew, and so are the splitters, which no second evaluation need repeat."""
    counts = written(counts)
    at = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    cuts = written(counts.groupBy(*groups).agg(F.percentile_approx(value, at).alias("cuts")))
    ranged = counts.join(F.broadcast(cuts), list(groups)) if groups else counts.crossJoin(F.broadcast(cuts))  # without groups one row; the planner weighs a row a group
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(value)))
    coarse = F.array(*[F.get("cuts", F.lit(i)) for i in range(STRIDE - 1, PARTS - 1, STRIDE)])
    ranged = ranged.withColumn("coarse", below(coarse)).withColumn("range", STRIDE * F.col("coarse") + below(F.slice("cuts", STRIDE * F.col("coarse") + 1, STRIDE))).drop("cuts", "coarse")
    whole = ranged.groupBy(*groups, "range").agg(*[F.sum(s).alias(f"{s}_of") for s in sums])
    by_range = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))  # PARTS rows a group
    before = by_range.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*groups, "range", *[F.coalesce(F.sum(f"{s}_of").over(before), F.lit(0)).alias(f"{s}_before") for s in sums], *[F.sum(f"{s}_of").over(by_range).alias(f"{s}_all") for s in sums])
    inside = Window.partitionBy(*groups, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(whole, [*groups, "range"])
    return joined.withColumns({f"{s}_upto": F.col(f"{s}_before") + F.sum(s).over(inside) for s in sums}).drop("range", *[f"{s}_before" for s in sums])


def exact_quantiles(rows: DataFrame, value: str, at: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n, xs): the quantiles of the values that are not null, with linear interpolation between neighbours, as an array in the
    order of ``at``. A group without values has no row."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranked = running_sums(counts, "__v", ["__n"], groups)
    place = lambda q: F.lit(float(q)) * (F.col("__n_all") - 1)
    first = lambda rank: F.min(F.when(F.col("__n_upto") > rank, F.col("__v")))
    picked = ranked.groupBy(*groups).agg(F.max("__n_all").alias("n"), F.array(*[F.struct(first(F.floor(place(q))).alias("a"), first(F.ceil(place(q))).alias("b"), F.max(place(q) - F.floor(place(q))).alias("part")) for q in at]).alias("xs"))
    return picked.select(*groups, "n", F.transform("xs", lambda x: x["a"] + x["part"] * (x["b"] - x["a"])).alias("xs"))
