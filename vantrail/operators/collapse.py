"""The scaling collapse: the exponent H for which t^H P(x, t) against x / t^H is one curve for all times.

Positions are counted once, into fine cells a time; these counts, a table whose size follows from the cells and not from the
flights, are then scaled by every candidate H. Coordinates of a candidate are taken by their common root mean square, so that no
H looks better by making all curves flat, and the spread of the curves over times is summed over shared bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collapse(points: DataFrame, time: str, value: str, cell: float, exponents: Sequence[float], width: float = 0.25, reach: float = 3.0) -> DataFrame:
    """(h, times, spread, best): for each candidate exponent how far the scaled distributions of the times lie apart, as the sum of their variances
    over the bins by the sum of their squared means, and whether it is the least, the smallest exponent of several. Positions are taken at the
    middle of cells of ``cell``; times that are not positive, and null positions, take no part. Bins are ``width`` of the common root mean square wide, up to ``reach`` of it."""
    cells = points.where((F.col(time) > 0) & F.col(value).isNotNull()).groupBy(F.col(time).cast("double").alias("t"), F.floor(F.col(value) / cell + 0.5).alias("i")).agg(F.count("*").alias("n"))
    scaled = cells.withColumn("h", F.explode(F.array(*[F.lit(float(h)) for h in exponents]))).withColumn("u", F.col("i") * cell / F.pow("t", F.col("h")))
    of_time = Window.partitionBy("h", "t")
    scaled = scaled.withColumn("share", F.col("n") / F.sum("n").over(of_time))
    # every time weighs alike, however many flights still fly
    norm = scaled.groupBy("h").agg(F.sqrt(F.sum(F.col("share") * F.col("u") * F.col("u")) / F.count_distinct("t")).alias("rms"), F.count_distinct("t").alias("times"))
    binned = scaled.join(norm, "h").where(F.col("rms") > 0).withColumn("v", F.col("u") / F.col("rms")).where(F.abs("v") < reach)
    density = binned.groupBy("h", "times", "t", F.floor(F.col("v") / width + 0.5).alias("bin")).agg(F.sum("share").alias("p"))
    # a time without a bin has 0 there, so sums over all times need the others only
    by_bin = density.groupBy("h", "times", "bin").agg(F.sum("p").alias("s1"), F.sum(F.col("p") * F.col("p")).alias("s2"))
    mean = F.col("s1") / F.col("times")
    spread = by_bin.groupBy("h", "times").agg((F.sum(F.col("s2") / F.col("times") - mean * mean) / F.sum(mean * mean)).alias("spread"))
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round("spread", 12), "h"))  # a row a candidate
    return spread.withColumn("best", order == 1).select("h", "times", "spread", "best")
