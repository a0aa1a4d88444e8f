"""The shape of phase runs: circles of climbs, periods of turning, ways of searches."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["source", "flight_id"]


def run_geometry(rows: DataFrame, phase: str, keys: Sequence[str] = KEYS, order: str = "fix_no", time: str = "t", x: str = "east_m", y: str = "north_m", alt: str = "alt") -> DataFrame:
    """(keys, run, phase, censored, n, duration_s, gain_m, climb_mps, path_m, net_m, tortuosity, turned_rad, period_s, radius_m, circle_rms_m) of each
    maximal run of one phase, in one aggregation.

    The circle is the least-squares one of x^2 + y^2 = 2 a x + 2 b y + c, from sums about the run's mean; a run on a line, or of fewer than three
    points, has none. ``turned_rad`` adds up the changes of heading, each taken the short way round, a reversal to the left, so it is the heading unwrapped along the run;
    ``period_s`` is the time of one whole turn at that rate, null below one turn. ``tortuosity`` is the way flown by the net way. The first and the last run of a
    key are censored.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(phase) == F.lag(phase).over(w), 0).otherwise(1)
    numbered = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of_run = Window.partitionBy(*keys, "run")
    along = of_run.orderBy(order)
    step = lambda c: F.col(c) - F.lag(c).over(along)
    steps = numbered.withColumns({"sx": step(x), "sy": step(y), "u": F.col(x) - F.avg(x).over(of_run), "v": F.col(y) - F.avg(y).over(of_run)})
    steps = steps.withColumns({"px": F.lag("sx").over(along), "py": F.lag("sy").over(along)})
    way = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    moves = (F.col("px") * F.col("px") + F.col("py") * F.col("py") > 0) & (way > 0)
    cross, dot = F.col("px") * F.col("sy") - F.col("py") * F.col("sx"), F.col("px") * F.col("sx") + F.col("py") * F.col("sy")
    turn = F.when(moves, F.when((cross == 0) & (dot < 0), F.lit(pi)).otherwise(F.atan2(cross, dot)))
    u, v = F.col("u"), F.col("v")
    q = u * u + v * v
    end = lambda f, c: f(F.struct(F.col(order).alias("o"), F.col(c).alias("c")))["c"]
    sums = {"suu": u * u, "svv": v * v, "suv": u * v, "suq": u * q, "svq": v * q, "sq": q, "sqq": q * q}
    found = steps.groupBy(*keys, "run").agg(
        F.first(phase).alias("phase"),
        F.count("*").alias("n"),
        (F.max(time) - F.min(time)).alias("duration_s"),
        (end(F.max, alt) - end(F.min, alt)).alias("gain_m"),
        F.coalesce(F.sum(way), F.lit(0.0)).alias("path_m"),
        (end(F.max, x) - end(F.min, x)).alias("dx"),
        (end(F.max, y) - end(F.min, y)).alias("dy"),
        F.coalesce(F.sum(turn), F.lit(0.0)).alias("turned_rad"),
        *[F.sum(c).alias(name) for name, c in sums.items()],
    )
    c = F.col
    det = c("suu") * c("svv") - c("suv") * c("suv")
    solid = (c("n") >= 3) & (det > 1e-9 * c("suu") * c("svv"))
    a = F.when(solid, (c("suq") * c("svv") - c("svq") * c("suv")) / (2 * det))
    b = F.when(solid, (c("svq") * c("suu") - c("suq") * c("suv")) / (2 * det))
    mean_q = c("sq") / c("n")
    radius = F.sqrt(a * a + b * b + mean_q)
    # the residuals of the equation, by the diameter, are those of the radius to first order
    residual = c("sqq") - 4 * a * c("suq") - 4 * b * c("svq") + 4 * a * a * c("suu") + 8 * a * b * c("suv") + 4 * b * b * c("svv") - c("n") * mean_q * mean_q
    net = F.sqrt(c("dx") * c("dx") + c("dy") * c("dy"))
    lasting = c("duration_s") > 0
    censored = (c("run") == 1) | (c("run") == F.max("run").over(Window.partitionBy(*keys)))
    return found.select(
        *keys, "run", "phase", censored.alias("censored"), "n", "duration_s", "gain_m",
        F.when(lasting, c("gain_m") / c("duration_s")).alias("climb_mps"), "path_m", net.alias("net_m"), F.when(net > 0, c("path_m") / net).alias("tortuosity"), "turned_rad",
        F.when(lasting & (F.abs("turned_rad") >= 2 * pi), 2 * pi * c("duration_s") / F.abs("turned_rad")).alias("period_s"), radius.alias("radius_m"),
        F.sqrt(F.greatest(residual / c("n"), F.lit(0.0)) / (4 * radius * radius)).alias("circle_rms_m"),
    )


def glide_wait_pairs(runs: DataFrame, glide: str, keys: Sequence[str] = KEYS, length: str = "net_m") -> DataFrame:
    """(keys, run, length_m, glide_s, wait_s): each whole glide and the wait after it, the time of all runs up to the next glide. ``runs`` is what
    ``run_geometry`` gave. A glide or a wait that the flight cuts off gives no pair, and two glides in a row can't be."""
    w = Window.partitionBy(*keys).orderBy("run")
    marked = runs.withColumn("is_glide", F.col("phase") == glide)
    number = F.sum(F.col("is_glide").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    parts = marked.withColumn("part", number).where(F.col("part") > 0)
    own = lambda c: F.max(F.when(F.col("is_glide"), F.col(c)))
    waits = F.sum(F.when(~F.col("is_glide"), F.col("duration_s")))
    found = parts.groupBy(*keys, "part").agg(own("run").alias("run"), own(length).alias("length_m"), own("duration_s").alias("glide_s"), waits.alias("wait_s"), F.max("censored").alias("cut"))
    return found.where(~F.col("cut") & F.col("wait_s").isNotNull()).select(*keys, "run", "length_m", "glide_s", "wait_s")


def coupling(pairs: DataFrame) -> DataFrame:
    """(n, length_wait, length_time, speed_mps, speed_spread): how glide lengths go with the waits after them and with their own times, and the mean
    and spread of their speeds. Glides that take no time have no speed."""
    speed = F.when(F.col("glide_s") > 0, F.col("length_m") / F.col("glide_s"))
    return pairs.agg(F.count("*").alias("n"), F.corr("length_m", "wait_s").alias("length_wait"), F.corr("length_m", "glide_s").alias("length_time"), F.avg(speed).alias("speed_mps"), F.stddev_pop(speed).alias("speed_spread"))


def anatomy(runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, phase, n, seconds, metres, time_share, way_share): what each flight is made of. Shares are of the seconds and metres inside runs, null where a
    flight has none."""
    found = runs.groupBy(*keys, "phase").agg(F.count("*").alias("n"), F.sum("duration_s").alias("seconds"), F.sum("path_m").alias("metres"))
    of = Window.partitionBy(*keys)
    share = lambda c: F.col(c) / F.nullif(F.sum(c).over(of), F.lit(0.0))
    return found.withColumns({"time_share": share("seconds"), "way_share": share("metres")})
