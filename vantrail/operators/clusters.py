"""Clusters of places by density over grid cells, and connected components.

A cell with enough places is dense; dense cells that touch, also at a corner, are one cluster. Cells are counted first, so what is
connected are cells, however many places lie in one. Components are found by alternating large and small stars, whose rounds
grow with the logarithm of the cells; each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantrail.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that edges (a, b) lead to, for every node of an edge; loops, copies and either direction are fine."""
    pairs = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        after = written(small)
        same = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first() == pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        pairs = after
        if same:
            break
    roots = pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return written(roots.unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()).distinct())


_SIDE = 1 << 24


def _number(x: Column, y: Column) -> Column:
    """One whole number for a cell of two numbers below 2^23 in size."""
    return (x + _SIDE // 2) * _SIDE + y + _SIDE // 2


def dense_clusters(places: DataFrame, x: str, y: str, cell: float, least: int) -> DataFrame:
    """``places`` with ``cluster``, the number of the least cell of their cluster, null outside of dense cells and for places without a position. Both
    coordinates lie within 2^23 cells of zero. A cell that holds any share of the places is one row of all that follows its count."""
    at = lambda c: F.floor(F.col(c) / cell).cast("bigint")
    numbered = places.withColumn("cell_of", _number(at(x), at(y)))
    dense = written(numbered.where(F.col("cell_of").isNotNull()).groupBy("cell_of").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cell_of"))
    ways = F.array(*[F.lit(dx * _SIDE + dy).cast("bigint") for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1))])
    near = dense.select(F.col("cell_of").alias("a"), F.explode(F.transform(ways, lambda w: w + F.col("cell_of"))).alias("b"))
    edges = near.join(dense.select(F.col("cell_of").alias("b")), "b", "left_semi").select("a", "b")
    roots = components(edges).select(F.col("node").alias("cell_of"), "root")
    labels = dense.join(roots, "cell_of", "left").select("cell_of", F.coalesce("root", "cell_of").alias("cluster"))
    return numbered.join(labels, "cell_of", "left").drop("cell_of")


def places_at(fixes: DataFrame, seconds: float = 0.0) -> DataFrame:
    """(source, flight_id, t, lat, lon): each flight's first fix at or after ``seconds`` of its own clock, its take-off for 0; flights that end before it have
    none."""
    own = fixes.where(F.col("t") >= seconds).groupBy("source", "flight_id").agg(F.min_by(F.struct("t", "lat", "lon"), F.struct("t", "fix_no")).alias("p"))
    return own.select("source", "flight_id", "p.*")


def cluster_table(places: DataFrame) -> DataFrame:
    """(cluster, flights, lat, lon) of places with clusters: how many flights each has, and its centre; the null cluster is all that is in none."""
    return places.groupBy("cluster").agg(F.count("*").alias("flights"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
