"""Exact top-k inner products with vector-approximation files.

Each dimension's range over all vectors is cut into 2^bits equal cells, and a vector's approximation is its cell in each
dimension, a byte. Cells bound a query's inner product from above and below: positive query components take the cell's
upper edge for the upper bound, negative ones its lower edge, and the other way round for the lower bound.

Of equal vectors only those of the smallest ids can be among the best, and only these are approximated, so a vector on a
third of all rows costs no more than others.

1. Filter. The approximations, an eighth of the exact vectors, are dealt in blocks to the queries' blocks. A task scans
   them, keeps for each query the k-th best lower bound so far, and passes on the places whose upper bound reaches it, with
   that bound; no exact vector is there. The k-th best lower bound over all blocks then drops most of these.
2. Refinement. Exact vectors are read for the places that are left, of a query in the order of their bounds, best first,
   until the k-th exact score is above the next bound.

Scale: every approximation is scanned for every query, as exactness asks; ``block`` approximations meet ``asked`` queries in a
task, so the file is sent once for so many queries, and what travels onward is some multiple of k places a query and block. Vectors are compared within one dimension. The edges of the cells are one
row of numbers a dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantrail.llm.common import checkpointed, workers_import

#: Exact vectors read for a query at first, in multiples of k.
STEP = 2
#: Approximations bounded at once, and the fewest of a block where blocks are made smaller to occupy all cores.
PART, SMALLEST = 2048, 4096
#: Queries that a task bounds at once of those that it holds.
TOGETHER = 4096


def finite(vector: str) -> Column:
    """Neither null nor holding a null, a NaN or an infinity."""
    inf = float("inf")
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < inf)), F.lit(False))


def cells_of(vectors: np.ndarray, lo: np.ndarray, width: np.ndarray, bits: int) -> np.ndarray:
    """The approximation: a byte for each component."""
    return np.clip(np.floor((vectors - lo) / width), 0, (1 << bits) - 1).astype(np.uint8)


def scan_block(queries: np.ndarray, query_ids: np.ndarray, cells: np.ndarray, ids: np.ndarray, lo: np.ndarray, width: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query position, place, upper bound, lower bound) of what may be among a query's k best of a block, by bounds alone. A block is taken
    in parts of ``PART``; a query's k-th best lower bound so far decides what of a part it keeps, and the last one what passes."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    slack = 1e-9 * (1 + np.abs(queries) @ np.maximum(np.abs(lo), np.abs(lo + 256 * width))) + 1e-6
    more, less = (plus @ width + slack)[:, None], (minus @ width - slack)[:, None]
    best = np.full((len(queries), k), -np.inf)
    kept = []
    for start in range(0, len(ids), PART):
        base = queries @ (cells[start : start + PART].astype(np.float64) * width + lo).T
        base[query_ids[:, None] == ids[None, start : start + PART]] = -np.inf
        best = -np.partition(-np.concatenate([best, base + less], axis=1), k - 1, axis=1)[:, :k]
        upper = base + more
        q, at = np.nonzero((upper >= best.min(axis=1)[:, None]) & (upper > -np.inf))
        kept.append((q, at + start, upper[q, at], base[q, at] + less[q, 0]))
    q, at, upper, lower = (np.concatenate(x) for x in zip(*kept, strict=True))
    last = upper >= best.min(axis=1)[q]
    return q[last], at[last], upper[last], lower[last]


def refine(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, upper: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best of the candidates, reading vectors by their bounds, best first, until the k-th is certain."""
    order = np.lexsort((ids, -upper))
    best_s, best_i, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, STEP * k
    while at < len(order) and not (len(best_s) >= k and best_s[k - 1] > upper[order[at]]):
        read = order[at : at + step]
        at, step = at + step, 2 * step
        score = vectors[read] @ query
        best_s, best_i = np.concatenate([best_s, score]), np.concatenate([best_i, ids[read]])
        ranked = np.lexsort((best_i, -best_s))[:k]
        best_s, best_i = best_s[ranked], best_i[ranked]
    return [(int(i), int(s)) for i, s in zip(best_i, best_s, strict=True)]


def _matrix(column: pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "v", key: str = "vec_id", bits: int = 8, block: int = 65_536, asked: int = 65_536) -> DataFrame:
    """(query_id, rank, key, score): each query row's k largest integer inner products over all rows but its own.

    ``vector`` is an array of whole numbers stored as bigint or double, below 2^53. Rows whose vector or key is null take no part. Of a
    key on several rows each row is a candidate for other queries, and none for its own; as a query the least vector counts. With fewer
    candidates a query has fewer rows; with none, no row. No rows give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    workers_import(spark)
    rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.monotonically_increasing_id().alias("place"), F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("bigint")).alias("v"), is_query.alias("q"), F.size(vector).alias("dim"))
    rows = checkpointed(rows)
    n_rows, n_queries = rows.count(), rows.where("q").count()
    n_q = max(1, -(-n_queries // asked))
    n_v = max(1, -(-n_rows // block), min(-(-n_rows // SMALLEST), -(-spark.sparkContext.defaultParallelism // n_q)))
    found = rows.select("dim", F.posexplode("v").alias("d", "x")).groupBy("dim", "d").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # a row a component
    edges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r.dim for r in found}:
        own = sorted((r.d, r.lo, r.hi) for r in found if r.dim == dim)
        lo = np.array([x[1] for x in own], dtype=np.float64)
        edges[dim] = lo, np.maximum((np.array([x[2] for x in own]) - lo) / (1 << bits), 1e-9)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            dims = batch.column(2).to_pylist()
            cells = [cells_of(flat[at[i] : at[i + 1]], *edges[d], bits).tobytes() if d else b"" for i, d in enumerate(dims)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cells, pa.binary())], names=["place", "id", "dim", "cells"])

    first = lambda n, *of: F.row_number().over(Window.partitionBy(*of).orderBy("id", "place")) <= n
    # of equal vectors the k smallest ids but the query's own can be among its best: at most k rows of one id, and 2 k rows
    whole = rows.where("size(v) > 0").withColumn("own", first(k, "v", "id")).where("own").withColumn("few", first(2 * k, "v")).where("few")
    file = checkpointed(whole.select("place", "id", "dim", "v").mapInArrow(approximate, "place long, id long, dim int, cells binary"))
    asks = checkpointed(rows.where("q").groupBy("id", "dim").agg(F.min("v").alias("v")).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_q))))
    nothing = lambda kind: F.lit(None).cast(kind)
    side = asks.select("dim", "qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_v - 1).cast("bigint"))).alias("vb"), nothing("bigint").alias("place"), "id", "v", nothing("binary").alias("cells"))
    base = file.select("dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))).alias("qb"), F.pmod("place", F.lit(n_v)).alias("vb"), "place", "id", nothing("array<bigint>").alias("v"), "cells")

    def scan(group: pa.Table) -> pa.Table:
        is_file = pc.is_valid(group["cells"])
        ask, own = group.filter(pc.invert(is_file)), group.filter(is_file)
        dim = group["dim"][0].as_py()
        q = at = np.empty(0, np.int64)
        upper = lower = np.empty(0)
        ids, places, asking = (x.to_numpy() for x in (own["id"], own["place"], ask["id"]))
        if len(ask) and len(own) and dim:
            cells = np.frombuffer(b"".join(own["cells"].to_pylist()), dtype=np.uint8).reshape(-1, dim)
            vectors = _matrix(ask["v"], dim, np.float64)
            found = [scan_block(vectors[i : i + TOGETHER], asking[i : i + TOGETHER], cells, ids, *edges[dim], k) for i in range(0, len(ask), TOGETHER)]
            q = np.concatenate([f[0] + i * TOGETHER for i, f in enumerate(found)])
            at, upper, lower = (np.concatenate([f[j] for f in found]) for j in (1, 2, 3))
        return pa.table({"query_id": pa.array(asking[q], pa.int64()), "place": pa.array(places[at], pa.int64()), "upper": upper, "lower": lower})

    passed = side.unionByName(base).groupBy("dim", "qb", "vb").applyInArrow(scan, "query_id long, place long, upper double, lower double")
    passed = checkpointed(passed)
    best = Window.partitionBy("query_id").orderBy(F.desc("lower"), "place")
    least = passed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("query_id").agg(F.min("lower").alias("least"), F.count("*").alias("n"))
    alive = passed.join(least, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("least")))
    alive = alive.select("query_id", "place", "upper").join(rows.select("place", "id", "v"), "place")
    asking = asks.select(F.col("id").alias("query_id"), "v").withColumns({"place": nothing("bigint"), "upper": nothing("double"), "id": nothing("bigint")})

    def read(group: pa.Table) -> pa.Table:
        is_ask = pc.is_null(group["place"])
        ask, own = group.filter(is_ask), group.filter(pc.invert(is_ask))
        top: list[tuple[int, int]] = []
        if len(own):
            query = np.array(ask["v"][0].as_py(), dtype=np.int64)
            top = refine(query, _matrix(own["v"], len(query), np.int64), own["id"].to_numpy(), own["upper"].to_numpy(), k)
        n = len(top)
        return pa.table({"query_id": pa.array([group["query_id"][0].as_py()] * n, pa.int64()), "rank": pa.array(range(1, n + 1), pa.int32()), key: pa.array([i for i, _ in top], pa.int64()), "score": pa.array([s for _, s in top], pa.int64())})

    return alive.unionByName(asking).groupBy("query_id").applyInArrow(read, f"query_id long, rank int, {key} long, score long")
