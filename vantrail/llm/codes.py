"""Vector codes: product quantisation with integer k-means, nearest entries found by annular norm pruning.

A vector of whole numbers is cut into equal consecutive parts, and each part position has a codebook. An entry at distance d
of a part has a norm within d of the part's norm. So the entries of a codebook are sorted by norm; what lies nearest in norm
is measured first, and the best distance so far bounds an annulus, an interval of norms that binary search finds, ends
included. Only entries inside it are measured, nearest in norm first, and each better distance makes it narrower. Ties go to
the lower index.

Parts are taken in order of their norms, ``GROUP`` at a time: the annuli of neighbours nearly coincide, so their union is one
small product of matrices, and an entry outside of a part's own annulus never counts for it. All numbers are whole: floats
serve where every square sum is below 2^53, 64-bit integers beyond.

Scale: a round reads the table of whole vectors once and makes one sum and count a codebook entry and task, which Spark adds
up by entry; nothing else is shuffled. Codebooks, entries * dimension numbers, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantrail.llm.common import bounded, checkpointed, whole_row, workers_import

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Parts that are measured together; entries that their annulus grows by at a time, on either side.
GROUP, RING = 64, 24
#: Vectors a worker takes apart at once.
ROWS = 4096


def whole_vectors(vectors: DataFrame, vector: str, scale: float) -> DataFrame:
    """(row, v): every column as one struct, and floor(scale * x) of each component; vectors that are null or hold a null or a
    component that is not finite are left out."""
    x = F.col(vector)
    finite = x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    return vectors.where(finite).select(whole_row(vectors), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry, ties to the lower index. Both are whole numbers, a row each."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * max(1, points.shape[1]) * most * most < 1 << 53 else np.int64
    by_norm = np.argsort((entries**2).sum(axis=1), kind="stable")
    ring = entries[by_norm].astype(kind)
    ring_sq = (ring * ring).sum(axis=1)
    norms = np.sqrt(ring_sq.astype(np.float64))
    points_sq = (points**2).sum(axis=1)
    order = np.argsort(points_sq, kind="stable")
    index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for lo in range(0, len(order), GROUP):
        own = order[lo : lo + GROUP]
        x, x_sq = points[own].astype(kind), points_sq[own].astype(kind)
        norm = np.sqrt(x_sq.astype(np.float64))
        best = np.full(len(own), np.inf if kind is np.float64 else np.iinfo(np.int64).max, dtype=kind)
        at = np.full(len(own), len(entries), np.int64)
        begin = end = int(np.searchsorted(norms, norm[len(own) // 2]))  # what has been measured: [begin, end)
        left, right = np.zeros(len(own), np.int64), np.full(len(own), len(entries), np.int64)  # the annuli
        while begin > left.min() or end < right.max():
            for a, b in ((max(int(left.min()), begin - RING), begin), (end, min(int(right.max()), end + RING))):
                if a >= b:
                    continue
                d = x_sq[:, None] - 2 * (x @ ring[a:b].T) + ring_sq[a:b]
                places = np.arange(a, b)
                inside = (places >= left[:, None]) & (places < right[:, None])
                d = np.where(inside, d, best[:, None])
                least = d.min(axis=1)
                winner = np.where((d == least[:, None]) & inside, by_norm[a:b], len(entries)).min(axis=1)
                better = (least < best) | ((least == best) & (winner < at))
                best, at = np.where(better, least, best), np.where(better, winner, at)
            begin, end = min(begin, max(int(left.min()), begin - RING)), max(end, min(int(right.max()), end + RING))
            reach = np.sqrt(best.astype(np.float64))
            slack = 1e-9 * (1 + norm + reach)
            left, right = np.searchsorted(norms, norm - reach - slack, "left"), np.searchsorted(norms, norm + reach + slack, "right")
        index[own], distance[own] = at, best.astype(np.int64)
    return index, distance


def _matrices(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches, which of their rows have ``dim`` components, and these rows as a matrix."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            lists = part.column(column)
            fits = lists.value_lengths().to_numpy(zero_copy_only=False) == dim
            flat = lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield part, fits, flat.reshape(int(fits.sum()), dim)


def dimension(whole: DataFrame, parts: int) -> int | None:
    """The most frequent number of components that ``parts`` divides, the larger of several; None without rows."""
    sizes = whole.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, F.abs(x)))).alias("most"))
    found = sizes.where(F.col("dim") % parts == 0).orderBy(F.desc("n"), F.desc("dim")).first()
    if found is None:
        return None
    if found.dim * 4 * int(found.most) ** 2 >= 1 << 62:
        raise ValueError(f"components up to {found.most} have square sums beyond 64 bits; choose a smaller scale")
    return found.dim


def fit_codebooks(whole: DataFrame, order: list[Column], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks of shape (parts, entries, components a part) for a written table with a column ``v`` of whole vectors.

    They start as the parts of the first ``entries`` vectors by ``order``; fewer vectors give fewer entries, none give none.
    Each round moves every entry that some part is nearest to to the floor of the mean of its parts; the others stay.
    """
    spark = whole.sparkSession
    workers_import(spark)
    dim = dimension(whole, parts)
    if dim is None:
        return np.zeros((parts, 0, 0), np.int64)
    first = whole.where(F.size("v") == dim).orderBy(*order, "v").limit(entries).select("v").collect()  # rows of the codebooks
    books = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    width = dim // parts
    vectors = whole.select("v")
    for _ in range(rounds if width else 0):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for _, _, x in _matrices(batches, 0, dim):
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    code, _ = nearest(own, books[p])
                    np.add.at(total[p], code, own)
                    count[p] += np.bincount(code, minlength=books.shape[1])
            p, e = np.nonzero(count)
            place = (p * books.shape[1] + e)[:, None] * width + np.arange(width)
            yield pa.RecordBatch.from_arrays([pa.array(place.ravel(), pa.int64()), pa.array(total[p, e].ravel(), pa.int64()), pa.array(np.repeat(count[p, e], width), pa.int64())], names=["place", "total", "n"])

        added = vectors.mapInArrow(sums, "place long, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        moved = books.copy().ravel()
        for r in added.collect():  # a number a component of the codebooks
            moved[r.place] = r.total // r.n
        books = moved.reshape(books.shape)
    return books


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """``whole`` with a column ``codes``, a byte a part, and ``error``, the squared distances of the parts to their entries, summed.
    Both are null where a vector has not the codebooks' number of components."""
    workers_import(whole.sparkSession)
    parts, _, width = books.shape
    at = whole.columns.index("v")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, fits, x in _matrices(batches, at, parts * width):
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                code, distance = nearest(x[:, p * width : (p + 1) * width], books[p])
                codes[:, p], error = code, error + distance
            found = iter(zip((c.tobytes() for c in codes), error.tolist(), strict=True))
            both = [next(found) if f else (None, None) for f in fits]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c for c, _ in both], pa.binary()), pa.array([e for _, e in both], pa.int64())], names=[*part.schema.names, "codes", "error"])

    return whole.mapInArrow(coded, whole.select("*", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("bigint").alias("error")).schema)


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with a column ``approximate``: the entries that the codes name, one after the other; null where ``codes`` is."""
    workers_import(coded.sparkSession)
    at = coded.columns.index("codes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [None if c is None else np.concatenate([books[p, e] for p, e in enumerate(c)]).tolist() for c in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.list_(pa.int64()))], names=[*batch.schema.names, "approximate"])

    return coded.mapInArrow(read, coded.select("*", F.lit(None).cast("array<bigint>").alias("approximate")).schema)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(row, v, codes, error) of every vector that takes part, and the codebooks: ``row`` holds the columns of ``vectors``, v is floor(scale * x).

    The first vectors, which the codebooks start from, are those of the smallest keys, each row of a repeated key, a null key
    after all others, equal keys by their vectors. Vectors that are null or hold a null or a component that is not finite are
    left out. With vectors of several lengths the codebooks are for the most frequent one that ``parts`` divides; the others
    keep their rows with null codes. No vectors give no rows and empty codebooks. Components whose square sums are beyond 64
    bits are an error. Columns of any name are carried.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    whole = checkpointed(whole_vectors(vectors, vector, scale))
    books = fit_codebooks(whole, [F.col("row").getField(key).asc_nulls_last()], parts, entries, rounds)
    if not books.size and not books.shape[1]:
        return whole.withColumns({"codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("bigint")}), books
    return checkpointed(encode(whole, books)), books


def error_by(coded: DataFrame, label: str) -> DataFrame:
    """``coded``, what ``compress`` gave, with ``label_error``: the errors of all rows with an equal label, nulls together, summed. One
    label may hold any share of the rows: they are summed where they lie."""
    own = coded.withColumn("label_of", F.col("row").getField(label))
    sums = checkpointed(own.groupBy(F.col("label_of").alias("of")).agg(F.sum("error").alias("label_error")))
    return own.join(bounded(sums), own["label_of"].eqNullSafe(sums["of"]), "left").drop("of", "label_of")
