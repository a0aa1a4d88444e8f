"""Best-fit packing of token sequences by the sum-of-squares rule.

Pieces go into sequences of one capacity. With N(g) open sequences of residual gap g, a piece of length s goes where
the sum of N(g)^2 becomes smallest: opening a sequence adds 2 N(C-s) + 1; filling one of gap g adds
1 - 2 N(g) + 2 N(g-s) + 1, the part in N(g-s) falling away when the gap closes. Of equal changes the tightest gap wins
and an open sequence wins over a new one. Pieces are taken longest first, so short ones close what long ones leave.

Scale: the rule needs lengths only. Pieces are dealt by a hash of their own key to groups of about ``group_size``, and
each group is packed in one task whose memory is its lengths; the token ids never need to move for it. A group leaves a
few sequences partly filled, a share that falls as 1 / group_size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantrail.llm.common import checkpointed, text_slices, workers_import
from vantrail.llm.tokens import library_encoder


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence number and offset of each piece, and the number of sequences. Lengths are 0 to capacity.

    The rule runs twice, once free to open a sequence whenever that gives the smallest sum and once only where nothing
    open fits; the result with fewer sequences stays.
    """
    free, thrifty = _place(lengths, capacity, False), _place(lengths, capacity, True)
    return thrifty if thrifty[2] <= free[2] else free


def _place(lengths: np.ndarray, capacity: int, thrifty: bool) -> tuple[np.ndarray, np.ndarray, int]:
    lengths = np.asarray(lengths, dtype=np.int64)
    if lengths.size and (lengths.min() < 0 or lengths.max() > capacity):
        raise ValueError("a piece is longer than a sequence")
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    where, offset = np.empty(lengths.size, dtype=np.int64), np.empty(lengths.size, dtype=np.int64)
    made = 0
    far = np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        if s == 0:  # takes no room: at the start of the first sequence
            where[i], offset[i] = 0, 0
            made = max(made, 1)
            continue
        gaps = count[s:]  # gap g at g - s, which is also the gap left
        change = np.where(gaps > 0, 2 * (count[: capacity + 1 - s] - gaps) + 2, far)
        change[0] = 1 - 2 * gaps[0] if gaps[0] else far  # closes the gap
        k = int(change.argmin())  # the first minimum is the tightest
        new = 2 * count[capacity - s] + 1 if s < capacity else 0
        if change[k] != far and (thrifty or change[k] <= new):
            gap = s + k
            b = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        where[i], offset[i] = b, capacity - gap
        left = gap - s
        if left:
            open_by_gap[left].append(b)
            count[left] += 1
    return where, offset, made


def pack(items: DataFrame, length: str = "length", capacity: int = 4096, group_size: int = 65536) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``; all other columns ride along.

    A null length counts as 0; a zero-length piece lies at the start of its group's first sequence. Repeated rows are
    packed each by itself. No rows give no rows. ``items`` is read twice (count, then pack): pass what is cheap to read
    again, or a checkpoint. A length over ``capacity`` is an error: cut first. Columns named ``sequence_id`` or
    ``offset`` are replaced.
    """
    items = items.drop("sequence_id", "offset", "__group")
    n_groups = max(1, -(-items.count() // group_size))
    others = [F.col(f"`{c}`") for c in items.columns]
    grouped = items.withColumn("__group", F.pmod(F.xxhash64(*others), F.lit(n_groups)))
    fields = [*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def one_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(by=[c for c in group.columns if group[c].dtype != object], kind="stable").drop(columns="__group")
        where, offset, _ = sum_of_squares(group[length].fillna(0).to_numpy(), capacity)
        return group.assign(sequence_id=where * n_groups + int(key[0]), offset=offset)

    return grouped.groupBy("__group").applyInPandas(one_group, T.StructType(fields))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token pieces of each document: (key, piece, start, length, ids) with ids as little-endian unsigned 32-bit bytes.

    A document is its ids, then ``end_id``; one longer than ``capacity`` is cut into full pieces and a last, maybe
    shorter one. A null text is empty: one piece holding ``end_id``. A null key stays null; repeated rows repeat.
    """
    workers_import(docs.sparkSession)
    docs = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    end, width = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        for batch, _, _ in text_slices(batches, 1):
            row, piece, ids = [], [], []
            for i, b in enumerate(encoder.encode(batch.column(1).to_pylist())):
                b += end
                for k, lo in enumerate(range(0, len(b), width)):
                    row.append(i)
                    piece.append(k)
                    ids.append(b[lo : lo + width])
            n = pa.array(piece, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), n, pa.array([k * capacity for k in piece], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[key, "piece", "start", "length", "ids"])

    return docs.mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, group_size: int = 65536, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places. ``keep_ids=False`` leaves the ids behind with only their checksum,
    so a few dozen bytes a piece move through the shuffle instead of up to 16 KB."""
    cut = pieces(docs, tokenizer, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    if not keep_ids:
        cut = cut.drop("ids")
    return pack(checkpointed(cut), "length", capacity, group_size)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, n_tokens, ids), the ids of its pieces in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"]))).alias("h")).select("sequence_id", "n_tokens", F.unhex("h").alias("ids"))
