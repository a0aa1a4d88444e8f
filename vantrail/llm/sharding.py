"""Sharding by weighted rendezvous hashing of a stable key.

Each shard s has for key k the draw u(k, s) in (0, 1), from the first 52 bits of md5("k:s"), and the score
-ln(u) / weight(s); the smallest score takes the row, so a shard gets rows in proportion to its weight. The key and the
list of shards alone decide: a new shard takes from every other only the rows on which it scores best, and moves none
between the old ones.

Scale: the choice is a map-side expression of a few dozen bytes of key. Slots follow the key's order
within a shard without gathering the shard: quantiles of the key cut its range into ``buckets`` parts, each (shard,
bucket) is numbered by itself, and the counts of shards x buckets, a few thousand rows at any input size, give the
offsets. A key so frequent that it is a quantile has parts of its own, dealt round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantrail.llm.common import checkpointed, text_or_empty, utf8

#: Fixed value: hexadecimal digits of the digest that make a draw; 13 digits are 52 bits, exact in a double.
_DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    digest = F.md5(utf8(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}"))))
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("bigint").cast("double") + 0.5) / float(16**_DIGITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, from 0. A shard of weight 0 takes nothing; equal scores go to the lower shard; a null key is
    a key like any other."""
    live = [(s, w) for s, w in enumerate(weights) if w > 0]
    if not live or any(w < 0 for w in weights):
        raise ValueError("weights: none negative, at least one positive")
    scores = [F.struct((-F.log(draw(key, s)) / F.lit(float(w))).alias("score"), F.lit(s).alias("shard")) for s, w in live]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def slots(rows: DataFrame, key: str, shard: str = "shard", buckets: int = 64) -> DataFrame:
    """``rows`` with ``slot``: a number within the shard, gapless from 0, in the order of ``key``, nulls first; rows
    with the same key follow in any order. A key that is no number is ordered by its hash. The rows are checkpointed
    first, so a row's part stays what it was when a lost executor makes a stage run again."""
    order = F.col(key) if isinstance(rows.schema[key].dataType, T.IntegralType) else F.xxhash64(F.col(key))
    rows = checkpointed(rows.withColumn("__key", F.when(F.col(key).isNotNull(), order)).withColumn("__deal", F.monotonically_increasing_id() % 16))
    cuts = rows.agg(F.percentile_approx("__key", [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0]  # at most buckets - 1 numbers
    cuts = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts or []))]).cast("array<bigint>")
    below, at_cut = F.size(F.filter(cuts, lambda c: c < F.col("__key"))), F.array_contains(cuts, F.col("__key"))
    part = F.when(F.col("__key").isNull(), F.col("__deal") - 16).when(at_cut, 17 * below + 1 + F.col("__deal")).otherwise(17 * below)
    rows = rows.withColumn("__part", part.cast("int")).drop("__deal")
    counts = rows.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(shard, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = rows.withColumn("__at", F.row_number().over(Window.partitionBy(shard, "__part").orderBy("__key")))
    return numbered.join(counts, [shard, "__part"]).withColumn("slot", (F.col("__before") + F.col("__at") - 1).cast("bigint")).drop("__part", "__before", "__at", "__key")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, key: str = "doc_id", text: str = "text", buckets: int = 64) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard): the law is ``key``. ``grown_shard`` is the shard with one more,
    of weight ``grown_weight``, at the end. A null text has no bytes: size 1, checksum 0. Rows with the same key go to
    the same shard and get slots of their own. No rows give no rows."""
    content = utf8(text_or_empty(text))
    placed = docs.select(
        F.col(key),
        (F.octet_length(content) + 1).cast("bigint").alias("size"),
        F.crc32(content).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
    )
    return slots(placed, key, "shard", buckets).select(key, "size", "text_crc32", "shard", "slot", "grown_shard")
