"""Exact deduplication with a heavy-hitter split.

A text's digest is the SHA-256 of its UTF-8 after each run of ASCII white space became one space. Misra-Gries summaries
(Spark's ``approx_top_k`` keeps one, in its counter-decrementing form) find the digests that may be frequent: every
digest with more than 1 in ``tracked`` of a summary's rows is in it. Their exact sizes and smallest keys are then
counted over all rows, and these verified winners, at most a few thousand rows however large the input, are broadcast:
copies of a frequent text meet their winner on the map side and never travel to one task. All other digests use an
ordinary shuffle, where no group is larger than a small share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantrail.llm.common import ASCII_SPACE, checkpointed, drop_marked, text_or_empty, utf8, whole_row

#: Counters of each Misra-Gries summary, and summaries, each of the rows of some map tasks.
TRACKED, SUMMARIES = 1024, 16
#: A digest is a candidate from 1 in so many rows; the counters sum to the rows, so about as many candidates exist.
SHARE = 1024


def digested(docs: DataFrame, text: str = "text", out: str = "text_sha256") -> DataFrame:
    """``docs`` with ``out``, lowercase hexadecimal."""
    return docs.withColumn(out, F.sha2(utf8(F.regexp_replace(text_or_empty(text), ASCII_SPACE, " ")), 256))


def frequent(rows: DataFrame, digest: str = "text_sha256") -> DataFrame:
    """Candidates (h): 64-bit hashes of the digests that may be frequent, no more than 2 SHARE + 1 of them."""
    tops = (
        rows.select(F.xxhash64(digest).alias("h"), F.pmod(F.spark_partition_id(), F.lit(SUMMARIES)).alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k(h, {TRACKED}, {2 * TRACKED})").alias("top"), F.count("*").alias("n"))
    )
    total = tops.agg(F.sum("n").alias("total"))
    found = tops.select(F.explode("top").alias("t")).groupBy(F.col("t.item").alias("h")).agg(F.sum("t.count").alias("n"))
    return found.crossJoin(F.broadcast(total)).where((F.col("n") > 1) & (F.col("n") * SHARE >= F.col("total"))).select("h")  # total is one row


def exact_dedup(rows: DataFrame, key: str = "doc_id", digest: str = "text_sha256") -> DataFrame:
    """(key, keep_id, group_size, kept, digest) for every row; of equal digests the smallest key stays.

    A null key comes after all others and is kept only where its group has no other key. Of repeated rows with the key
    that stays, each says kept, and ``exact_dedup_rows`` keeps one. No rows give no rows.
    """
    rows = checkpointed(rows.select(key, digest))
    heavy = checkpointed(
        rows.join(F.broadcast(frequent(rows, digest)), F.xxhash64(digest) == F.col("h"), "left_semi").groupBy(digest).agg(F.min(key).alias("keep_id"), F.count("*").alias("group_size"))
    )
    split = rows.join(F.broadcast(heavy), digest, "left")  # heavy: see frequent()
    of = Window.partitionBy(digest)
    light = split.where(F.col("group_size").isNull()).select(key, digest).select(key, F.min(key).over(of).alias("keep_id"), F.count("*").over(of).alias("group_size"), digest)
    found = split.where(F.col("group_size").isNotNull()).select(key, "keep_id", "group_size", digest).unionByName(light)
    return found.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), digest)


def exact_dedup_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; of rows repeated under the key that stays, one.

    Keys and digests are compared first; then texts are read once more. No rows give no rows.
    """
    named = digested(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), out="digest").select("key", "digest")
    marks = checkpointed(exact_dedup(named, "key", "digest").select("key", "digest", "kept"))
    repeated = marks.where("kept").groupBy("key", "digest").count().where("count > 1")
    rows = digested(docs.select(whole_row(docs), F.col(key).alias("key"), F.col(text).alias("text")), out="digest").select("row", "key", "digest")
    return drop_marked(rows, marks.where("not kept"), repeated, ["key", "digest"]).select("row.*")
