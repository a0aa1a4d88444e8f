"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantrail.llm import bpe, codes, exactdup, linedup, neardup, packing, quality, secrets, sharding, sstable, topk, transducer
from vantrail.llm.common import read_table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), keep_ids=False)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, host=F.col("source"), path=F.col("lang"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read_table(spark, sf_dir, "documents"), [1.0] * 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").where(topk.finite("embedding"))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double"))).alias("v"))
    return topk.exact_top_k(whole, F.col("vec_id") % 20 == 0, k=20)


def op7_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = transducer.count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BYTE_BPE))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_dedup(exactdup.digested(read_table(spark, sf_dir, "documents")))


def op9_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    manifest = sstable.write_tables(docs, public_tokenizers.path(BYTE_BPE), sstable.scratch_folder(spark))
    back = sstable.read_tables(manifest, docs.schema["doc_id"].dataType)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_dedup(read_table(spark, sf_dir, "documents"))


def op11_annular(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(read_table(spark, sf_dir, "embeddings"))
    digits = F.lower(F.hex("codes")).alias("code")
    return codes.error_by(coded, "label").select("row.vec_id", digits, "error", "label_error", F.lit(codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != secrets.FORMAT)
    return found.select("doc_id", *[of(k) for k in secrets.KINDS], F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack, op2_quality, op3_shard, op4_bpe, op5_near_dedup, op6_topk, op7_count, op8_exact_dedup, op9_tables, op10_line_dedup, op11_annular, op12_secrets)}


def oracle_sql() -> dict[str, str]:
    return {"op3_shard": OP3, "op6_topk": OP6, "op8_exact_dedup": OP8, "op11_annular": _op11()}


#: The checksum runs over bytes with a table of the reflected polynomial 0xEDB88320.
OP3 = """
WITH t AS (
  SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM range(0, 256) r(i)
), tbl AS (SELECT list(v ORDER BY i) AS t FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS s FROM documents),
bytes AS (
  SELECT r, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM d
), crc AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS crc FROM bytes, tbl
), draws AS (
  SELECT r, s.s AS shard, ('0x' || md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s.s)[1:13])::BIGINT AS u FROM d, range(0, 17) s(s)
), best AS (
  SELECT r, arg_max(shard, u) FILTER (shard < 16) AS shard, arg_max(shard, u) AS grown FROM draws GROUP BY r
)
SELECT d.doc_id, strlen(d.s) + 1 AS size, crc AS text_crc32, 'key' AS law, best.shard::INTEGER AS shard, row_number() OVER (PARTITION BY best.shard ORDER BY d.doc_id NULLS FIRST) - 1 AS slot, grown::INTEGER AS grown_shard
FROM d JOIN crc USING (r) JOIN best USING (r)
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP8 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def _op11(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """A round is two of these tables: the nearest entries of all parts, and the entries that follow from them. All numbers are
    whole and far below 2^53, so doubles and their quotients' floors are exact."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM v, range(0, {parts}) p(p)
), b0 AS (SELECT p, r - 1 AS e, x AS c FROM x WHERE r <= {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * {entries} + e) AS m
  FROM x JOIN b{n} USING (p) GROUP BY r, p
)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (
  SELECT p, m % {entries} AS e, i, floor(sum(x[i]) / count(*)) AS c FROM a{n}, range(1, (SELECT max(len(x)) FROM x) + 1) i(i) GROUP BY ALL
), m{n} AS (SELECT p, e, list(c ORDER BY i) AS c FROM s{n} GROUP BY p, e),
b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.e = m.e)""")
    return "WITH" + ",".join(steps) + f""",
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
d AS (SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN d USING (r), h
"""
