"""The registered queries of the jobs: each runs its function twice over the whole tables, into one new folder, and returns all the output."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import track_census, verify_texts
from vantrail.plans.queries import rounded
from vantrail.plans.sql import STATS, STEPS, VIEW, query, r
from vantrail.session import shared_dir


def job1_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental: the second run finds nothing new."""
    out = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        checks = verify_texts.run(spark, f"{sf_dir.rstrip('/')}/documents.parquet", f"{out}/data", f"{out}/mark")
    return checks


def job2_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run replaces what the first has written."""
    out = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        flights = track_census.run(spark, f"{sf_dir.rstrip('/')}/events.parquet", f"{sf_dir.rstrip('/')}/customer.parquet", out)
    return rounded(flights)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_verify, job2_census)}


_LINES = r"string_split_regex(s, '\r\n|\r|\n')"
JOB1 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS s FROM documents),
l AS (SELECT *, octet_length(encode(s)) AS n_bytes, {_LINES} AS lines FROM d),
c AS (SELECT *, CASE WHEN n_bytes < 100 THEN 'too_small' WHEN coalesce(list_filter(lines, lambda x: trim(x) <> '')[1] LIKE 'T%', false) AND len(list_filter(lines, lambda x: starts_with(x, 'A'))) > 0 THEN 'sound' ELSE 'invalid_structure' END AS category FROM l)
SELECT doc_id, source, n_bytes::BIGINT AS n_bytes, len(lines)::BIGINT AS n_lines, len(list_filter(lines, lambda x: starts_with(x, 'A')))::BIGINT AS n_body, category <> 'sound' AS failure, category FROM c
"""

_MEASURES = ["duration_s", "path_km", "extent_km", "dt_s", "baro_present_frac", "max_vxy_mps", "max_vz_mps", "baro_alt_min_m", "baro_alt_max_m", "max_gap_ratio", "missing_fraction"]
JOB2 = query(
    f"""SELECT source, flight_id, period, stratum, n_fix, {', '.join(map(r, _MEASURES))},
  CASE WHEN duration_s < 2400 THEN 'too_short' WHEN duration_s > 57600 THEN 'too_long' WHEN path_km < 20 THEN 'short_path' WHEN baro_alt_max_m - baro_alt_min_m < 75 THEN 'flat' END AS reason
FROM st JOIN pe USING (flight_id) LEFT JOIN ca USING (flight_id)""",
    VIEW,
    STEPS,
    STATS,
    "pe AS (SELECT user_id AS flight_id, strftime(min(ts), '%Y-%m-%d') AS period FROM events GROUP BY 1)",
    "ca AS (SELECT c_custkey AS flight_id, min(c_mktsegment) AS stratum FROM customer GROUP BY 1)",
)


def oracle_sql() -> dict[str, str]:
    return {"job1_verify": JOB1, "job2_census": JOB2}
