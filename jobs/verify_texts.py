"""Verify landed texts as they arrive: the content check of track archives over a table of texts.

Each run takes the input files that no run before it has taken (a file stream that ends when all present files are in; its
checkpoint is the mark), gives every text its category and appends it to ``checks``, partitioned by category. The report of
counts by group and category is then made anew from all of ``checks``.

    python -m jobs.verify_texts --input /data/documents.parquet --output /data/verified --checkpoint /data/verified-mark

``--checkpoint`` belongs to one output: a run that is stopped goes on from it, and a run without new files changes nothing. A
null text counts as empty. A text that lands again in another file is checked again and has a row for each file.
"""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantrail.functions import records

LOG = logging.getLogger("jobs.verify_texts")
CONFIG = Path(__file__).with_suffix(".yaml")
SOUND = "sound"


@dataclass(frozen=True)
class Settings:
    schema: str
    key: str
    text: str
    group: str
    header: str
    body: str
    least_bytes: int
    max_files: int


def load_settings(path: str | Path = CONFIG) -> Settings:
    """The settings of a YAML file; a missing or unknown key is an error."""
    import yaml

    return Settings(**yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def checked(texts: DataFrame, s: Settings) -> DataFrame:
    """(key, group, n_bytes, n_lines, n_body, failure, category), a row a text."""
    content = F.coalesce(F.col(s.text), F.lit(""))
    rows = texts.select(F.col(s.key), F.col(s.group), F.octet_length(content).cast("bigint").alias("n_bytes"), F.split(content, "\r\n|\r|\n").alias("lines"))
    problem = records.file_problem(F.col("lines"), F.col("n_bytes"), record=s.header, body=s.body, least=s.least_bytes)
    n_body = F.size(F.filter("lines", lambda x: x.startswith(s.body))).cast("bigint")
    return rows.select(s.key, s.group, "n_bytes", F.size("lines").cast("bigint").alias("n_lines"), n_body.alias("n_body"), F.coalesce(records.is_integrity_failure(problem), F.lit(False)).alias("failure"), F.coalesce(problem, F.lit(SOUND)).alias("category"))


def report(checks: DataFrame, s: Settings) -> DataFrame:
    """(group, category, n, n_bytes): how many texts of each group are sound or have a problem."""
    return checks.groupBy(s.group, "category").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))


def pattern(path: str) -> str:
    """A pattern that only ``path`` meets: file streams take a plain path for a folder, and here it may be one file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, input_path: str, output: str, checkpoint: str, settings: Settings | None = None) -> DataFrame:
    """Take the new files of ``input_path``, and return all of ``checks`` as it then stands."""
    s = settings or load_settings()
    texts = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", s.max_files).parquet(pattern(input_path))
    sink = checked(texts, s).writeStream.format("parquet").option("path", f"{output}/checks").option("checkpointLocation", checkpoint).partitionBy("category")
    stream = sink.trigger(availableNow=True).start()
    stream.awaitTermination()
    taken = sum(p["numInputRows"] for p in stream.recentProgress)
    LOG.info("read %d new rows of %s in %d batches", taken, input_path, sum(p["numInputRows"] > 0 for p in stream.recentProgress))
    checks = spark.read.schema(checked(spark.createDataFrame([], s.schema), s).schema).parquet(f"{output}/checks")
    counts = report(checks, s)
    counts.write.mode("overwrite").partitionBy("category").parquet(f"{output}/report")
    for r in spark.read.schema(counts.schema).parquet(f"{output}/report").groupBy("category").agg(F.sum("n").alias("n")).orderBy("category").collect():  # a row a category
        LOG.info("%s/checks holds %d rows of category %s", output, r.n, r.category)
    return checks


def main(argv: list[str] | None = None) -> int:
    """0 where every text of the archive is sound, 1 where some is damaged."""
    p = argparse.ArgumentParser(prog="jobs.verify_texts", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config", default=str(CONFIG))
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("verify-texts").getOrCreate()
    try:
        checks = run(spark, args.input, args.output, args.checkpoint, load_settings(args.config))
        return int(not checks.where("failure").isEmpty())
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
