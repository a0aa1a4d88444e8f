"""Census of the flights of an archive: their statistics, the cut that removes each or none, and their stratum in the catalog.

Events become tracks, tracks one row a flight, partitioned by discipline and the period in which the flight began; a summary
counts flights and cuts a period.

    python -m jobs.track_census --events /data/events.parquet --catalog /data/customer.parquet --output /data/census
    python -m jobs.track_census ... --periods 2024-01-03,2024-01-04

A run over everything replaces the output. With ``--periods`` only those partitions are written, and all others stay as they
are; a flight of which earlier events have come since belongs to another period, so name both. Either way a second run over
the same input gives the same rows. Flights that the catalog does not have keep a null stratum; of a catalog's key on several
rows the least stratum counts. Flights of fewer than two fixes have no statistics and no row.
"""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantrail.config import FlightLevel, Thresholds
from vantrail.operators import census
from vantrail.sources import tracks

LOG = logging.getLogger("jobs.track_census")
CONFIG = Path(__file__).with_suffix(".yaml")
PARTITIONS = ["source", "period"]


@dataclass(frozen=True)
class Settings:
    period: str
    catalog_key: str
    catalog_stratum: str
    limits: dict[str, Any] = field(default_factory=dict)

    @property
    def thresholds(self) -> Thresholds:
        return Thresholds(flight_level=FlightLevel(**self.limits))


def load_settings(path: str | Path = CONFIG) -> Settings:
    """The settings of a YAML file; a missing or unknown key is an error."""
    import yaml

    return Settings(**yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def flights_of(events: DataFrame, catalog: DataFrame, s: Settings, periods: list[str] | None = None) -> DataFrame:
    """A row a flight: source, period, flight_id, stratum, its statistics and the reason of its cut, null where it stays."""
    start = events.groupBy(F.col("user_id").alias("flight_id")).agg(F.date_format(F.min("ts"), s.period).alias("period"))
    if periods is not None:
        start = start.where(F.col("period").isin(periods))
        events = events.join(start.select(F.col("flight_id").alias("user_id")), "user_id", "left_semi")
    strata = catalog.groupBy(F.col(s.catalog_key).alias("flight_id")).agg(F.min(s.catalog_stratum).alias("stratum"))
    stats = census.track_stats(tracks.track_view(events))
    reason = census.flight_reason(F.col("duration_s"), F.col("path_km"), F.col("baro_alt_max_m") - F.col("baro_alt_min_m"), s.thresholds)
    rows = stats.withColumn("reason", reason).join(start, "flight_id").join(strata, "flight_id", "left")
    return rows.select("flight_id", "stratum", *[c for c in stats.columns if c not in census.KEYS], "reason", *PARTITIONS)


def summary(flights: DataFrame) -> DataFrame:
    """(source, period, n, n_kept, path_km, one count a cut)."""
    cuts = ("too_short", "too_long", "short_path", "flat")
    return flights.groupBy(*PARTITIONS).agg(F.count("*").alias("n"), F.count(F.when(F.col("reason").isNull(), 1)).alias("n_kept"), F.sum("path_km").alias("path_km"), *[F.count(F.when(F.col("reason") == c, 1)).alias(f"n_{c}") for c in cuts])


def run(spark: SparkSession, events_path: str, catalog_path: str, output: str, periods: list[str] | None = None, settings: Settings | None = None) -> DataFrame:
    """Write ``flights`` and ``summary`` below ``output``, and return all flights as they then stand."""
    s = settings or load_settings()
    events, catalog = spark.read.parquet(events_path), spark.read.parquet(catalog_path)
    LOG.info("read %d events of %s and %d rows of %s", events.count(), events_path, catalog.count(), catalog_path)
    mode = "static" if periods is None else "dynamic"

    def write(table: DataFrame, name: str) -> DataFrame:
        even = table.hint("rebalance", *PARTITIONS)  # a large period is written by several tasks
        even.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*PARTITIONS).parquet(f"{output}/{name}")
        return spark.read.schema(table.schema).parquet(f"{output}/{name}")

    flights = write(flights_of(events, catalog, s, periods), "flights")
    fresh = flights if periods is None else flights.where(F.col("period").isin(periods))
    counts = write(summary(fresh), "summary")
    whole = counts.groupBy("source").agg(F.count("*").alias("periods"), F.sum("n").alias("n"), F.sum("n_kept").alias("kept"))
    for r in whole.orderBy("source").collect():  # a row a discipline
        LOG.info("%s/flights holds %d flights of %s in %d periods, %d of them kept", output, r.n, r.source, r.periods, r.kept)
    return flights


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.track_census", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--events", required=True)
    p.add_argument("--catalog", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--periods", help="a comma list; all where it is left out")
    p.add_argument("--config", default=str(CONFIG))
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("track-census").getOrCreate()
    try:
        run(spark, args.events, args.catalog, args.output, args.periods.split(",") if args.periods else None, load_settings(args.config))
        return 0
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
