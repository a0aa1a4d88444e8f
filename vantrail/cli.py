"""Command line over landed archives: build-catalog, status, plan (what a download would fetch), verify, census."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vantrail.config import Archive, load_archive
from vantrail.functions import naming, records
from vantrail.operators import catalog as catalogs
from vantrail.operators import census
from vantrail.sources import catalog as sources
from vantrail.sources import tracks


def check_root(archive: Archive) -> None:
    if not Path(archive.root).is_dir():
        raise FileNotFoundError(f"the data root is not there: {archive.root}")


def build_catalog(spark: SparkSession, archive: Archive, years: list[int]):
    parts = [sources.load_season(spark, archive.path("raw/xml"), y) for y in years]
    flights = parts[0]
    for part in parts[1:]:
        flights = flights.unionByName(part)
    listed = tracks.list_tracks(spark, archive.path("raw/tracks")).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    return catalogs.build_catalog(flights, listed, archive.path("raw/tracks"))


def checked_files(spark: SparkSession, archive: Archive):
    """(path, season, kind, category) of every file below the track folder; a null category is a sound track. A file that is listed but can't be
    read, for its permissions, its checksum or because it is gone, is ``unreadable``, and the others are checked all the same."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    parts = F.split("path", "/")
    listed = files.load(archive.path("raw/tracks")).select("path", F.element_at(parts, -2).alias("season"), records.entry_kind(F.element_at(parts, -1)).alias("kind"))  # reads no content
    checked = files.load(archive.path("raw/tracks")).select(F.col("path").alias("read"), records.file_problem(records.file_lines(F.col("content")), F.octet_length("content")).alias("problem"))
    known = listed.join(checked, F.col("path") == F.col("read"), "left")
    category = F.when(F.col("kind") != "check", F.col("kind")).when(F.col("read").isNull(), "unreadable").otherwise(F.col("problem"))
    return known.select("path", "season", "kind", category.alias("category"))


def verify(spark: SparkSession, archive: Archive):
    """(path, category) of every file below the track folder that is a problem."""
    return checked_files(spark, archive).select("path", "category").where(F.col("category").isNotNull())


def verify_report(files):
    """(season, n_igc, problems, failures) of checked files, and a row of all with a null season."""
    failure = F.coalesce(records.is_integrity_failure(F.col("category")), F.lit(False))
    count = lambda mask: F.count(F.when(mask, 1))
    return files.rollup("season").agg(count(F.col("kind") == "check").alias("n_igc"), count(F.col("category").isNotNull()).alias("problems"), count(failure).alias("failures"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vantrail", description=__doc__)
    p.add_argument("--config", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build-catalog", "status", "plan", "verify", "census"):
        s = sub.add_parser(name)
        s.add_argument("--seasons", default="all")
        if name == "plan":
            s.add_argument("--limit", type=int, help="flights with a track of each season, the first by id")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    archive = load_archive(args.config)
    check_root(archive)
    spark = SparkSession.builder.appName("vantrail").getOrCreate()
    archived = sources.archived_years(archive.path("raw/xml"))
    years = archived if args.seasons == "all" else naming.parse_seasons(args.seasons, archive.first_season, archive.last_season)
    if args.command == "verify":
        files = checked_files(spark, archive).cache()
        problems = files.where(F.col("category").isNotNull())
        sources.write_failures(problems.select("season", "category", "path"), archive.path("logs", "problems"))
        verify_report(files).orderBy(F.col("season").asc_nulls_last()).show(200, truncate=False)
        catalogs.problem_counts(problems).show(truncate=False)
        return int(not problems.where(records.is_integrity_failure(F.col("category"))).isEmpty())
    if args.command == "census":
        lines = tracks.read_track_lines(spark, archive.path("raw/tracks"), Path(archive.root).name)
        sources.load_or_compute(spark, archive.path("derived", "census"), lambda: census.track_stats(tracks.parse_records(lines))).show(5)
        return 0
    table = build_catalog(spark, archive, years).cache()
    if args.command == "status":
        catalogs.status(table, F.col("igc_link") != "", F.col("downloaded")).orderBy(F.col("season_year").asc_nulls_last()).show(200, truncate=False)
        return 0
    if args.command == "plan":
        catalogs.download_plan(table, args.limit).orderBy(F.col("season_year").asc_nulls_last()).show(200, truncate=False)
        return 0
    sources.write_csv(table, archive.path("catalog", "flights"))
    sources.write_csv(catalogs.season_index(table), archive.path("catalog", "seasons"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
