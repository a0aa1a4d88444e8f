"""Catalog joins and season statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantrail.functions import naming


def build_catalog(flights: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Flights with local_path, downloaded and file_size, by a left join of the constructed path to a file listing
    (path, length). The listing has a row a file, so Spark broadcasts it only while it is small."""
    named = flights.withColumn("local_path", naming.track_path(root, F.col("season_year"), F.col("date"), F.col("flight_id")))
    listed = files.select(F.col("path").alias("local_path"), F.col("length").alias("file_size"))
    return named.join(listed, "local_path", "left").withColumn("downloaded", F.col("file_size").isNotNull())


def with_stratum(rows: DataFrame, catalog: DataFrame, stratum: str) -> DataFrame:
    """``rows`` (source, flight_id, ...) of the flights that a catalog (source, flight_id, ...) has, with its column ``stratum``. Ids of two sources may
    be the same and are different flights. Of a flight on several rows of the catalog the least stratum counts. Ids match as text: a landed
    file's comes from its name."""
    key = [F.col("source").alias("__source"), F.col("flight_id").cast("string").alias("__id")]
    strata = catalog.groupBy(*key).agg(F.min(stratum).alias(stratum))
    joined = rows.join(strata, (rows["source"] == strata["__source"]) & (rows["flight_id"].cast("string") == strata["__id"]))
    return joined.drop("__source", "__id")


def season_index(catalog: DataFrame, link: str = "igc_link", downloaded: str = "downloaded", year: str = "season_year") -> DataFrame:
    has = (F.coalesce(F.col(link), F.lit("")) != "").cast("bigint")
    return catalog.groupBy(year).agg(F.count("*").alias("n_flights"), F.sum(has).alias("n_with_igc"), F.sum(F.col(downloaded).cast("bigint")).alias("n_downloaded")).withColumn("season", naming.season_label(F.col(year))).orderBy(year)


def status(catalog: DataFrame, has: Column, present: Column, year: str = "season_year") -> DataFrame:
    """Counts a season and, with a null season, in total: flights, with a track, present among those, missing."""
    counts = catalog.rollup(year).agg(F.count("*").alias("n_flights"), F.sum(has.cast("bigint")).alias("n_with_igc"), F.sum((has & present).cast("bigint")).alias("n_downloaded"))
    return counts.withColumn("n_missing", F.col("n_with_igc") - F.col("n_downloaded"))


def problem_counts(files: DataFrame, category: str = "category") -> DataFrame:
    """Files by problem, the most frequent first."""
    return files.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n")).orderBy(F.desc("n"), category)


def percentages(index: DataFrame, group: str) -> DataFrame:
    """Totals of a season index by group and over all (null group), with percent of flights with a track and of those present."""
    part = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.round(100 * F.col(a) / F.col(b), 1))
    sums = index.rollup(group).agg(*[F.sum(c).alias(c) for c in ("n_flights", "n_with_igc", "n_downloaded")])
    return sums.withColumns({"with_igc_pct": part("n_with_igc", "n_flights"), "downloaded_pct": part("n_downloaded", "n_with_igc")})


def first_of_each(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group: the limit a season of a download."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__rank") <= n).drop("__rank")


def download_plan(catalog: DataFrame, limit: int | None = None, order: str = "flight_id", year: str = "season_year") -> DataFrame:
    """(season, n_to_download, n_skipped) of the flights with a track, of the first ``limit`` of each season where that is given: those that have not landed
    and those that have. A row with a null season is the total."""
    linked = catalog.where(F.coalesce(F.col("igc_link"), F.lit("")) != "")
    chosen = linked if limit is None else first_of_each(linked, year, order, limit)
    here = F.coalesce(F.col("downloaded"), F.lit(False))
    return chosen.rollup(year).agg(F.count(F.when(~here, 1)).alias("n_to_download"), F.count(F.when(here, 1)).alias("n_skipped"))


def shared_ids(a: DataFrame, b: DataFrame, key: str = "flight_id") -> DataFrame:
    """Ids that occur in both sources."""
    return a.select(key).intersect(b.select(key))


def recoded(catalog: DataFrame, zero_is_null: list[str], date: str = "date", dept: str = "dept") -> DataFrame:
    """Sentinels as nulls: zeros of the given columns, dates with a zero month or day, and departments that are no code."""
    out = catalog.withColumns({c: F.nullif(F.col(c), F.lit(0).cast(catalog.schema[c].dataType)) for c in zero_is_null})
    if date in catalog.columns:
        out = out.withColumn(date, F.when(~F.regexp_like(date, F.lit("-00")), F.col(date)))
    if dept in catalog.columns:
        out = out.withColumn(dept, F.when(F.regexp_like(dept, F.lit("^[0-9AB]{2,3}$")), F.col(dept)))
    return out


def near_uploads(flights: DataFrame, km: float = 1.0) -> DataFrame:
    """Pairs of flights of one pilot and day whose distances are within ``km``: candidates for one flight uploaded twice."""
    a, b = (flights.select("pilot", "date", F.col("flight_id").alias(f"flight_{s}"), F.col("distance_km").alias(f"km_{s}")) for s in "ab")
    return a.join(b, ["pilot", "date"]).where((F.col("flight_a") < F.col("flight_b")) & (F.abs(F.col("km_a") - F.col("km_b")) <= km)).select("pilot", "date", "flight_a", "flight_b")
