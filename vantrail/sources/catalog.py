"""Season metadata, flight catalogs and season indices."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantrail.functions import naming

#: Attributes of a flight element and the columns they become.
ATTRIBUTES = {
    "id": "flight_id", "date": "date", "pilot": "pilot", "flight_type": "flight_type", "distance": "distance_km", "points": "points", "duration": "duration_s", "speed": "speed",
    "takeOff": "takeoff", "landing": "landing", "depNum": "dept", "club": "club", "aile": "wing", "aile_class": "wing_class", "flight_link": "flight_link", "igc_tracklog_link": "igc_link",
    "pilot_link": "pilot_link", "igc_tracklog": "tracklog_id",
}
DOUBLES, LONGS = ("distance_km", "points", "speed"), ("duration_s",)


def read_season_xml(spark: SparkSession, path: str) -> DataFrame:
    """Flights of season exports; the season's year is the file's stem. All attributes are read as text and parsed leniently."""
    schema = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in ATTRIBUTES])
    raw = spark.read.format("xml").options(rowTag="flight", inferSchema="false").schema(schema).load(path)
    columns = []
    for attribute, name in ATTRIBUTES.items():
        value = F.col(f"_{attribute}")
        if name in DOUBLES:
            value = naming.lenient_double(value)
        elif name in LONGS:
            value = naming.lenient_long(value)
        elif name == "igc_link":
            value = naming.clean_link(value)
        else:
            value = naming.text_or_blank(value)
        columns.append(value.alias(name))
    year = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.xml$", 1).try_cast("int")
    return raw.select(*columns, year.alias("season_year")).withColumn("season", naming.season_label(F.col("season_year")))


def archived_years(folder: str) -> list[int]:
    """Years with a landed export, sorted; other names are passed over. A missing folder has none."""
    if not os.path.isdir(folder):
        return []
    return sorted(int(s) for s, e in map(os.path.splitext, os.listdir(folder)) if e == ".xml" and s.isdigit())


def load_season(spark: SparkSession, folder: str, year: int) -> DataFrame:
    path = os.path.join(folder, f"{year}.xml")
    if not os.path.exists(path):
        raise FileNotFoundError(f"season {year} has not been landed: {path}")
    return read_season_xml(spark, path)


def read_season_index(spark: SparkSession, path: str) -> DataFrame:
    schema = "season_year int, season string, list_url string, xml_url string, n_flights long, n_with_igc long, n_downloaded long"
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(table: DataFrame, path: str) -> None:
    """One CSV with a header, for tables of report size (a row a season or flight of a season)."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_failures(failures: DataFrame, path: str) -> bool:
    """The CSV of failed files, written only where there are any; whether there are."""
    found = not failures.isEmpty()
    if found:
        write_csv(failures, path)
    return found


def load_or_compute(spark: SparkSession, path: str, compute, force: bool = False) -> DataFrame:
    """The table at ``path``, computed and written first where it is not there or ``force`` is set. Presence alone counts."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    if force or not exists:
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
