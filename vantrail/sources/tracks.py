"""Fix tables: from landed track files, from record text, and as a view over an event table.

A fix table has source, flight_id, fix_no, t (seconds since the first fix), lat, lon, valid, baro_alt, gnss_alt. Order is
explicit: every window sorts by fix_no within (source, flight_id), and one shuffle on that key serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantrail.functions import naming, records

FIX_COLUMNS = ["source", "flight_id", "fix_no", "t", "lat", "lon", "valid", "baro_alt", "gnss_alt"]


def by_flight(*order: str) -> Window:
    w = Window.partitionBy("source", "flight_id")
    return w.orderBy(*order) if order else w


def list_tracks(spark: SparkSession, root: str, glob: str = "*.igc") -> DataFrame:
    """(path, name, length, modified) of all files below a root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def read_track_lines(spark: SparkSession, root: str, source: str, glob: str = "*.igc") -> DataFrame:
    """(source, flight_id, line_no, line) of all track files below a root; the flight is the id in the file's name, as catalogs have it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.lit(source).alias("source"), naming.flight_of(F.element_at(F.split("path", "/"), -1)).alias("flight_id"), F.posexplode(records.file_lines(F.col("content"))).alias("line_no", "line"))


def parse_records(lines: DataFrame, clamp: bool = True) -> DataFrame:
    """The fix table of record lines. A malformed record is dropped and its file kept. A drop of the clock by more than
    half a day is midnight; smaller backward steps are held at the running maximum, or kept where ``clamp`` is off."""
    line = F.col("line")
    keys = ["source", "flight_id"]
    parsed = lines.where(records.is_record(line)).select(
        *keys,
        "line_no",
        records.seconds_of_day(line).alias("sod"),
        records.latitude(line).alias("lat"),
        records.longitude(line).alias("lon"),
        records.is_valid(line).alias("valid"),
        records.altitude(line, 26).alias("baro_alt"),
        records.altitude(line, 31).alias("gnss_alt"),
    )
    parsed = parsed.where(F.col("sod").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("baro_alt").isNotNull() & F.col("gnss_alt").isNotNull())
    w = by_flight("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    midnight = F.when(F.col("sod") - F.lag("sod").over(w) < -records.HALF_DAY_S, 1).otherwise(0)
    clock = parsed.withColumn("midnight", midnight).withColumn("clock", F.col("sod") + 86400 * F.sum("midnight").over(upto))
    if clamp:
        clock = clock.withColumn("clock", F.max("clock").over(upto))
    start = F.first("clock").over(upto)
    return clock.select(*keys, F.row_number().over(w).alias("fix_no"), (F.col("clock") - start).cast("double").alias("t"), "lat", "lon", "valid", "baro_alt", "gnss_alt")


def seeded_sample(rows: DataFrame, n: int, key: str = "path", seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if fewer), the same for the same seed whatever the order or partitions."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def track_view(events: DataFrame) -> DataFrame:
    """A deterministic fix table over an event table (event_id, ts, user_id, event_type, value)."""
    w = Window.partitionBy("user_id")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e9))
    rows = events.select("user_id", "event_id", "ts", "event_type", "value", second.alias("s"))
    rows = rows.withColumn("fix_no", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("t", (F.col("s") - F.min("s").over(w)).cast("double"))
    t, value, flight = F.col("t"), F.col("value"), F.col("user_id")
    tenth = F.floor(value * 10).cast("double")
    return rows.select(
        F.when(flight % 10 == 0, "hang gliders").otherwise("paragliders").alias("source"),
        flight.alias("flight_id"),
        "fix_no",
        "t",
        (45 + F.lit(1e-4) * t + F.lit(1e-5) * value).alias("lat"),
        (5 + F.lit(1e-4) * t * ((flight % 7) - 3) / 3).alias("lon"),
        (F.col("event_type") != "error").alias("valid"),
        F.when(flight % 3 == 0, F.lit(0.0)).otherwise(tenth).alias("baro_alt"),
        F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(tenth + 50).alias("gnss_alt"),
    )


def with_steps(fixes: DataFrame) -> DataFrame:
    """The fix table with dt, step_m and dz (barometric) from the fix before; null at the first."""
    from vantrail.functions.geo import great_circle_m

    w = by_flight("fix_no")
    before = lambda c: F.lag(c).over(w)
    return fixes.withColumns({"dt": F.col("t") - before("t"), "step_m": great_circle_m(before("lat"), before("lon"), F.col("lat"), F.col("lon")), "dz": F.col("baro_alt") - before("baro_alt")})


def record_line(second: Column, lat: Column, lon: Column, valid: Column, baro: Column, gnss: Column) -> Column:
    """The record text of a fix."""

    def angle(x: Column, digits: int, letters: str) -> Column:
        size = F.abs(x)
        minutes = F.rint((size - F.floor(size)) * 60000)
        degrees = F.floor(size) + F.when(minutes >= 60000, 1).otherwise(0)
        minutes = F.when(minutes >= 60000, 0).otherwise(minutes)
        return F.concat(F.lpad(degrees.cast("int").cast("string"), digits, "0"), F.lpad(minutes.cast("int").cast("string"), 5, "0"), F.when(x < 0, letters[1]).otherwise(letters[0]))

    two = lambda x: F.lpad(F.floor(x).cast("int").cast("string"), 2, "0")
    high = lambda x: F.when(x < 0, F.concat(F.lit("-"), F.lpad(F.abs(x).cast("int").cast("string"), 4, "0"))).otherwise(F.lpad(x.cast("int").cast("string"), 5, "0"))
    return F.concat(F.lit("B"), two(second / 3600), two(second % 3600 / 60), two(second % 60), angle(lat, 2, "NS"), angle(lon, 3, "EW"), F.when(valid, "A").otherwise("V"), high(baro), high(gnss))
