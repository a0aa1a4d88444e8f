"""Resumable ingest of landed track files as a stream, and gap sessions. Extensions: the batch operators are the reference for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vantrail.functions import naming, records

_FILES = "path string, modificationTime timestamp, length long, content binary"


def track_lines_stream(spark: SparkSession, root: str, source: str, glob: str = "*.igc", max_files: int = 1000) -> DataFrame:
    """Lines of files as they land; the checkpoint remembers which were taken, so a restart goes on where it stopped."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    return files.select(F.lit(source).alias("source"), naming.flight_of(F.element_at(F.split("path", "/"), -1)).alias("flight_id"), F.posexplode(records.file_lines(F.col("content"))).alias("line_no", "line"))


def land(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the lines to Parquet once for each file and end when all present files are in."""
    return lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("source").trigger(availableNow=True).start()


def gap_sessions(events: DataFrame, time: str, key: str, gap: str = "20 seconds", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after a fixed gap. A flight's own bound depends on its median interval and needs the whole flight."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("t0"), F.col("w.end").alias("t1"), "n")
