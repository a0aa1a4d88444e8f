"""The cleaned archive as stored tables that flight windows and joins read without an exchange.

Three tables, zstd Parquet below one root: ``fixes``, ``segments`` and ``flights_meta``. Each is bucketed by (source, flight_id) into the
same number of buckets, so rows of a flight meet where they lie, and partitioned by ``part``, a hash of the flight, so that single
flights are replaced by writing their parts anew and nothing else. A window or an aggregation by flight (and more), and a join of the tables
on it, plan no exchange; nor does a join on flight and segment where spark.sql.requireAllClusterKeysForCoPartition is off, which is the
reader's choice. The session's catalog forgets tables; ``open_store`` names them again from what lies below the root.
"""

from __future__ import annotations

import hashlib
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantrail.config import Thresholds
from vantrail.plans.cleaning import Cleaned
from vantrail.session import written

KEYS = ["source", "flight_id"]
#: Version of the plan whose output is stored.
VERSION = "1"
#: Buckets of a table, and parts that are replaced as a whole.
BUCKETS, PARTS = 32, 16
ORDER = {"fixes": ["segment_id", "t"], "segments": ["segment_id"], "flights_meta": []}


class Store(NamedTuple):
    spark: SparkSession
    root: str
    buckets: int
    parts: int

    def name(self, table: str) -> str:
        return f"vantrail_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}_{table}"

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table)).drop("part")


def config_hash(limits: Thresholds) -> str:
    """Of all thresholds: rows with the same one were cleaned alike."""
    return hashlib.sha256(repr(limits.table()).encode()).hexdigest()


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(parts)).cast("int").alias("part")


def stored_tables(cleaned: Cleaned, limits: Thresholds, processed_at: datetime | None = None) -> dict[str, DataFrame]:
    """The three tables with their stored columns: fixes as 32-bit floats, and per flight its provenance, origin, times and filter windows.
    ``processed_at`` is null where it is not given, so that two runs give the same rows."""
    real = lambda c, name: F.col(c).cast("float").alias(name)
    kinds = (("pos", ""), ("vel", "v_"), ("acc", "a_"))
    values = [real(f"{c}_{k}", f"{p}{n}") for k, p in kinds for c, n in (("east_m", "E"), ("north_m", "N"), ("alt", "z"))]
    fixes = cleaned.fixes.select(*KEYS, "segment_id", "interpolated", real("grid_t", "t"), *values)
    segments = cleaned.segments.select(*KEYS, "segment_id", "t_start", "t_end", "n_fix", "passes", "frac_interpolated", "cut_start", "cut_end")
    f, s = cleaned.flights, limits.savgol
    gridded = cleaned.fixes.groupBy(*KEYS).agg(F.count("*").alias("n_fix_grid"), F.avg(F.col("interpolated").cast("double")).alias("frac_interpolated"))
    f = f.join(gridded, KEYS, "left")

    def window(tau: Column) -> Column:
        n = F.ceil(tau / F.col("dt_native_s")).cast("int")
        return F.when(F.col("dt_native_s") > 0, F.greatest(n + F.when(n % 2 == 0, 1).otherwise(0), F.lit(s.window_min)))

    vertical = F.when(F.col("alt_source") == "gnss", s.tau_c_vertical_gnss_s).otherwise(s.tau_c_vertical_baro_s)
    meta = f.select(
        *KEYS,
        "reason",
        F.lit(VERSION).alias("pipeline_version"),
        F.lit(config_hash(limits)).alias("config_hash"),
        F.lit(processed_at).cast("timestamp").alias("processed_at"),
        *[F.col(c).cast("double").alias(c) for c in ("lat0", "lon0", "alt0")],
        F.col("t_on").alias("t_signal_start_s"),
        F.col("t_off").alias("t_signal_end_s"),
        (F.col("t_off") - F.col("t_on")).alias("duration_signal_s"),
        F.col("duration_s").alias("duration_flight_s"),
        F.col("n_raw").alias("n_fix_raw"),
        F.col("n_clean").alias("n_fix_clean"),
        "frac_interpolated",
        "dt_native_s",
        (F.col("n_fix_grid") > 0).alias("was_resampled"),
        "alt_source",
        window(F.lit(s.tau_c_horizontal_s)).alias("savgol_window_horiz"),
        window(vertical).alias("savgol_window_vert"),
        F.lit(s.polyorder).alias("savgol_order"),
    )
    return {"fixes": fixes, "segments": segments, "flights_meta": meta}


def write_store(spark: SparkSession, tables: dict[str, DataFrame], root: str, buckets: int = BUCKETS, parts: int = PARTS) -> Store:
    """Write ``tables``, what ``stored_tables`` gave, below ``root``, replacing what is there. Rows go to their bucket in one shuffle."""
    store = Store(spark, root, buckets, parts)
    for table, rows in tables.items():
        spark.sql(f"DROP TABLE IF EXISTS {store.name(table)}")
        even = rows.withColumn("part", _part(parts)).repartition(buckets, *KEYS)
        even.write.mode("overwrite").option("compression", "zstd").option("path", f"{root}/{table}").partitionBy("part").bucketBy(buckets, *KEYS).sortBy(*KEYS, *ORDER[table]).saveAsTable(store.name(table))
    spark.createDataFrame([(buckets, parts)], "buckets int, parts int").write.mode("overwrite").parquet(f"{root}/layout")
    return store


def open_store(spark: SparkSession, root: str) -> Store:
    """The store below ``root``, its tables named in this session's catalog."""
    layout = spark.read.parquet(f"{root}/layout").first()
    store = Store(spark, root, layout.buckets, layout.parts)
    for table, order in ORDER.items():
        name = store.name(table)
        if spark.catalog.tableExists(name):
            continue
        columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{root}/{table}").schema if f.name != "part"]
        spark.sql(f"CREATE TABLE {name} ({', '.join(columns)}, part INT) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (part) CLUSTERED BY (source, flight_id) SORTED BY ({', '.join([*KEYS, *order])}) INTO {store.buckets} BUCKETS LOCATION '{root}/{table}'")
        spark.catalog.recoverPartitions(name)
    return store


def replace_flights(store: Store, tables: dict[str, DataFrame]) -> None:
    """Put the flights of ``tables`` (every one of them has a row in its flights_meta) in the place of their stored rows; other flights stay.
    Their parts are gathered in the shared folder first and then written over, part by part of the store at a time."""
    spark = store.spark
    flights = written(tables["flights_meta"].select(*KEYS, _part(store.parts)).distinct())
    touched = sorted(r.part for r in flights.select("part").distinct().collect())  # at most as many as the store has parts
    staged = {}
    for table, rows in tables.items():
        old = spark.table(store.name(table))
        stay = old.where(F.col("part").isin(touched)).join(flights.select(*KEYS), KEYS, "left_anti")
        staged[table] = written(stay.select(*old.columns).unionByName(rows.withColumn("part", _part(store.parts)).select(*old.columns)))
    for table, rows in staged.items():
        columns = ", ".join(f"`{c}`" for c in rows.columns if c != "part")
        rows.createOrReplaceTempView(view := f"{store.name(table)}_staged")
        for part in touched:  # a named part is emptied also where no row of it is left
            spark.sql(f"INSERT OVERWRITE TABLE {store.name(table)} PARTITION (part = {part}) SELECT {columns} FROM {view} WHERE part = {part}")
        spark.catalog.dropTempView(view)
        spark.catalog.refreshTable(store.name(table))

