"""The stored archive: its columns, plans without exchanges, names in a new session, and the replacement of single flights."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vantrail.config import Thresholds
from vantrail.plans import store
from vantrail.plans.cleaning import clean_tracks
from vantrail.plans.queries import SOUND, sound_view

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cleaned(spark):
    return store.stored_tables(clean_tracks(sound_view(spark, DATA), SOUND), SOUND)


@pytest.fixture
def kept(spark, cleaned, tmp_path):
    return store.write_store(spark, cleaned, str(tmp_path / "archive"), buckets=4, parts=3)


def exchanges(spark, df):
    """Exchanges of the plan where nothing is broadcast."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df.collect()
        return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_tables_hold_what_was_cleaned(kept, cleaned):
    for name, table in cleaned.items():
        assert rows(kept.read(name)) == rows(table)
    fixes = dict(kept.read("fixes").dtypes)
    assert [fixes[c] for c in ("t", "E", "N", "z", "v_E", "v_N", "v_z", "a_E", "a_N", "a_z")] == ["float"] * 10 and fixes["segment_id"] == "smallint" and fixes["interpolated"] == "boolean"
    assert {"t_start", "t_end", "n_fix", "frac_interpolated", "cut_start", "cut_end"} <= set(kept.read("segments").columns)
    meta = kept.read("flights_meta").collect()
    assert {r.config_hash for r in meta} == {store.config_hash(SOUND)} != {store.config_hash(Thresholds())}
    for r in meta:
        if r.reason is None:
            assert r.lat0 > 44 and r.t_signal_end_s - r.t_signal_start_s == r.duration_signal_s >= r.duration_flight_s and r.n_fix_raw >= r.n_fix_clean and r.savgol_window_horiz == 5 and r.dt_native_s > 0
    first = kept.read("fixes").where("t = 0").groupBy("source", "flight_id").agg(F.min(F.abs("E") + F.abs("N")).alias("d"))
    assert first.where("d > 1000").isEmpty()


def test_flight_windows_and_joins_need_no_exchange(spark, kept, tmp_path):
    key = ["source", "flight_id"]
    w = Window.partitionBy(*key).orderBy("t")
    fixes = kept.read("fixes")
    step = fixes.withColumn("dE", F.col("E") - F.lag("E").over(w))
    flights = fixes.join(kept.read("flights_meta"), key)
    segments = lambda: fixes.join(kept.read("segments"), [*key, "segment_id"])
    assert exchanges(spark, step) == 0
    assert exchanges(spark, fixes.groupBy(*key).agg(F.max("z"))) == 0
    assert exchanges(spark, fixes.groupBy(*key, "segment_id").agg(F.max("z"))) == 0
    assert exchanges(spark, flights) == 0
    assert exchanges(spark, segments()) > 0
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        assert exchanges(spark, segments()) == 0
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    plain = spark.read.parquet(f"{kept.root}/fixes")
    assert exchanges(spark, plain.withColumn("dE", F.col("E") - F.lag("E").over(w))) > 0


def test_a_new_session_names_the_tables_again(spark, kept):
    want = {n: rows(kept.read(n)) for n in store.ORDER}
    for n in store.ORDER:
        spark.sql(f"DROP TABLE {kept.name(n)}")
    again = store.open_store(spark, kept.root)
    assert (again.buckets, again.parts) == (4, 3)
    assert {n: rows(again.read(n)) for n in store.ORDER} == want
    assert exchanges(spark, again.read("fixes").groupBy("source", "flight_id").count()) == 0


def test_single_flights_are_replaced(spark, kept, cleaned):
    other = [r.flight_id for r in cleaned["fixes"].select("flight_id").distinct().orderBy("flight_id").collect()]
    one, gone = other[0], other[1]
    before = {n: rows(kept.read(n).where(~F.col("flight_id").isin(one, gone))) for n in store.ORDER}
    some = {n: t.where(F.col("flight_id").isin(one, gone)) for n, t in cleaned.items()}
    some["fixes"] = some["fixes"].where(F.col("flight_id") == one).withColumn("z", (F.col("z") + 1).cast("float"))
    some["segments"] = some["segments"].where(F.col("flight_id") == one)
    some["flights_meta"] = some["flights_meta"].withColumn("reason", F.when(F.col("flight_id") == gone, "flat"))
    store.replace_flights(kept, some)
    assert {n: rows(kept.read(n).where(~F.col("flight_id").isin(one, gone))) for n in store.ORDER} == before
    for n, t in some.items():
        assert rows(kept.read(n).where(F.col("flight_id").isin(one, gone))) == rows(t)
    store.replace_flights(kept, some)  # again, with the same result
    assert {n: rows(kept.read(n).where(~F.col("flight_id").isin(one, gone))) for n in store.ORDER} == before
    assert exchanges(spark, kept.read("fixes").groupBy("source", "flight_id").count()) == 0


def test_a_part_may_lose_its_last_rows(spark, kept, cleaned):
    everything = {n: t.where("false") if n != "flights_meta" else t for n, t in cleaned.items()}
    store.replace_flights(kept, everything)
    assert kept.read("fixes").count() == 0 and kept.read("segments").count() == 0 and kept.read("flights_meta").count() == cleaned["flights_meta"].count()
