"""Results and work that only larger tables show."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F


# ---------------------------------------------------------------- near-identical tracks
def test_frechet_of_many_pairs_together_is_that_of_each():
    from tests.test_observables import slow_frechet
    from vantrail.operators.duplicates import frechet_many

    rng = np.random.default_rng(4)
    pairs = [(np.empty((0, 2)), np.ones((1, 2)))]
    for _ in range(400):  # lengths that differ share a block, and each pair leaves the bound at its own place
        a = rng.normal(size=(rng.integers(1, 40), 2)).cumsum(axis=0)
        b = a[np.sort(rng.integers(0, len(a), rng.integers(1, 60)))] + rng.normal(size=2) * 0.4
        pairs.append((a, b))
    got = frechet_many(pairs, 1.5)
    want = [slow_frechet(a, b) for a, b in pairs[1:]]
    assert got[0] is None and [g is None for g in got[1:]] == [w > 1.5 for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w <= 1.5]) and 50 < sum(g is not None for g in got) < 350


# ---------------------------------------------------------------- reversals
def test_a_reversal_turns_the_way_its_sql_has_it(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id = 542").write.parquet(str(tmp_path / "events.parquet"))  # along a meridian, where only last bits give a side
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.execute(oracle_sql()["b8_turning"]).fetchall(), key=lambda r: r[2])
    got = queries()["b8_turning"](spark, str(tmp_path)).orderBy("fix_no").collect()
    assert [tuple(r) for r in got] == want and any(r.turn is not None and abs(r.turn) > 3.14 for r in got)


def test_near_tracks_in_parts_without_a_broadcast(spark, monkeypatch):
    from vantrail.operators import duplicates
    from vantrail.plans.track_queries import copied

    fixes = copied(spark, "/root/testdata/sf0.001")
    fixes = fixes.unionByName(fixes.where("flight_id % 3 = 0").withColumns({"flight_id": F.col("flight_id") + 5000, "lat": F.col("lat") + 1e-4}))
    plans, write = [], duplicates.written
    plan_of = lambda table: table._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(duplicates, "written", lambda table: plans.append(plan_of(table)) or write(table))
    found = {}
    for tracks in (2, 1000):  # in a part
        monkeypatch.setattr(duplicates, "PART_TRACKS", tracks, raising=False)
        pairs, members = duplicates.near_tracks(fixes, metres=150.0, step_s=20.0)
        plans += [plan_of(pairs), plan_of(members)]
        rows = [(tuple(r.class_a), tuple(r.class_b), r.frechet_m) for r in pairs.collect()]
        assert len({r[:2] for r in rows}) == len(rows) and all(r[0] < r[1] for r in rows)
        found[tracks] = sorted(rows)
    assert found[2] == found[1000] and len(found[2]) >= 4
    assert not any("BroadcastExchange" in p for p in plans)


# ---------------------------------------------------------------- time scales
def test_time_scales_take_every_flight(spark, monkeypatch):
    from vantrail.operators import census, spectral
    from vantrail.plans import track_queries
    from vantrail.plans.queries import view

    fixes = view(spark, "/root/testdata/sf0.001")
    flights = census.track_stats(fixes)
    near = flights.where("n_fix >= 32 AND abs(dt_s - 10) <= 60").count()
    take = lambda sample: {r.channel: r.n_flights for r in spectral.timescales(fixes, flights, 10.0, 60.0, sample, nperseg=32, least=32).collect()}
    assert take(None)["horizontal"] == near > take(1)["horizontal"]
    asked = {}
    monkeypatch.setattr(spectral, "timescales", lambda *a, **k: asked.update(k) or spark.createDataFrame([], "channel string, n_flights long, floor double, f_c double, tau double, tau_p90 double"))
    track_queries.w5(spark, "/root/testdata/sf0.001")
    assert asked["sample"] is None


# ---------------------------------------------------------------- cleaning
def test_rules_of_a_flight_enter_python_in_batches_of_flights(spark):
    from vantrail.operators import clean
    from vantrail.plans.queries import SOUND, sound_view

    fixes = sound_view(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    clocked = clean.repair_clock(fixes)
    placed = clean.altitude_source(clean.merge_duplicates(fixes).drop("n_merged"), SOUND)
    for found in (clocked, clean.remove_blocks(placed, SOUND), clean.frozen_runs(placed, SOUND)):
        assert "FlatMapGroupsInPandas" not in plan(found)  # a frame a flight, milliseconds each
    kept = {}
    for r in sorted(clocked.collect(), key=lambda r: (r.source, r.flight_id, r.fix_no)):
        kept.setdefault((r.source, r.flight_id), []).append((r.t, r.kept))
    assert all([k for _, k in own] == clean.longest_run(np.array([t for t, _ in own])).tolist() for own in kept.values()) and any(not k for own in kept.values() for _, k in own)


# ---------------------------------------------------------------- quantiles of a few large groups
def test_values_of_a_group_are_not_gathered_in_one_task(spark):
    from vantrail.operators.ranks import exact_quantiles, running_sums

    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the planner does not know that they are few
    counts = spark.range(4000).select(F.lit("one").alias("g"), (F.col("id") * 7 % 4001).cast("double").alias("v"), (F.col("id") % 3 + 1).alias("n"))
    ranked = running_sums(counts, "v", ["n"], ["g"])
    plan = ranked._jdf.queryExecution().sparkPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert "BroadcastHashJoin [g#" in plan  # splitters meet values where they lie
    upto = 0
    for r in sorted(ranked.collect(), key=lambda r: r.v):
        upto += r.n
        assert r.n_upto == upto
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 31 % 1009).cast("double").alias("v"))
    got = {r.g: (r.n, r.xs) for r in exact_quantiles(rows, "v", [0.1, 0.5], ["g"]).collect()}
    for g in range(3):
        own = [i * 31 % 1009 for i in range(g, 3000, 3)]
        assert got[g][0] == 1000 and got[g][1] == pytest.approx(np.quantile(own, [0.1, 0.5]).tolist())


# ---------------------------------------------------------------- memory of a task
def test_tasks_grow_in_number_and_not_in_rows(spark):
    from vantrail.session import dealt

    rows = spark.range(9000).select((F.col("id") % 500).alias("flight"), "id")
    out = dealt(rows, "flight", rows=1000)
    sizes = out.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.collect_set("flight").alias("own")).collect()
    assert out.rdd.getNumPartitions() == 9 and sum(r.n for r in sizes) == 9000 and max(r.n for r in sizes) < 2000
    assert sum(len(r.own) for r in sizes) == 500  # a flight is in one task
    assert dealt(rows.where("false"), "flight").count() == 0


def test_quantiles_where_each_evaluation_has_other_splitters(spark, monkeypatch):
    import random

    from vantrail.operators import ranks

    drawn = F.udf(lambda n: sorted(random.uniform(0, 1000) for _ in range(n)), "array<double>").asNondeterministic()
    monkeypatch.setattr(ranks.F, "percentile_approx", lambda value, at: drawn(F.max(F.lit(ranks.PARTS - 1))))  # as a sketch that merges in another order
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
        found = {r.g: (r.n, r.xs) for r in ranks.exact_quantiles(rows, "v", [0.1, 0.5, 0.9], ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
    for g in (0, 1):
        n, xs = found[g]
        assert n == 500 and xs == [float(x) for x in np.quantile(np.arange(g, 1000, 2.0), [0.1, 0.5, 0.9])]
