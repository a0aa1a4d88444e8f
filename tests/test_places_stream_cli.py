"""Clusters against brute force, flights assembled in a stream against the batch, and the command line over landed files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vantrail import cli
from vantrail.config import Archive, Thresholds
from vantrail.operators import catalog, clusters, resample
from vantrail.streaming import assembly, ingest


# ---------------------------------------------------------------- clusters
def roots_of(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(110)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots_of([e for e in edges if e[0] != e[1]]).items()}
    assert clusters.components(spark.createDataFrame([(5, 5)], "a long, b long")).count() == 0


def test_dense_clusters(spark):
    rng = random.Random(4)
    rows = [(i, rng.gauss(5, 0.03), rng.gauss(45, 0.03)) for i in range(300)] + [(1000 + i, rng.gauss(-6, 0.02), rng.gauss(-43, 0.02)) for i in range(60)] + [(2000 + i, rng.uniform(0, 10), rng.uniform(40, 50)) for i in range(50)] + [(3000, None, 45.0)]
    got = {r.id: r.cluster for r in clusters.dense_clusters(spark.createDataFrame(rows, "id long, lon double, lat double"), "lon", "lat", 0.02, 3).collect()}
    cell = {i: (int(x // 0.02), int(y // 0.02)) for i, x, y in rows if x is not None}
    n = {}
    for c in cell.values():
        n[c] = n.get(c, 0) + 1
    dense = sorted(c for c in n if n[c] >= 3)
    root = roots_of([(a, b) for a in dense for b in dense if max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1])
    want = {}
    for i, c in cell.items():
        want.setdefault(root.get(c), set()).add(i)
    found = {}
    for i, c in got.items():
        found.setdefault(c, set()).add(i)
    assert {frozenset(v) for k, v in found.items() if k is not None} == {frozenset(v) for k, v in want.items() if k is not None}
    assert found[None] == want[None] | {3000}


# ---------------------------------------------------------------- streams
BEGIN = datetime(2024, 5, 1, 10)
FIXES = "source string, flight_id long, ts timestamp, lat double, lon double"


def flight(i, start, steps):
    rows, at = [], BEGIN + timedelta(seconds=start)
    for k, s in enumerate(steps):
        at += timedelta(seconds=s)
        rows.append(("paragliders", i, at, 45 + 0.001 * k, 5.0 + 0.01 * i))
    return rows


def play(spark, tmp_path, batches):
    """The assembled flights of batches of rows, each a file that lands after the run before it."""
    for rows in batches:
        spark.createDataFrame(rows, FIXES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FIXES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = assembly.assemble(stream, Thresholds(), close_s=600.0, late="5 minutes")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_assembled_flights_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(1)
    steps = lambda n: [0] + [rng.choice([1, 1, 1, 2, 25, 40]) for _ in range(n)]
    rows = [r for i in range(6) for r in flight(i, 30 * i, steps(40 + 10 * i))]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[2] + timedelta(seconds=rng.randrange(200)))  # out of order, but in time
    third = len(rows) // 3
    end = [("paragliders", 99, BEGIN + timedelta(hours=h), 46.0, 6.0) for h in (3, 6)]
    got = play(spark, tmp_path, [rows[:third], rows[third : 2 * third], rows[2 * third :], end[:1], end[1:]]).where("flight_id < 99")
    whole = spark.createDataFrame(rows, FIXES).withColumn("at", F.unix_micros("ts") / 1e6)
    first = whole.groupBy("source", "flight_id").agg(F.min("at").alias("first"))
    table = whole.join(first, ["source", "flight_id"]).withColumn("t", F.round(F.col("at") - F.col("first"), 6))
    table = table.withColumn("fix_no", F.rank().over(resample.by_flight().orderBy("t", "lat", "lon")))
    want = resample.with_segments(table, Thresholds()).select("source", "flight_id", "fix_no", "t", "lat", "lon", "dt_s", "segment_id")
    keyed = lambda df: sorted((r.flight_id, r.fix_no, round(r.t, 3), r.lat, r.lon, r.dt_s, r.segment_id) for r in df.collect())
    assert keyed(got) == keyed(want) and {r.part for r in got.collect()} == {1}


def test_late_rows_and_flights_that_come_back(spark, tmp_path):
    day = flight(1, 0, [0] + [1] * 9)
    later = [("paragliders", 9, BEGIN + timedelta(hours=2), 46.0, 6.0)]
    late = flight(1, 20, [0, 1])  # two hours late: dropped
    back = flight(1, 3 * 3600, [0, 5])  # the same key again, in time: a part of its own
    end = [("paragliders", 9, BEGIN + timedelta(hours=h), 46.0, 6.0) for h in (6, 9)]
    rows = play(spark, tmp_path, [day, later, late + back, end[:1], end[1:]]).where("flight_id = 1").collect()
    assert sorted((r.part, r.fix_no, r.t) for r in rows) == [(1, k + 1, float(k)) for k in range(10)] + [(2, 1, 0.0), (2, 2, 5.0)]


def test_gap_sessions(spark):
    rows = flight(1, 0, [0, 5, 5, 60, 5]) + flight(2, 0, [0])
    got = ingest.gap_sessions(spark.createDataFrame(rows, FIXES), "ts", "flight_id").collect()
    assert sorted((r.flight_id, r.n) for r in got) == [(1, 2), (1, 3), (2, 1)]


# ---------------------------------------------------------------- command line
GOOD = "AXXX0001\r\n" + "".join(f"B1015{s:02d}4512345N00630500EA012000125{s % 10}\r\n" for s in range(0, 50, 10))
XML = '<root><flights>{}</flights></root>'
ONE = '<flight id="{}" date="2012-05-01" pilot="A" igc_tracklog_link="https://host.invalid/{}.igc"/>'


@pytest.fixture
def archive(tmp_path):
    root = tmp_path / "data"
    season = root / "raw" / "tracks" / "2011-2012"
    season.mkdir(parents=True)
    (root / "raw" / "xml").mkdir()
    for name in ("catalog", "derived", "logs"):
        (root / name).mkdir()
    (root / "raw" / "xml" / "2011.xml").write_text(XML.format("".join(ONE.format(i, i) for i in (12, 13, 14))))
    (season / "2012-05-01_12.igc").write_bytes(GOOD.encode())
    (season / "2012-05-01_13.igc").write_bytes(b"<html>" + b"x" * 200)
    (season / "2012-05-01_15.igc").write_bytes(b"A")
    (season / "2012-05-01_16.igc.part").write_bytes(b"half")
    (season / "._2012-05-01_12.igc").write_bytes(b"side")
    (season / "2012-05-01_17.igc").write_bytes(GOOD.encode())
    (season / ".2012-05-01_17.igc.crc").write_bytes(b"crc\0\0\0\2\0" + b"\0" * 8)  # reading it is an error
    (tmp_path / "archive.yaml").write_text(f"data_root: {root}\nseasons:\n  start: 2011\n  end: 2012\n")
    return Archive(str(root), 2011, 2012), str(tmp_path / "archive.yaml")


def test_verify_outlives_files_that_cannot_be_read(spark, archive):
    found = {r.path.rsplit("/", 1)[-1]: r.category for r in cli.verify(spark, archive[0]).collect()}
    hidden = {"._2012-05-01_12.igc": "sidecar"}  # listings of Hadoop leave names with a leading dot out
    assert {**hidden, **found} == hidden | {"2012-05-01_13.igc": "invalid_structure", "2012-05-01_15.igc": "too_small", "2012-05-01_16.igc.part": "leftover", "2012-05-01_17.igc": "unreadable"}
    rows = {r.season: (r.n_igc, r.problems - ("._2012-05-01_12.igc" in found), r.failures) for r in cli.verify_report(cli.checked_files(spark, archive[0])).collect()}
    assert rows == {"2011-2012": (4, 4, 4), None: (4, 4, 4)}


def test_commands(spark, archive, capsys):
    root, config = archive
    assert cli.main(["--config", config, "verify"]) == 1
    assert "2011-2012" in capsys.readouterr().out
    problems = spark.read.csv(root.path("logs", "problems"), header=True)
    assert {r.category for r in problems.collect()} >= {"unreadable", "too_small", "invalid_structure", "leftover"} and problems.columns == ["season", "category", "path"]
    assert cli.main(["--config", config, "build-catalog"]) == 0
    flights = {r.flight_id: (r.downloaded, r.season_year) for r in spark.read.csv(root.path("catalog", "flights"), header=True).collect()}
    assert flights == {"12": ("true", "2011"), "13": ("true", "2011"), "14": ("false", "2011")}
    assert spark.read.csv(root.path("catalog", "seasons"), header=True).first().n_downloaded == "2"
    assert cli.main(["--config", config, "status", "--seasons", "2011"]) == 0
    assert "n_missing" in capsys.readouterr().out
    assert cli.main(["--config", config, "plan", "--limit", "2"]) == 0
    assert "n_to_download" in capsys.readouterr().out
    (spark.sparkContext._jvm.java.io.File(f"{root.path('raw/tracks')}/2011-2012/2012-05-01_17.igc")).delete()
    assert cli.main(["--config", config, "census"]) == 0
    census = spark.read.parquet(root.path("derived", "census")).collect()
    assert [(r.source, r.flight_id, r.n_fix) for r in census] == [("data", "12", 5)]
    with pytest.raises(FileNotFoundError):
        cli.check_root(Archive("/nowhere/at/all", 2011, 2012))


def test_download_plan(spark):
    rows = [(2011, i, f"https://host.invalid/{i}.igc" if i % 4 else "", i % 3 == 0) for i in range(1, 13)] + [(2012, 20, "x", None), (2012, 21, None, True)]
    table = spark.createDataFrame(rows, "season_year int, flight_id long, igc_link string, downloaded boolean")
    plan = lambda limit: {r.season_year: (r.n_to_download, r.n_skipped) for r in catalog.download_plan(table, limit).collect()}
    assert plan(None) == {2011: (6, 3), 2012: (1, 0), None: (7, 3)}
    assert plan(4) == {2011: (3, 1), 2012: (1, 0), None: (4, 1)}
