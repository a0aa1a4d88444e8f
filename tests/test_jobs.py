"""The jobs over small and growing inputs: what is new is taken once, reruns change nothing, and the command lines work."""

import logging
import os
import shutil
import subprocess
import sys
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobs import track_census, verify_texts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SOUND = "Title\n" + "A line of the body. " * 8
TEXTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts(spark, folder, name, rows):
    """One more file of texts in ``folder``."""
    tmp = f"{folder}-{name}"
    spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], TEXTS).coalesce(1).write.parquet(tmp)
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
    shutil.move(f"{tmp}/{part}", f"{folder}/{name}.parquet")


def checks(df):
    return {r.doc_id: (r.source, r.category, r.failure, r.n_lines, r.n_body) for r in df.collect()}


def test_verification_takes_new_files_only(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, logger="jobs.verify_texts")
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    texts(spark, src, "a", [(1, SOUND, "x"), (2, None, "x"), (3, "no header\n" * 30, None)])
    first = checks(verify_texts.run(spark, src, out, mark))
    assert first == {1: ("x", "sound", False, 2, 1), 2: ("x", "too_small", True, 1, 0), 3: (None, "invalid_structure", True, 31, 0)}
    assert "read 3 new rows" in caplog.text
    files = set(os.listdir(f"{out}/checks/category=sound"))
    texts(spark, src, "b", [(4, SOUND.replace("\n", "\r\n"), "y"), (5, "short", "y")])
    caplog.clear()
    second = checks(verify_texts.run(spark, src, out, mark))
    assert second == first | {4: ("y", "sound", False, 2, 1), 5: ("y", "too_small", True, 1, 0)}
    assert "read 2 new rows" in caplog.text and "holds 2 rows of category sound" in caplog.text
    assert files < set(os.listdir(f"{out}/checks/category=sound"))  # what was written stays as it was
    caplog.clear()
    again = verify_texts.run(spark, src, out, mark)
    assert checks(again) == second and again.count() == 5 and "read 0 new rows" in caplog.text
    report = {(r.source, r.category): r.n for r in spark.read.parquet(f"{out}/report").collect()}
    assert report == Counter((s, c) for s, c, *_ in second.values())


def test_verification_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = verify_texts.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert out.count() == 0


def test_verification_goes_on_after_a_stop(spark, tmp_path):
    """A run with one file a batch that is lost after its first batch leaves a mark from which the next goes on."""
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for i in range(4):
        texts(spark, src, f"f{i}", [(10 * i + k, SOUND, "x") for k in range(3)])
    s = verify_texts.load_settings()
    one = verify_texts.Settings(**{**vars(s), "max_files": 1})
    verify_texts.run(spark, src, out, mark, one)
    last = max(os.listdir(f"{mark}/commits"), key=lambda n: int(n) if n.isdigit() else -1)
    os.remove(f"{mark}/commits/{last}")  # as if the run had ended before the batch was known to be whole
    if os.path.exists(crc := f"{mark}/commits/.{last}.crc"):
        os.remove(crc)
    again = verify_texts.run(spark, src, out, mark, one)
    assert sorted(r.doc_id for r in again.collect()) == [10 * i + k for i in range(4) for k in range(3)]


def test_settings_are_checked(tmp_path):
    (tmp_path / "c.yaml").write_text("schema: a int\nsurprise: 1\n")
    for load in (verify_texts.load_settings, track_census.load_settings):
        with pytest.raises(TypeError):
            load(tmp_path / "c.yaml")


BEGIN = datetime(2024, 3, 1, 9)


def events(rows):
    """rows: (user, day, minutes from nine o'clock, value)"""
    return [(i, BEGIN + timedelta(days=d, minutes=m), u, "view", float(v), "{}") for i, (u, d, m, v) in enumerate(rows)]


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def archive(spark, tmp_path):
    def land(name, rows):
        spark.createDataFrame(events(rows), EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    spark.createDataFrame([(1, "AUTO"), (2, "MACHINERY"), (2, "BUILDING")], "c_custkey bigint, c_mktsegment string").write.parquet(str(tmp_path / "catalog"))
    return lambda name="events": str(tmp_path / name), land, str(tmp_path / "catalog"), str(tmp_path / "out")


#: The track view's clock runs a thousand times slower than that of events.
SHORT = track_census.Settings("yyyy-MM-dd", "c_custkey", "c_mktsegment", {"min_duration_s": 20.0, "min_path_km": 1.0, "min_alt_range_m": 75.0})
FIRST = [(1, 0, m, 10 * m) for m in range(0, 400, 5)] + [(2, 0, 0, 1), (2, 0, 400, 2)] + [(10, 1, m, m) for m in range(3)] + [(4, 1, 0, 0)]


def by_flight(df):
    return {r.flight_id: (r.source, r.period, r.stratum, r.n_fix, r.reason) for r in df.collect()}


def test_census_reruns_with_the_same_result(spark, archive, caplog):
    caplog.set_level(logging.INFO, logger="jobs.track_census")
    path, land, catalog, out = archive
    land("events", FIRST)
    first = track_census.run(spark, path(), catalog, out, settings=SHORT)
    assert by_flight(first) == {1: ("paragliders", "2024-03-01", "AUTO", 80, None), 2: ("paragliders", "2024-03-01", "BUILDING", 2, "short_path"), 10: ("hang gliders", "2024-03-02", None, 3, "too_short")}
    rows = sorted(map(str, first.collect()))
    assert sorted(map(str, track_census.run(spark, path(), catalog, out, settings=SHORT).collect())) == rows
    assert "read 86 events" in caplog.text and "holds 2 flights of paragliders in 1 periods, 1 of them kept" in caplog.text
    sums = {(r.source, str(r.period)): (r.n, r.n_kept, r.n_short_path, r.n_too_short) for r in spark.read.parquet(f"{out}/summary").collect()}
    assert sums == {("paragliders", "2024-03-01"): (2, 1, 1, 0), ("hang gliders", "2024-03-02"): (1, 0, 0, 1)}


def test_census_of_chosen_periods_leaves_the_others(spark, archive):
    path, land, catalog, out = archive
    land("events", FIRST)
    track_census.run(spark, path(), catalog, out, settings=SHORT)
    kept = set(os.listdir(f"{out}/flights/source=paragliders/period=2024-03-01"))
    land("events", [(7, 2, m, m) for m in range(4)] + [(10, 1, 30, 5)])
    grown = by_flight(track_census.run(spark, path(), catalog, out, ["2024-03-02", "2024-03-03"], SHORT))
    assert grown[7][:2] == ("paragliders", "2024-03-03") and grown[10][3] == 4 and len(grown) == 4
    assert kept == set(os.listdir(f"{out}/flights/source=paragliders/period=2024-03-01"))
    assert by_flight(track_census.run(spark, path(), catalog, out, settings=SHORT)) == grown
    assert spark.read.parquet(f"{out}/summary").agg(F.sum("n")).first()[0] == 4


def test_census_of_nothing(spark, archive):
    path, land, catalog, out = archive
    land("events", [])
    assert track_census.run(spark, path(), catalog, out, settings=SHORT).count() == 0


def test_command_lines(spark, tmp_path):
    texts(spark, str(tmp_path / "in"), "a", [(1, SOUND, "x"), (2, "short", "x")])
    spark.createDataFrame(events(FIRST), EVENTS).coalesce(1).write.parquet(str(tmp_path / "events"))
    spark.createDataFrame([(1, "AUTO")], "c_custkey bigint, c_mktsegment string").write.parquet(str(tmp_path / "catalog"))
    at = lambda n: str(tmp_path / n)
    run = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}, capture_output=True, text=True, timeout=300)
    verified = run("jobs.verify_texts", "--input", at("in"), "--output", at("checked"), "--checkpoint", at("mark"))
    assert verified.returncode == 1 and "read 2 new rows" in verified.stderr, verified.stderr[-2000:]
    counted = run("jobs.track_census", "--events", at("events"), "--catalog", at("catalog"), "--output", at("census"), "--periods", "2024-03-01")
    assert counted.returncode == 0 and "flights of paragliders" in counted.stderr, counted.stderr[-2000:]
    assert spark.read.parquet(at("checked/checks")).count() == 2 and spark.read.parquet(at("census/flights")).count() == 2
