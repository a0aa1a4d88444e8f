from vantrail.streaming import ingest


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.igc").write_text("AXXX\nB1\n")
    for extra in (None, "b.igc"):
        if extra:
            (tmp_path / "in" / extra).write_text("AXXX\nB2\nB3\n")
        ingest.land(ingest.track_lines_stream(spark, src, "paragliders"), out, mark).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted(r.line for r in rows.collect() if r.line) == ["AXXX", "AXXX", "B1", "B2", "B3"]
