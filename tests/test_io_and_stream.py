import os

from pyspark.sql import functions as F

from greenledger.operators import archive as A, health as H
from greenledger.sources import pages as PG, readers, writers
from greenledger.streaming import health as SH, jobs


def test_html_outline(spark):
    html = ("<html><head><title>Title</title><meta name='description' content='A long public description for a park policy document that is clearly longer than fifty characters.'></head><body><a href='/a'>zero carbon park policy update</a>"
            "<p>This is a sufficiently long paragraph for the parser and it contains public information about an industrial park project.</p></body></html>")
    row = PG.extract_pages(readers.landed_pages(spark.createDataFrame([("https://x.example/i", html)], "url string, html string")), ["url"]).first()
    assert (row["page_title"], row["links"][0]["href"], len(row["paragraphs"])) == ("Title", "/a", 1)
    assert "description" in row["meta"]


def test_bytes_are_capped_and_decoded(spark):
    df = spark.createDataFrame([("a", bytearray("零碳园区".encode()) + b"\xff", "text/html"), ("b", bytearray(b"x"), "image/png")], "url string, body binary, content_type string")
    rows = readers.landed_pages(df, max_bytes=13).collect()
    assert len(rows) == 1 and rows[0]["html"].startswith("零碳园区") and rows[0]["html"] != "零碳园区"


def test_archive_lines(spark, tmp_path):
    path = str(tmp_path / "archive.jsonl")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write('﻿{"title": "a", "url": "https://x.example/1"}\n\nnot json\n[{"title": "no"}]\n"text"\n{"title": "b"}\n')
    assert sorted(r["title"] for r in readers.read_archive(spark, path).collect()) == ["a", "b"]
    assert readers.read_archive(spark, str(tmp_path / "none")).count() == 0
    out = str(tmp_path / "out")
    writers.write_lines(readers.read_archive(spark, path), out)
    assert readers.read_archive(spark, out).count() == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text', "x")], "no int, task string, extra string")
    writers.export_csv(df, str(tmp_path / "t"), {"no": "序号", "task": "任务"})
    got = readers.read_table(spark, str(tmp_path / "t"), ["序号", "任务"]).collect()
    assert [tuple(r) for r in got] == [("1", 'a "quoted", text')]
    assert readers.read_table(spark, str(tmp_path / "none"), ["a"]).count() == 0


def test_reports_and_no_op_write(spark, tmp_path):
    rows = spark.createDataFrame([("daily", "2026-08-16", 1), ("daily", "2026-08-17", 2), ("weekly", "2026-08-17", 3)], "report_type string, report_date string, n int")
    writers.write_reports(rows, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert {(r["report_type"], str(r["report_date"])) for r in writers.report_index(back).collect()} == {("daily", "2026-08-17"), ("weekly", "2026-08-17")}
    assert writers.latest_reports(back).count() == 2
    archive = spark.createDataFrame([("u1", "h1", "2026-08-01")], "canonical_url string, content_hash string, published_date string")
    assert not writers.write_archive_if_changed(archive, archive, str(tmp_path / "a"), ["canonical_url", "content_hash"])
    assert writers.write_archive_if_changed(archive, archive.limit(0), str(tmp_path / "a"), ["canonical_url", "content_hash"])
    assert os.path.isdir(tmp_path / "a" / "published_month=2026-08")


def test_policy_defaults(spark):
    row = readers.read_policy(spark).first()
    assert (row["daily_limit"], row["weekly_limit"], row["near_duplicate_threshold"]) == (12, 28, 0.9)


EVENTS = [(s, f"2024-01-{d:02d} 00:00:00", i, ok) for i, (s, d, ok) in enumerate(
    [("a", k, False) for k in range(1, 9)] + [("b", k, k == 3) for k in range(1, 7)] + [("c", k, True) for k in range(1, 4)] + [("d", 1, True), ("d", 2, False)])]


def attempts(spark, rows=EVENTS):
    return spark.createDataFrame(rows, "source string, at string, tie int, ok boolean").withColumn("at", F.col("at").cast("timestamp"))


def test_health_states(spark):
    got = {r["source"]: (r["status"], r["consecutive_failures"]) for r in H.health_state(attempts(spark), "source", "at", "ok", "tie").collect()}
    assert got == {"a": ("quarantined", 8), "b": ("watch", 3), "c": ("healthy", 0), "d": ("failed", 1)}


def test_streamed_health_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(4):
        attempts(spark, [e for e in EVENTS if (int(e[1][8:10]) - 1) // 2 == part]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(attempts(spark).schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = jobs.stream_health(stream, str(tmp_path / "job"), "source", "at", "ok", "tie", {"availableNow": True})
    run.awaitTermination(120)
    state = jobs.latest_version(spark, str(tmp_path / "job") + "/state")
    columns = ["source", "status", "consecutive_failures", "last_attempt", "last_success", "attempts"]
    batch = H.health_state(attempts(spark), "source", "at", "ok", "tie")
    assert sorted(map(tuple, state.select(columns).collect()), key=str) == sorted(map(tuple, batch.select(columns).collect()), key=str)


def test_streamed_archive(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "url string, title string, summary string, published_date string"
    for rows in ([("http://e.example/1", "a", "x", "2026-01-01")], [("https://e.example/1/", "a", "y", "2026-01-01"), ("https://e.example/2", "b", "x", "2026-01-02")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.stream_archive(stream, str(tmp_path / "job"), F.lit("2026-02-01"), trigger={"availableNow": True}).awaitTermination(120)
    state = {r["canonical_url"]: r["version_count"] for r in jobs.archive_state(spark, str(tmp_path / "job")).collect()}
    assert state == {"https://e.example/1": 2, "https://e.example/2": 1}


def test_archive_batches_write_the_buckets_they_touch(spark, tmp_path):
    """Three batches: equal to one merge after another, only touched buckets written, old versions retired, a batch run twice changes nothing."""
    folder, schema = str(tmp_path / "job"), "url string, title string, first_seen string"
    page = lambda i, title, seen: (f"https://e.example/{i}", title, seen)
    batches = [[page(i, "a", "2026-01-01") for i in range(60)], [page(7, "b", "2026-01-02"), page(7, "c", "2026-01-03"), page(99, "x", "2026-01-02")], [page(7, "c", "2026-01-04")]]
    whole, written = None, []
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema)
        written.append(jobs.merge_batch(frame, number, folder, F.lit("2026-02-01"), buckets=16))
        if number == 1:
            assert jobs.merge_batch(frame, number, folder, F.lit("2026-02-01"), buckets=16) == written[1]
        jobs.retire(spark, folder + "/state", number)
        whole = A.merge(frame.limit(0) if whole is None else whole, frame, F.lit("2026-02-01"))
        whole = spark.createDataFrame(whole.collect(), whole.schema)
    assert written[0] > 10 and written[1] == 2 and written[2] == 1
    state = jobs.archive_state(spark, folder)
    columns = ["canonical_url", "title", "content_hash", "previous_content_hash", "version_count", "first_seen", "last_seen"]
    assert sorted(map(tuple, state.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()), key=lambda r: r[0])
    assert jobs.merge_batch(spark.createDataFrame([], schema), 3, folder, F.lit("2026-02-01"), buckets=16) == 0
    jobs.retire(spark, folder + "/state", 4)
    assert all(len(v) == 1 for v in jobs.bucket_versions(spark, folder + "/state").values())
    assert jobs.archive_state(spark, folder).count() == 61


def test_keyed_health_equals_batch_and_calls_for_retests(spark, tmp_path):
    source, job = str(tmp_path / "in"), str(tmp_path / "job")
    late = [("z", f"2024-01-{d:02d} 00:00:00", 900 + d, True) for d in (13, 14, 15, 16)]
    rows = EVENTS + late
    for part in range(8):
        mine = [e for e in rows if (int(e[1][8:10]) - 1) // 2 == part]
        attempts(spark, mine).withColumn("records", F.col("tie")).withColumn("error", F.when(~F.col("ok"), F.concat(F.lit("E"), "tie"))).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        SH.start_health(stream, job, "source", "at", "ok", "tie", {"availableNow": True}).awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    columns = ["source", "status", "consecutive_failures", "last_attempt", "last_success", "attempts"]
    batch = H.health_state(attempts(spark, rows), "source", "at", "ok", "tie")
    table = SH.health_table(spark, job)
    assert sorted(map(tuple, table.select(columns).collect()), key=str) == sorted(map(tuple, batch.select(columns).collect()), key=str)
    last = {r["source"]: r for r in table.collect()}
    assert (last["a"]["last_error"], last["a"]["last_record_count"]) == ("E7", 7) and last["z"]["last_error"] is None
    calls = SH.health_changes(spark, job).filter("status = 'quarantined' AND due").collect()
    assert [(r["source"], str(r["last_attempt"])) for r in calls] == [("a", "2024-01-08 00:00:00")]  # once, after the 15th


def test_pieces_fold_like_single_attempts(spark):
    """A source's hour is one summary; runs of failures cross hours; ties, missing times."""
    import random

    import pandas as pd

    rnd = random.Random(5)
    rows = [("s", rnd.randrange(0, 40), i, rnd.random() < 0.2) for i in range(200)] + [("t", i, i, False) for i in range(30)] + [("t", None, 99, True)]
    frame = pd.DataFrame([(s, SH.EARLY if m is None else m * 600_000_000, t, ok, None, None, None) for s, m, t, ok in rows], columns=["source", "at", "tie", "ok", "records", "error", "start_url"])
    frame["piece"] = frame["at"] // SH.PIECE
    found = pd.concat(SH.fold_pieces(iter([frame.iloc[:90], frame.iloc[90:]])))
    assert len(found) == len(frame[["source", "piece"]].drop_duplicates()) and found["attempts"].sum() == len(rows)
    for s in "st":
        ordered = sorted(((SH.EARLY if m is None else m, t, ok) for n, m, t, ok in rows if n == s))
        run = 0
        for _, _, ok in ordered:
            run = 0 if ok else run + 1
        mine = found[found["source"] == s].sort_values("piece")
        wins = [i for i, w in enumerate(mine["won"]) if w]
        assert mine["fails"].tolist()[wins[-1] :] and sum(mine["fails"].tolist()[wins[-1] :]) == run


def test_streams_of_first_arrivals_and_rolling_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [[("k1", "2024-01-01 00:00:00", "x"), ("k2", "2024-01-01 01:00:00", "x"), ("k1", "2024-01-01 02:00:00", "y")], [("k1", "2024-01-01 03:00:00", "x"), ("k3", "2024-01-01 04:00:00", "y")]]
    schema = "key string, at timestamp, label string"
    for part in rows:
        spark.createDataFrame(part, "key string, at string, label string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for name, frame, mode in (("firsts", jobs.first_arrivals(read(), "key", "at", "1 day"), "append"), ("rolling", jobs.rolling_counts(read(), "at", "label", "2 days", "1 day"), "update")):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["key"] for r in spark.table("firsts").collect()) == ["k1", "k2", "k3"]
    counts = spark.table("rolling").groupBy("window", "label").agg(F.max("value").alias("value"))
    assert sorted((str(r["window"]["start"])[:10], r["label"], r["value"]) for r in counts.collect()) == [("2023-12-31", "x", 3), ("2023-12-31", "y", 2), ("2024-01-01", "x", 3), ("2024-01-01", "y", 2)]


def test_history_across_chunks(spark):
    log = spark.createDataFrame([("u", i, i // 3, h) for i, h in enumerate("aabbbcca")], "url string, at int, chunk int, hash string")
    got = A.version_history(log, "url", "chunk", [F.col("at")], "hash").orderBy("at").collect()
    assert [r["version"] for r in got] == [1, 1, 2, 2, 2, 3, 3, 4]
    assert [r["previous_content_hash"] for r in got] == [None, *"aabbbcc"]


def test_pages_are_parsed_in_small_pieces(monkeypatch):
    import pyarrow as pa

    from greenledger.sources import pages as PG

    monkeypatch.setattr(PG, "PIECE_ROWS", 3)
    monkeypatch.setattr(PG, "PIECE_BYTES", 10)
    html = ["a" * 4, None, "b" * 6, "c", "d" * 40, "e", "", "f", "g"]
    batch = pa.RecordBatch.from_arrays([pa.array(html)], names=["html"])
    got = [part.column("html").to_pylist() for part in PG.pieces(batch, batch.column("html"))]
    assert sum(got, []) == html and got == [html[:3], html[3:4], html[4:5], html[5:8], html[8:]]
