"""Stateful streams give the same answer as their batch forms."""

import json

from pyspark.sql import functions as F

from sparkwarden.sources import ingest
from sparkwarden.streaming import flows


def run(spark, df, ckpt):
    out = f"{ckpt}/out"
    df.writeStream.format("parquet").option("checkpointLocation", f"{ckpt}/c").trigger(availableNow=True).outputMode("append").start(out).awaitTermination()
    return spark.read.parquet(out)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    events = spark.range(400).select(
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), ((F.col("id") * 277) % 400 * 400).alias("at"), "id"
    )
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # a source's rows come in many chunks
    try:
        got = run(spark, flows.rate_limit_stream(stream, 10), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = flows.rate_limit(events, 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 0 < want.filter("allowed").count() < 400


def test_alerts_return_after_resolution(spark, tmp_path):
    scans = spark.createDataFrame(
        [("d", 1, ["a"]), ("d", 2, ["a", "b"]), ("d", 3, ["b"]), ("d", 4, ["a", "b"]), ("e", 1, ["a"])],
        "document string, at bigint, ids array<string>",
    )
    scans.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scans.schema).parquet(str(tmp_path / "in"))
    got = run(spark, flows.first_seen_stream(stream), str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("d", 1, "a"), ("d", 2, "b"), ("d", 4, "a"), ("e", 1, "a")]


def test_late_scans_change_nothing(spark, tmp_path):
    first = spark.createDataFrame([("d", 5, ["a"])], "document string, at bigint, ids array<string>")
    late = spark.createDataFrame([("d", 3, ["b"]), ("d", 6, ["a", "c"])], first.schema)
    stream = lambda: spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(spark, flows.first_seen_stream(stream()), str(tmp_path))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, flows.first_seen_stream(stream()), str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("d", 5, "a"), ("d", 6, "c")]


def payload(number, scan, findings):
    body = {"schema": ingest.SCHEMA_TAG, "scan": {
        "scanId": scan, "startedAt": 1, "completedAt": 2, "project": "p", "cwd": "/w", "targetPaths": ["s"], "fileCount": 1,
        "findings": [{"id": f, "type": "xss", "severity": "high", "message": "m", "file": "a.py", "line": 1, "column": 1, "evidence": "x",
                      "detection_layer": "L1", "detection_rule": "r", "timestamp": 1, "dismissed": False} for f in findings]}}
    return (number, json.dumps(body))


def test_a_known_scan_is_refused_whole(spark, tmp_path):
    ddl = "payload_id string, body string"
    first = [payload("p2", "s1", ["2", "3"]), payload("p1", "s1", ["1"]), payload("p1", "s1", ["1"]), payload("p3", "s2", [])]
    second = [payload("p4", "s1", ["4"]), payload("p5", "s3", ["5", "5"]), ("p6", "{broken")]
    src = str(tmp_path / "in")
    for rows in (first, second):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src)
        flows.ingest_stream(stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    history = flows.read_ingested(spark, f"{tmp_path}/out")
    assert sorted(r["scan_id"] for r in history.runs.collect()) == ["s1", "s2", "s3"]
    assert sorted((r["scan_id"], r["finding_id"]) for r in history.findings.collect()) == [("s1", "1"), ("s3", "5")]
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out/audit_event").collect()) == ["audit_s1", "audit_s2", "audit_s3"]
    refused = sorted((r["payload_id"], r["errors"][0]) for r in spark.read.parquet(f"{tmp_path}/out/rejected").collect())
    assert refused == [("p2", "duplicate_scan"), ("p4", "duplicate_scan"), ("p6", "invalid_json")]


def test_a_table_streams_as_a_file_and_as_a_folder(spark, tmp_path):
    import shutil

    from sparkwarden.plans import stream_queries as sq

    many, one = tmp_path / "many", tmp_path / "one"
    spark.range(10).repartition(2).write.parquet(f"{many}/events.parquet")
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/part")
    one.mkdir()
    shutil.copy(next((tmp_path / "part").glob("*.parquet")), one / "events.parquet")
    for folder in (many, one):
        assert sq.drain(spark, sq.source(spark, str(folder), "events"), str(tmp_path / f"{folder.name}_out")).count() == 10


def test_ingest_reads_its_payloads_in_two_batches(spark, tmp_path, monkeypatch):
    """However many files a batch has: its payloads are not drawn together into one."""
    import datetime
    import os

    from sparkwarden.plans import load_queries
    from sparkwarden.plans import stream_queries as sq

    base = str(tmp_path / "stream")
    monkeypatch.setattr(sq, "scratch", lambda spark: base)
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at, 7 * (i % 4), "click", 5.0, '{"k": 3}') for i in range(40)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.scan_id: (r.findings, r.audits, r.refused) for r in load_queries()[0]["ingest_stream"](spark, str(tmp_path)).collect()}
    assert got == {"click_0": (10, 1, 2), "click_7": (10, 1, 0), "click_14": (10, 1, 2), "click_21": (10, 1, 0)}
    assert sorted(x for x in os.listdir(f"{base}/out/claims") if x.startswith("batch=")) == ["batch=0", "batch=1"]
