"""Streaming flows run to the end of their input, compared with the batch answer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..streaming import flows
from .detection_queries import NOW, assigned_sql
from .history_queries import WITH_H
from .registry import query
from .source_queries import payloads
from .store_queries import WITH_FB
from .scan import ScanOptions


def scratch(spark) -> str:
    """A new folder below the cluster's shared one; a local folder only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/stream-{uuid.uuid4()}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="sparkwarden-stream-")


def drain(spark, stream, base):
    """All rows of an append stream, written by the sink and read back."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt").outputMode("append")
    writer.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def source(spark, sf, name, files=1):
    """A table as a stream, be it one file or a folder of files; a path that is no pattern would have to be a folder."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


@query("feedback_rollup_stream", f"{WITH_FB} SELECT * FROM buckets")
def _(spark, sf):
    base = scratch(spark)
    k, user = F.col("k"), F.col("user_id")
    some = lambda c: F.when(k % 10 == 0, "").otherwise(c)
    e = source(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("ms", fx.event_ms())
    rule = F.concat(F.lit("rule_"), F.col("event_type"), F.lit("_"), (user % 3).cast("string"))
    events = e.select(
        F.left(F.sha2(rule, 256), F.lit(24)).alias("rule_fingerprint"),
        F.when(k % 2 == 0, "vscode").otherwise("cli").alias("source"),
        fx._pick(k % 4, (0, "line"), (1, "file"), (2, "global"), (3, "package")).alias("scope"),
        some(fx._pick(F.col("event_type"), *fx.TYPE)).alias("finding_type"),
        some(fx._pick(user % 3, (0, "L1"), (1, "L2"), (2, "L3"))).alias("detection_layer"),
        some(fx._pick(F.col("event_type"), *fx.SEVERITY)).alias("severity"),
        F.col("ms").alias("received_at"),
    )
    flows.feedback_rollup_stream(events, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return flows.read_rollup(spark, f"{base}/out")


@query(
    "debounced_changes",
    """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM s)
    SELECT user_id AS document, count(*) AS edits, arg_max(event_type, ts) AS text, min(epoch_us(ts)) AS first_change, max(epoch_us(ts)) AS last_change FROM g GROUP BY user_id, grp""",
)
def _(spark, sf):
    ts = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    changes = fx.table(spark, sf, "events").select(F.col("user_id").alias("document"), ts.alias("ts"), F.col("event_type").alias("text"))
    out = flows.debounced_changes(changes, "6 hours")
    return out.select("document", "edits", "text", F.unix_micros("first_change").alias("first_change"), F.unix_micros("last_change").alias("last_change"))


RATE = """RECURSIVE ev AS (SELECT 's' || (user_id % 30) AS source, epoch_us(ts) // 1000 AS "at", event_id AS id,
  row_number() OVER (PARTITION BY user_id % 30 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
w AS (SELECT source, "at", id, n, "at" AS opened, 1 AS used FROM ev WHERE n = 1
  UNION ALL SELECT e.source, e."at", e.id, e.n, CASE WHEN e."at" - w.opened >= 7200000 THEN e."at" ELSE w.opened END,
    CASE WHEN e."at" - w.opened >= 7200000 THEN 1 ELSE w.used + 1 END FROM w JOIN ev e ON e.source = w.source AND e.n = w.n + 1)"""


def sourced(e):
    return e.select(F.concat(F.lit("s"), (F.col("user_id") % 30).cast("string")).alias("source"), fx.event_ms().alias("at"), F.col("event_id").alias("id"))


@query("rate_limit", f'WITH {RATE} SELECT source, "at", id, used <= 2 AS allowed FROM w')
def _(spark, sf):
    return flows.rate_limit(sourced(fx.table(spark, sf, "events")), limit=2, window_ms=7_200_000)


@query(
    "first_seen_alerts",
    f"""{WITH_H}, numbered AS (SELECT *, row_number() OVER (PARTITION BY coalesce(project, '') ORDER BY completed_at, scan_id) AS n FROM runs),
    act AS (SELECT f.scan_id, finding_id, coalesce(project, '') AS project, n FROM f JOIN numbered USING (scan_id) WHERE NOT dismissed AND severity = 'critical')
    SELECT scan_id, finding_id FROM act a WHERE NOT EXISTS (SELECT 1 FROM act b WHERE b.project = a.project AND b.finding_id = a.finding_id AND b.n = a.n - 1)""",
)
def _(spark, sf):
    return flows.first_seen_alerts(fx.history(spark, sf))


@query("rate_limit_stream", f'WITH {RATE} SELECT source, "at", id, used <= 2 AS allowed FROM w')
def _(spark, sf):
    return drain(spark, flows.rate_limit_stream(sourced(source(spark, sf, "events")), limit=2, window_ms=7_200_000), scratch(spark))


@query(
    "first_seen_stream",
    f"""{WITH_H}, numbered AS (SELECT *, row_number() OVER (PARTITION BY coalesce(project, '') ORDER BY completed_at, scan_id) AS n FROM runs),
    act AS (SELECT finding_id, coalesce(project, '') AS document, n, completed_at FROM f JOIN numbered USING (scan_id) WHERE NOT dismissed AND severity = 'critical')
    SELECT document, completed_at AS "at", finding_id FROM act a
    WHERE NOT EXISTS (SELECT 1 FROM act b WHERE b.document = a.document AND b.finding_id = a.finding_id AND b.n = a.n - 1)""",
)
def _(spark, sf):
    base, h = scratch(spark), fx.history(spark, sf)
    shown = h.findings.filter("NOT dismissed AND severity = 'critical'").groupBy("scan_id").agg(F.collect_set("finding_id").alias("ids"))
    scans = h.runs.join(shown, "scan_id", "left").select(
        F.coalesce("project", F.lit("")).alias("document"), F.col("completed_at").alias("at"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids")
    )
    scans.write.parquet(f"{base}/in")
    return drain(spark, flows.first_seen_stream(spark.readStream.schema(scans.schema).parquet(f"{base}/in")), base)


@query(
    "debounced_stream",
    """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM s)
    SELECT user_id AS document, count(*) AS edits, arg_max(event_type, ts) AS text, min(epoch_us(ts)) AS first_change, max(epoch_us(ts)) AS last_change FROM g
    GROUP BY user_id, grp HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events)""",
)
def _(spark, sf):
    ts = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    changes = source(spark, sf, "events").select(F.col("user_id").alias("document"), ts.alias("ts"), F.col("event_type").alias("text"))
    out = drain(spark, flows.debounced_changes(changes.withWatermark("ts", "0 seconds"), "6 hours"), scratch(spark))
    return out.select("document", "edits", "text", F.unix_micros("first_change").alias("first_change"), F.unix_micros("last_change").alias("last_change"))


@query(
    "scan_stream",
    f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS file, text FROM documents), {assigned_sql('d')}
    SELECT file, 'hardcoded_secret_assignment' AS detection_rule, count(*) AS n FROM asg GROUP BY file""",
)
def _(spark, sf):
    base = scratch(spark)
    corpus = source(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "text", F.col("lang").alias("language"))
    flows.scan_stream(corpus, f"{base}/out", f"{base}/ckpt", NOW, ScanOptions(packages="off")).awaitTermination()
    return flows.current_findings(spark, f"{base}/out").groupBy("file", "detection_rule").agg(F.count("*").alias("n"))


@query(
    "ingest_stream",
    """SELECT event_type || '_' || user_id AS scan_id, count(*) AS findings, 1::BIGINT AS audits, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS refused
    FROM events WHERE user_id % 7 = 0 GROUP BY event_type, user_id""",
)
def _(spark, sf):
    """Payloads in two batches; those of even users come twice in the first and once more in the second."""
    base = scratch(spark)
    all_ = payloads(spark, sf)
    even = all_.filter(F.substring_index("payload_id", "_", -1).cast("int") % 2 == 0)
    even.unionByName(even.withColumn("payload_id", F.concat("payload_id", F.lit("_again")))).write.parquet(f"{base}/in")
    flows.ingest_stream(spark.readStream.schema(all_.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/ckpt").awaitTermination()
    all_.write.mode("append").parquet(f"{base}/in")
    flows.ingest_stream(spark.readStream.schema(all_.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/ckpt").awaitTermination()
    history = flows.read_ingested(spark, f"{base}/out")
    audits = spark.read.parquet(f"{base}/out/audit_event").groupBy(F.substring("event_id", 7, 1000).alias("scan_id")).agg(F.count("*").alias("audits"))
    refused = spark.read.parquet(f"{base}/out/rejected").filter(F.array_contains("errors", "duplicate_scan"))
    refused = refused.groupBy(F.regexp_replace("payload_id", "_again$", "").alias("scan_id")).agg(F.count("*").alias("refused"))
    counts = history.findings.groupBy("scan_id").agg(F.count("*").alias("findings"))
    out = history.runs.select("scan_id").join(counts, "scan_id").join(audits, "scan_id", "left").join(refused, "scan_id", "left")
    return out.select("scan_id", "findings", "audits", F.coalesce("refused", F.lit(0)).alias("refused"))
