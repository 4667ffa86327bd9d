"""Continuous forms of ingest, feedback, rate limiting, change debouncing, alerts and scanning.

Sinks write one folder per micro-batch and overwrite it on a replay, so a restarted batch leaves no duplicates; readers
merge the batches. That keeps state out of the streams wherever the result can be merged later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.findings import POSITION, unique_findings
from ..operators.history import History
from ..operators.ranks import numbered
from ..operators.retention import BUCKET_KEYS, feedback_buckets
from ..plans.scan import ScanOptions, scan_corpus
from ..session import share_code
from ..sources.ingest import SCHEMA_TAG, claim_scans, claimed_payloads, ingested, validate_payloads

# Quiet gaps before work starts, and the feedback limit.
DEBOUNCE = {"source_rules": "500 milliseconds", "review": "2 seconds", "packages": "600 milliseconds"}
WINDOW_MS, MAX_PER_WINDOW = 60_000, 60


def _batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _put(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def feedback_rollup_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Accepted feedback events to daily buckets: each batch stores its own counts."""
    return _batches(events, lambda df, n: _put(feedback_buckets(df), path, n), checkpoint)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Buckets over all batches."""
    return spark.read.parquet(path).groupBy(*BUCKET_KEYS).agg(
        F.sum("event_count").alias("event_count"),
        F.min("first_received_at").alias("first_received_at"),
        F.max("last_received_at").alias("last_received_at"),
    )


def ingest_stream(payloads: DataFrame, path: str, checkpoint: str, tag: str = SCHEMA_TAG) -> StreamingQuery:
    """Payloads to history tables, a quarantine and one audit row per accepted scan.

    Each batch first claims the scans it brings, against the claims of all earlier batches, and stores the claims; only payloads
    that hold one are written. So a payload for a known scan is refused as a whole, also inside a batch, and leaves no audit row.
    A replayed batch sees the same earlier claims and makes the same ones again.
    """

    def write(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        checked = validate_payloads(df, tag).persist()
        earlier = spark.read.schema("scan_id string, batch int").parquet(f"{path}/claims").filter(F.col("batch") < n) if n else None
        _put(claim_scans(checked, earlier), f"{path}/claims", n)
        runs, findings, rejected = ingested(claimed_payloads(checked, spark.read.parquet(f"{path}/claims/batch={n}")))
        _put(runs, f"{path}/scan_run", n)
        _put(findings, f"{path}/finding_result", n)
        _put(rejected, f"{path}/rejected", n)
        audit = runs.select(
            F.concat(F.lit("audit_"), "scan_id").alias("event_id"), F.col("completed_at").alias("occurred_at"),
            F.lit("ingest").alias("authentication"), F.lit("scan_ingested").alias("action"), F.lit("success").alias("outcome"), "project",
        )
        _put(audit, f"{path}/audit_event", n)
        checked.unpersist()

    return _batches(payloads, write, checkpoint)


def read_ingested(spark: SparkSession, path: str) -> History:
    """History of the stream: every scan was claimed once. Findings that repeat an id within their scan count once."""
    findings = spark.read.parquet(f"{path}/finding_result").drop("batch")
    rest = [F.col(c).cast("string") for c in sorted(findings.columns) if c not in ("scan_id", "finding_id")]
    rank = F.row_number().over(Window.partitionBy("scan_id", "finding_id").orderBy(F.xxhash64(*rest)))
    return History(spark.read.parquet(f"{path}/scan_run").drop("batch"), findings.withColumn("_rn", rank).filter("_rn = 1").drop("_rn"))


def debounced_changes(changes: DataFrame, gap: str = DEBOUNCE["source_rules"], document: str = "document", ts: str = "ts") -> DataFrame:
    """Newest revision of each document once it has been quiet for ``gap``: ``changes(document, ts, text)``. Of revisions of
    one moment the greatest text counts.

    Works on a table and, after ``withWatermark``, on a stream in append mode.
    """
    return (
        changes.groupBy(document, F.session_window(ts, gap).alias("w"))
        .agg(F.max_by("text", F.struct(ts, "text")).alias("text"), F.count("*").alias("edits"), F.max(ts).alias("last_change"))
        .select(document, F.col("w.start").alias("first_change"), "last_change", "edits", "text")
    )


def rate_limit(events: DataFrame, limit: int = MAX_PER_WINDOW, window_ms: int = WINDOW_MS) -> DataFrame:
    """Whether each event ``(source, at, id)`` passes: a window opens with a source's first event and admits ``limit``.

    The next window opens with the first event after it ends, so a source is read in order. Rows stream through sorted
    partitions with two numbers of state; no source is collected.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, opened, used = None, 0, 0
        for pdf in batches:
            verdicts = []
            for s, at in zip(pdf["source"], pdf["at"]):
                if s != source or at - opened >= window_ms:
                    source, opened, used = s, at, 0
                used += 1
                verdicts.append(used <= limit)
            yield pdf.assign(allowed=verdicts)

    share_code(events.sparkSession)
    columns = events.select("source", "at", "id")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema.fields)
    ordered = columns.repartition("source").sortWithinPartitions("source", "at", "id")
    return ordered.mapInPandas(walk, ddl + ", allowed boolean")


def _admit(limit: int, window_ms: int):
    """Rows of a source in one micro-batch are put in order as a whole, however many Arrow chunks they arrive in."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used = state.get if state.exists else (None, 0)
        rows, verdicts = pd.concat(list(chunks)).sort_values(["at", "id"]), []
        for at in rows["at"]:
            if opened is None or at - opened >= window_ms:
                opened, used = int(at), 0
            used += 1
            verdicts.append(used <= limit)
        state.update((opened, used))
        yield rows.assign(allowed=verdicts)[["source", "at", "id", "allowed"]]

    return step


def rate_limit_stream(events: DataFrame, limit: int = MAX_PER_WINDOW, window_ms: int = WINDOW_MS) -> DataFrame:
    """``rate_limit`` on a stream. The state of a source is two numbers; its rows of one micro-batch are read together, so
    the trigger bounds memory. Events of an earlier micro-batch count as earlier."""
    share_code(events.sparkSession)
    return events.select("source", "at", "id").groupBy("source").applyInPandasWithState(
        _admit(limit, window_ms), "source string, at bigint, id bigint, allowed boolean", "opened bigint, used int", "append",
        GroupStateTimeout.NoTimeout,
    )


def first_seen_alerts(h: History, severity: str = "critical") -> DataFrame:
    """Active findings of a severity that the previous run of their project did not show; they alert again after a gap."""
    runs = h.runs.select("scan_id", F.coalesce("project", F.lit("\u0000")).alias("_project"), "completed_at")
    runs = numbered(runs, ["_project"], ["completed_at", "scan_id"], "_n").select("scan_id", "_project", "_n")
    active = h.findings.filter(~F.col("dismissed") & (F.col("severity") == severity)).join(runs, "scan_id")
    before = F.lag("_n").over(Window.partitionBy("_project", "finding_id").orderBy("_n"))
    return active.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") < F.col("_n") - 1)).select("scan_id", "finding_id")


def _first_shown(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Identifiers that the scan before did not show. A scan older than the newest one known is late and changes nothing."""
    newest, shown = state.get if state.exists else (None, [])
    known, out = set(shown), []
    for at, ids in pd.concat(list(chunks)).sort_values("at")[["at", "ids"]].itertuples(index=False):
        if newest is not None and at < newest:
            continue
        now = set(ids)
        out += [(key[0], int(at), i) for i in sorted(now - known)]
        newest, known = int(at), now
    state.update((newest, sorted(known)))
    yield pd.DataFrame(out, columns=["document", "at", "finding_id"])


def first_seen_stream(scans: DataFrame) -> DataFrame:
    """Alerts of ``scans(document, at, ids)``, one row per scan with its active critical identifiers."""
    share_code(scans.sparkSession)
    return scans.select("document", "at", "ids").groupBy("document").applyInPandasWithState(
        _first_shown, "document string, at bigint, finding_id string", "newest bigint, ids array<string>", "append", GroupStateTimeout.NoTimeout
    )


def scan_stream(corpus: DataFrame, path: str, checkpoint: str, now: int, options: ScanOptions = ScanOptions()) -> StreamingQuery:
    """Scan arriving texts; each batch stores its findings and which files it scanned with which layers."""

    def write(df: DataFrame, n: int) -> None:
        _put(scan_corpus(df, now, options).select("id", "severity", *POSITION, "detection_layer", "evidence", "dismissed"), f"{path}/findings", n)
        layers = F.explode(F.array(*[F.lit(x) for x in options.layers])).alias("detection_layer")
        _put(df.select("file").distinct().select("file", layers), f"{path}/scanned", n)

    return _batches(corpus, write, checkpoint)


def current_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of the newest scan of each (file, layer); layers a later scan did not run keep theirs."""
    latest = spark.read.parquet(f"{path}/scanned").groupBy("file", "detection_layer").agg(F.max("batch").alias("batch"))
    found = spark.read.parquet(f"{path}/findings").join(latest, ["file", "detection_layer", "batch"])
    return unique_findings(found, ["id"]).drop("batch")
