"""Retention, storage budget, audit hygiene and anonymous feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import utc_day
from .findings import is_false_positive_event, rule_fingerprint
from .history import History


def prune_before(h: History, audit: DataFrame, feedback: DataFrame, timestamp: int) -> tuple[History, DataFrame, DataFrame]:
    """What remains after dropping runs completed before ``timestamp`` with their findings, older audit events and
    feedback buckets last touched before it."""
    old = h.runs.filter(F.col("completed_at") < timestamp)
    kept = History(
        h.runs.filter(F.col("completed_at") >= timestamp),
        h.findings.join(old.select("scan_id"), "scan_id", "left_anti"),
    )
    return kept, audit.filter(F.col("occurred_at") >= timestamp), feedback.filter(F.col("last_received_at") >= timestamp)


def prune_counts(h: History, audit: DataFrame, feedback: DataFrame, timestamp: int) -> DataFrame:
    """How many rows ``prune_before`` drops, one row."""
    old = h.runs.filter(F.col("completed_at") < timestamp).select("scan_id")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(old, "deleted_scans")
    for part in (
        count(h.findings.join(old, "scan_id", "left_semi"), "deleted_findings"),
        count(audit.filter(F.col("occurred_at") < timestamp), "deleted_audit_events"),
        count(feedback.filter(F.col("last_received_at") < timestamp), "deleted_feedback_buckets"),
    ):
        out = out.join(part, F.lit(True))
    return out


DAY_MS = 86_400_000
# Fixed value: default storage budget of the history.
DEFAULT_BUDGET = 100_000_000


def _size(df: DataFrame) -> Column:
    return F.length(F.to_json(F.struct(*df.columns))).cast("bigint")


def history_sizes(h: History, audit: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every disposable record with its size: a run counts with its findings. ``tier`` 0 goes first."""
    per_run = h.findings.groupBy("scan_id").agg(F.sum(_size(h.findings)).alias("_f"))
    runs = h.runs.withColumn("_r", _size(h.runs)).join(per_run, "scan_id", "left").select(
        F.lit(0).alias("tier"), F.col("completed_at").alias("at"), F.col("scan_id").alias("id"),
        (F.col("_r") + F.coalesce("_f", F.lit(0))).alias("bytes"),
    )
    events = audit.select(
        F.lit(1).alias("tier"), F.col("occurred_at").alias("at"), F.col("event_id").alias("id"), _size(audit).alias("bytes")
    )
    bucket_id = F.concat_ws("|", "day", "rule_fingerprint", "source", "scope", "finding_type", "detection_layer", "severity")
    buckets = feedback.select(
        F.lit(2).alias("tier"), F.col("last_received_at").alias("at"), bucket_id.alias("id"), _size(feedback).alias("bytes")
    )
    return runs.unionByName(events).unionByName(buckets)


#: Units by which the order is narrowed down: a day, then a minute of the days that matter.
_UNITS = (DAY_MS, 60_000)


def prune_to_budget(sizes: DataFrame, budget: int = DEFAULT_BUDGET, protected: str | None = None, strict: bool = True) -> DataFrame:
    """Records that fit the budget when the oldest runs go first, then audit events, then feedback.

    Kept from the newest end of that order while the running size stays within the budget; a protected id is always kept
    and counted first. If it alone exceeds the budget, that is an error; without ``strict`` it is kept and all else goes.

    Sizes are totalled per tier and day. What lies beyond the day in which the budget ends is dropped unsorted; the days that
    remain are totalled per minute in the same way, and only minutes that begin within the budget are put in order. So
    no task orders more than the records of a minute, and a window over all holds one row per tier and day.
    """
    guarded = F.lit(False) if protected is None else (F.col("id") == protected)
    too_large = F.raise_error(F.concat(F.lit("The protected record alone exceeds the storage budget: "), F.col("id")))
    rows = sizes.select("*", guarded.alias("protected"), F.when(guarded, 0).otherwise(1).alias("_guard"))
    if strict:
        rows = rows.withColumn(
            "bytes", F.when(F.col("protected") & (F.col("bytes") > budget), too_large.cast("bigint")).otherwise(F.col("bytes"))
        )
    rows = rows.withColumn("_offset", F.lit(0).cast("bigint"))
    key = ["_guard", "tier"]
    for i, unit in enumerate(_UNITS):
        rows = rows.withColumn(f"_u{i}", F.floor(F.col("at") / unit))
        totals = rows.groupBy(*key, f"_u{i}").agg(F.sum("bytes").alias("_sum"), F.first("_offset").alias("_before"))
        newest = [F.desc("tier"), F.desc(f"_u{i}")] if i == 0 else [F.desc(f"_u{i}")]
        ahead = Window.partitionBy(*(["_one"] if i == 0 else key)).orderBy(*(["_guard"] if i == 0 else []), *newest)
        totals = totals.withColumn("_one", F.lit(0)).withColumn(
            "_begin", F.col("_before") + F.coalesce(F.sum("_sum").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        within = totals.filter(F.col("_begin") <= budget).select(*key, f"_u{i}", "_begin")
        rows = rows.join(within, [*key, f"_u{i}"]).withColumn("_offset", F.col("_begin")).drop("_begin")
        key.append(f"_u{i}")
    ordered = Window.partitionBy(*key).orderBy(F.desc("at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.withColumn("running_bytes", F.col("_offset") + F.sum("bytes").over(ordered))
    return kept.filter((F.col("running_bytes") <= budget) | F.col("protected")).select("tier", "at", "id", "bytes", "running_bytes", "protected")


# Limits of stored audit details.
MAX_AUDIT_KEY, MAX_AUDIT_TEXT, MAX_AUDIT_ENTRIES = 80, 256, 16
SENSITIVE_KEY = "token|secret|cookie|authorization|password|code|key|credential"


def sanitize_text(value: Column, limit: int = MAX_AUDIT_TEXT) -> Column:
    return F.nullif(F.left(F.regexp_replace(F.trim(value), "[\\r\\n\\u0000]", " "), F.lit(limit)), F.lit(""))


def sanitize_details(details: Column) -> Column:
    """Safe form of a ``map<string,string>``: plain keys, cleaned short texts, at most 16 entries in their order.

    A key that repeats after normalisation takes its last value at its first place.
    """
    cleaned = F.transform(
        F.map_entries(details),
        lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), sanitize_text(e["value"]).alias("value")),
    )
    safe = F.filter(
        cleaned,
        lambda e: (e["key"] != "")
        & (F.length(e["key"]) <= MAX_AUDIT_KEY)
        & ~e["key"].rlike(SENSITIVE_KEY)
        & e["value"].isNotNull(),
    )
    keys = F.slice(F.array_distinct(F.transform(safe, lambda e: e["key"])), 1, MAX_AUDIT_ENTRIES)
    last = lambda k: F.element_at(F.filter(safe, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), last(k).alias("value"))))


def sanitize_audit(events: DataFrame) -> DataFrame:
    """Audit events with cleaned subject, action and details (``map<string,string>``)."""
    return (
        events.withColumn("subject", sanitize_text(F.col("subject")))
        .withColumn("action", F.coalesce(sanitize_text(F.col("action"), 120), F.lit("unknown")))
        .withColumn("details", sanitize_details(F.col("details")))
    )


# The only feedback event accepted.
FEEDBACK_FIELDS = ["schemaVersion", "event", "source", "scope", "ruleFingerprint", "findingType", "detectionLayer", "severity"]
FEEDBACK_EVENT = "false_positive_dismissal"
FEEDBACK_SOURCES = ["vscode", "cli"]
FEEDBACK_SCOPES = ["line", "file", "global", "package"]
_FEEDBACK_TYPE = (
    "struct<schemaVersion:string,event:string,source:string,scope:string,ruleFingerprint:string,findingType:string,"
    "detectionLayer:string,severity:string>"
)


def validate_feedback(events: DataFrame, body: str = "body") -> DataFrame:
    """Parse raw JSON events; ``error`` is null for accepted rows and names the first objection otherwise."""
    keys = F.json_object_keys(body)
    parsed = events.withColumn("_e", F.from_json(body, _FEEDBACK_TYPE)).withColumn("_keys", keys)
    e = F.col("_e")
    known = lambda field, allowed: ~F.array_contains("_keys", field) | F.coalesce(e[field].isin(allowed), F.lit(False))
    has = lambda cond: F.coalesce(cond, F.lit(False))
    error = (
        F.when(F.col("_keys").isNull(), "not_an_object")
        .when(F.size(F.array_except("_keys", F.array(*[F.lit(f) for f in FEEDBACK_FIELDS]))) > 0, "unsupported_fields")
        .when(~has((F.get_json_object(body, "$.schemaVersion") == "1") & (e["event"] == FEEDBACK_EVENT)), "unsupported_schema")
        .when(~has(e["source"].isin(FEEDBACK_SOURCES) & e["scope"].isin(FEEDBACK_SCOPES)), "invalid_source_or_scope")
        .when(~has(e["ruleFingerprint"].rlike("^[a-f0-9]{24}\\z")), "invalid_fingerprint")
        .when(~known("findingType", schema.FINDING_TYPES), "invalid_finding_type")
        .when(~known("detectionLayer", schema.LAYERS), "invalid_layer")
        .when(~known("severity", schema.SEVERITIES), "invalid_severity")
    )
    return parsed.withColumn("error", error).select(
        *events.columns,
        e["source"].alias("source"),
        e["scope"].alias("scope"),
        e["ruleFingerprint"].alias("rule_fingerprint"),
        F.coalesce(e["findingType"], F.lit("")).alias("finding_type"),
        F.coalesce(e["detectionLayer"], F.lit("")).alias("detection_layer"),
        F.coalesce(e["severity"], F.lit("")).alias("severity"),
        "error",
    )


def feedback_event(findings: DataFrame, source: str, scope: str) -> DataFrame:
    """Anonymous event for each dismissal as a false positive: no path, package, author, id or free text."""
    reported = findings.filter(F.col("dismissed") & is_false_positive_event(F.col("dismissed_reason")))
    return reported.select(
        F.lit(1).alias("schemaVersion"),
        F.lit(FEEDBACK_EVENT).alias("event"),
        F.lit(source).alias("source"),
        F.lit(scope).alias("scope"),
        rule_fingerprint(F.col("detection_rule")).alias("ruleFingerprint"),
        F.col("type").alias("findingType"),
        F.col("detection_layer").alias("detectionLayer"),
        "severity",
    )


BUCKET_KEYS = ["day", "rule_fingerprint", "source", "scope", "finding_type", "detection_layer", "severity"]


def feedback_buckets(events: DataFrame) -> DataFrame:
    """Counts per UTC day and attributes of accepted events (``received_at`` in milliseconds)."""
    return (
        events.withColumn("day", utc_day(F.col("received_at")).cast("string"))
        .groupBy(*BUCKET_KEYS)
        .agg(
            F.count("*").alias("event_count"),
            F.min("received_at").alias("first_received_at"),
            F.max("received_at").alias("last_received_at"),
        )
    )


def merge_buckets(current: DataFrame, new: DataFrame) -> DataFrame:
    return (
        current.unionByName(new)
        .groupBy(*BUCKET_KEYS)
        .agg(
            F.sum("event_count").alias("event_count"),
            F.min("first_received_at").alias("first_received_at"),
            F.max("last_received_at").alias("last_received_at"),
        )
    )
