"""Scan payloads posted by other tools: validation into run, finding and quarantine tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema

# Limits of one payload. The schema tag is configurable.
SCHEMA_TAG = "findings.v1"
MAX_FINDINGS, MAX_TARGET_PATHS, MAX_FILES, MAX_POSITION = 10_000, 1_000, 1_000_000, 10_000_000
MAX_TIME = 8_640_000_000_000_000

_FINDING = (
    "struct<id:string,type:string,severity:string,message:string,file:string,line:double,column:double,endLine:double,"
    f"endColumn:double,evidence:string,suggestion:string,fix:{schema.FIX},detection_layer:string,detection_rule:string,"
    "timestamp:double,dismissed:boolean,dismissed_reason:string>"
)
_PAYLOAD = (
    "struct<schema:string,scan:struct<scanId:string,startedAt:double,completedAt:double,project:string,cwd:string,"
    f"targetPaths:array<string>,fileCount:double,findings:array<{_FINDING}>,"
    "findingAuthors:map<string,struct<name:string,email:string>>>>"
)


def _text(value: Column, limit: int) -> Column:
    return F.coalesce(F.length(value).between(1, limit), F.lit(False))


def _optional(value: Column, limit: int) -> Column:
    return value.isNull() | _text(value, limit)


def _whole(value: Column, low: int, high: int) -> Column:
    return F.coalesce((value == F.floor(value)) & value.between(low, high), F.lit(False))


def _time(value: Column) -> Column:
    return F.coalesce(value.between(0, MAX_TIME), F.lit(False))


def _finding_ok(f: Column) -> Column:
    edits = f["fix"]["edits"]
    edit_ok = lambda e: (
        e["startLine"].between(1, MAX_POSITION) & e["startColumn"].between(1, MAX_POSITION)
        & e["endLine"].between(1, MAX_POSITION) & e["endColumn"].between(1, MAX_POSITION) & _text(e["newText"], 16_384)
    )
    fix_ok = f["fix"].isNull() | (
        _text(f["fix"]["description"], 4096) & F.coalesce(F.size(edits) <= 100, F.lit(False)) & F.coalesce(F.forall(edits, edit_ok), F.lit(False))
    )
    position = lambda v: _whole(v, 1, MAX_POSITION)
    return (
        _text(f["id"], 200) & F.coalesce(f["type"].isin(schema.FINDING_TYPES), F.lit(False))
        & F.coalesce(f["severity"].isin(schema.SEVERITIES), F.lit(False)) & _text(f["message"], 4096) & _text(f["file"], 4096)
        & position(f["line"]) & position(f["column"]) & (f["endLine"].isNull() | position(f["endLine"]))
        & (f["endColumn"].isNull() | position(f["endColumn"])) & _text(f["evidence"], 16_384) & _optional(f["suggestion"], 4096)
        & F.coalesce(f["detection_layer"].isin(schema.LAYERS), F.lit(False)) & _text(f["detection_rule"], 200) & _time(f["timestamp"])
        & f["dismissed"].isNotNull() & _optional(f["dismissed_reason"], 4096) & fix_ok
    )


def validate_payloads(payloads: DataFrame, tag: str = SCHEMA_TAG) -> DataFrame:
    """Parse ``(payload_id, body[, credential_project])``; ``errors`` lists every objection and is empty when accepted.

    A payload sent with a project-bound credential must name that project.
    """
    rows = payloads if "credential_project" in payloads.columns else payloads.withColumn("credential_project", F.lit(None).cast("string"))
    p = rows.withColumn("p", F.from_json("body", _PAYLOAD))
    s = F.col("p.scan")
    ids = F.transform(s["findings"], lambda f: f["id"])
    authors = s["findingAuthors"]
    author_ok = lambda v: _optional(v["name"], 320) & _optional(v["email"], 320) & (v["name"].isNotNull() | v["email"].isNotNull())
    no = lambda good: ~F.coalesce(good, F.lit(False))
    checks = [
        ("invalid_json", F.col("p").isNull() | s.isNull()),
        ("unsupported_schema", no(F.col("p.schema") == tag)),
        ("invalid_scan_id", no(_optional(s["scanId"], 200))),
        ("invalid_started_at", no(_time(s["startedAt"]))),
        ("invalid_completed_at", no(s["completedAt"].isNull() | (_time(s["completedAt"]) & (s["completedAt"] >= s["startedAt"])))),
        ("invalid_project", no(_optional(s["project"], 256))),
        ("invalid_cwd", no(_text(s["cwd"], 4096))),
        ("invalid_target_paths", no(F.forall(s["targetPaths"], lambda t: _text(t, 4096)))),
        ("too_many_target_paths", F.coalesce(F.size(s["targetPaths"]) > MAX_TARGET_PATHS, F.lit(False))),
        ("invalid_file_count", no(_whole(s["fileCount"], 0, MAX_FILES))),
        ("invalid_findings", no(F.forall(s["findings"], _finding_ok))),
        ("too_many_findings", F.coalesce(F.size(s["findings"]) > MAX_FINDINGS, F.lit(False))),
        ("unknown_author_finding", F.coalesce(F.size(F.array_except(F.map_keys(authors), ids)) > 0, F.lit(False))),
        ("invalid_author", authors.isNotNull() & no(F.forall(F.map_values(authors), author_ok))),
        ("project_mismatch", F.col("credential_project").isNotNull() & no(s["project"] == F.col("credential_project"))),
    ]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    return p.withColumn("errors", errors)


def _scan_id() -> Column:
    return F.coalesce(F.col("p.scan")["scanId"], F.concat(F.lit("scan_"), F.col("payload_id").cast("string")))


def claim_scans(checked: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``scan_id, payload_id, body_digest``: of valid payloads, the one that brings each scan; ``known(scan_id)`` are taken.

    Of several payloads of a scan the smallest id wins, then the smallest digest, so the choice does not depend on their order.
    """
    good = checked.filter(F.size("errors") == 0).select(_scan_id().alias("scan_id"), F.struct("payload_id", F.sha2("body", 256).alias("body_digest")).alias("by"))
    first = good.groupBy("scan_id").agg(F.min("by").alias("by")).select("scan_id", "by.*")
    return first if known is None else first.join(known.select("scan_id"), "scan_id", "left_anti")


def claimed_payloads(checked: DataFrame, claims: DataFrame) -> DataFrame:
    """The valid payloads that hold a claim, one row each, and the others with the error ``duplicate_scan``."""
    marked = checked.withColumn("body_digest", F.sha2("body", 256)).join(
        claims.select("payload_id", "body_digest", F.lit(True).alias("_claimed")), ["payload_id", "body_digest"], "left"
    )
    late = (F.size("errors") == 0) & F.col("_claimed").isNull()
    marked = marked.withColumn("errors", F.when(late, F.array(F.lit("duplicate_scan"))).otherwise(F.col("errors")))
    taken = marked.filter(F.size("errors") == 0).dropDuplicates(["payload_id", "body_digest"])
    return taken.unionByName(marked.filter(F.size("errors") > 0)).drop("body_digest", "_claimed")


def read_ingest(payloads: DataFrame, tag: str = SCHEMA_TAG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(scan_run, finding_result, rejected)`` of landed payloads."""
    return ingested(validate_payloads(payloads, tag))


def ingested(checked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(scan_run, finding_result, rejected)`` of validated payloads."""
    good = checked.filter(F.size("errors") == 0)
    s, scan_id = F.col("p.scan"), _scan_id()
    runs = good.select(
        scan_id.alias("scan_id"), s["startedAt"].cast("bigint").alias("started_at"),
        F.coalesce(s["completedAt"], s["startedAt"]).cast("bigint").alias("completed_at"),
        F.nullif(F.trim(s["project"]), F.lit("")).alias("project"), s["cwd"].alias("cwd"), s["targetPaths"].alias("target_paths"),
        s["fileCount"].cast("int").alias("file_count"),
    )
    each = good.select(scan_id.alias("scan_id"), s["findingAuthors"].alias("authors"), F.explode(s["findings"]).alias("f"))
    author = F.try_element_at("authors", F.col("f.id"))
    findings = each.select(
        "scan_id", F.col("f.id").alias("finding_id"), "f.type", "f.severity", "f.message", F.col("f.file").alias("file_path"),
        F.col("f.line").cast("int").alias("line"), F.col("f.column").cast("int").alias("column"), F.col("f.endLine").cast("int").alias("end_line"),
        F.col("f.endColumn").cast("int").alias("end_column"), "f.evidence", "f.suggestion", "f.fix", "f.detection_layer", "f.detection_rule",
        F.col("f.timestamp").cast("bigint").alias("timestamp"), "f.dismissed", "f.dismissed_reason",
        author["name"].alias("author_name"), author["email"].alias("author_email"),
    )
    return runs, findings, checked.filter(F.size("errors") > 0).select("payload_id", "body", "errors")
