"""Store listings, retention, audit and feedback queries, and line-range algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import history as hi
from ..operators import intervals as iv
from ..operators import retention as re_
from ..sources import history_store as hs
from ..sources import sarif
from .history_queries import AUDIT_SQL, SINCE, WITH_FV, WITH_H, audit
from .registry import query

AUDIT_CTE = "a AS" + AUDIT_SQL.split(", a AS", 1)[1]
PER_SCAN = """p AS (SELECT r.scan_id, project, started_at, completed_at, file_count, count(finding_id) AS finding_count,
  count(*) FILTER (NOT dismissed) AS active_count, count(*) FILTER (dismissed) AS dismissed_count
  FROM runs r LEFT JOIN f USING (scan_id) GROUP BY ALL)"""
RUN_COLUMNS = ["scan_id", "project", "started_at", "completed_at", "file_count", "finding_count", "active_count", "dismissed_count"]


@query("run_report", f"{WITH_H}, {PER_SCAN} SELECT * FROM p")
def _(spark, sf):
    return hs.run_report(fx.history(spark, sf)).select(RUN_COLUMNS)


@query(
    "list_findings",
    f"""{WITH_H} SELECT scan_id, finding_id, file_path, line, "column", completed_at AS scan_completed_at, project
    FROM f JOIN runs USING (scan_id) WHERE NOT dismissed
    ORDER BY completed_at DESC, file_path, line, "column", scan_id, finding_id LIMIT 200""",
)
def _(spark, sf):
    out = hs.list_findings(fx.history(spark, sf), limit=200)
    return out.select("scan_id", "finding_id", "file_path", "line", "column", "scan_completed_at", "project")


@query("list_scan_runs", f"{WITH_H}, {PER_SCAN} SELECT * FROM p WHERE project = 'p3' ORDER BY completed_at DESC, scan_id DESC LIMIT 20")
def _(spark, sf):
    return hs.list_scan_runs(fx.history(spark, sf), project="p3").select(RUN_COLUMNS)


@query(
    "list_audit_events",
    f"{AUDIT_SQL} SELECT event_id, occurred_at, action, outcome FROM a WHERE occurred_at >= {SINCE} ORDER BY occurred_at DESC, event_id DESC LIMIT 300",
)
def _(spark, sf):
    return hs.list_audit_events(audit(spark, sf), since=SINCE, limit=300).select("event_id", "occurred_at", "action", "outcome")


@query(
    "to_sarif",
    f"""{WITH_FV}, act AS (SELECT * FROM fv WHERE NOT dismissed)
    SELECT scan_id, count(*) AS result_count, count(DISTINCT detection_rule) AS rules,
      arg_min(detection_rule, lpad(CAST(line AS VARCHAR), 9, '0') || id) AS first_rule,
      arg_min(CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'info' THEN 'note' ELSE 'warning' END,
        lpad(CAST(line AS VARCHAR), 9, '0') || id) AS first_level
    FROM act GROUP BY scan_id""",
)
def _(spark, sf):
    docs = sarif.to_sarif(fx.findings_view(fx.history(spark, sf)), ["scan_id"], ["line", "id"])
    at = lambda path: F.get_json_object("sarif", path)
    return docs.select(
        "scan_id",
        F.col("result_count").cast("bigint").alias("result_count"),
        F.json_array_length(at("$.runs[0].tool.driver.rules")).cast("bigint").alias("rules"),
        at("$.runs[0].results[0].ruleId").alias("first_rule"),
        at("$.runs[0].results[0].level").alias("first_level"),
    )


FEEDBACK_SQL = """fb AS (
  SELECT substr(sha256('rule_' || event_type || '_' || (user_id % 3)), 1, 24) AS rule_fingerprint,
    CASE WHEN k % 2 = 0 THEN 'vscode' ELSE 'cli' END AS source,
    CASE k % 4 WHEN 0 THEN 'line' WHEN 1 THEN 'file' WHEN 2 THEN 'global' ELSE 'package' END AS scope,
    CASE WHEN k % 10 = 0 THEN '' ELSE CASE event_type WHEN 'error' THEN 'hardcoded_secret' WHEN 'purchase' THEN 'sql_injection'
      WHEN 'click' THEN 'xss' WHEN 'view' THEN 'insecure_config' ELSE 'missing_security_measure' END END AS finding_type,
    CASE WHEN k % 10 = 0 THEN '' ELSE ['L1', 'L2', 'L3'][user_id % 3 + 1] END AS detection_layer,
    CASE WHEN k % 10 = 0 THEN '' ELSE CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high'
      WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' ELSE 'info' END END AS severity,
    ms AS received_at FROM e),
buckets AS (SELECT CAST(CAST(make_timestamp(received_at * 1000) AS DATE) AS VARCHAR) AS day, rule_fingerprint, source, scope, finding_type,
  detection_layer, severity, count(*) AS event_count, min(received_at) AS first_received_at, max(received_at) AS last_received_at
  FROM fb GROUP BY ALL)"""
WITH_FB = f"WITH {fx.E_SQL}, {FEEDBACK_SQL}"


def feedback(spark, sf):
    """Accepted feedback events derived from the event table."""
    e = fx.events(spark, sf)
    k, user = F.col("k"), F.col("user_id")
    some = lambda c: F.when(k % 10 == 0, "").otherwise(c)
    rule = F.concat(F.lit("rule_"), F.col("event_type"), F.lit("_"), (user % 3).cast("string"))
    return e.select(
        hi.rule_fingerprint(rule).alias("rule_fingerprint"),
        F.when(k % 2 == 0, "vscode").otherwise("cli").alias("source"),
        fx._pick(k % 4, (0, "line"), (1, "file"), (2, "global"), (3, "package")).alias("scope"),
        some(fx._pick(F.col("event_type"), *fx.TYPE)).alias("finding_type"),
        some(fx._pick(user % 3, (0, "L1"), (1, "L2"), (2, "L3"))).alias("detection_layer"),
        some(fx._pick(F.col("event_type"), *fx.SEVERITY)).alias("severity"),
        F.col("ms").alias("received_at"),
    )


@query("feedback_buckets", f"{WITH_FB} SELECT * FROM buckets")
def _(spark, sf):
    return re_.feedback_buckets(feedback(spark, sf))


FEEDBACK_SUMMARY = """SELECT rule_fingerprint, CAST(sum(event_count) AS BIGINT) AS event_count,
  array_to_string(list_sort(list_distinct(list(source))), ',') AS sources,
  array_to_string(list_sort(list_distinct(list(scope))), ',') AS scopes,
  max(nullif(finding_type, '')) AS finding_type, max(nullif(detection_layer, '')) AS detection_layer,
  max(nullif(severity, '')) AS severity, min(first_received_at) AS first_received_at, max(last_received_at) AS last_received_at
  FROM buckets {where} GROUP BY rule_fingerprint
  ORDER BY event_count DESC, last_received_at DESC, rule_fingerprint LIMIT 10"""


@query("feedback_summary", f"{WITH_FB} {FEEDBACK_SUMMARY.format(where=f'WHERE last_received_at >= {SINCE}')}")
def _(spark, sf):
    return hi.feedback_summary(re_.feedback_buckets(feedback(spark, sf)), since=SINCE)


@query(
    "match_fingerprints",
    f"""WITH {fx.H_SQL}, {FEEDBACK_SQL}, s AS ({FEEDBACK_SUMMARY.format(where='')}),
    known AS (SELECT substr(sha256(trim(detection_rule)), 1, 24) AS rule_fingerprint, max(detection_rule) AS matched_rule
      FROM (SELECT DISTINCT detection_rule FROM f WHERE user_id % 3 <> 1) GROUP BY 1 HAVING count(*) = 1)
    SELECT rule_fingerprint, event_count, matched_rule FROM s LEFT JOIN known USING (rule_fingerprint)""",
)
def _(spark, sf):
    summary = hi.feedback_summary(re_.feedback_buckets(feedback(spark, sf)))
    known = fx.history(spark, sf).findings.filter(~F.col("detection_rule").endswith("_1"))
    return hi.match_fingerprints(summary, known).select("rule_fingerprint", "event_count", "matched_rule")


CUT = 1_705_500_000_000


@query(
    "prune_before",
    f"""WITH {fx.H_SQL}, {FEEDBACK_SQL}, {AUDIT_CTE}
    SELECT (SELECT count(*) FROM runs WHERE completed_at < {CUT}) AS deleted_scans,
      (SELECT count(*) FROM f WHERE scan_id IN (SELECT scan_id FROM runs WHERE completed_at < {CUT})) AS deleted_findings,
      (SELECT count(*) FROM a WHERE occurred_at < {CUT}) AS deleted_audit_events,
      (SELECT count(*) FROM buckets WHERE last_received_at < {CUT}) AS deleted_feedback_buckets""",
)
def _(spark, sf):
    buckets = re_.feedback_buckets(feedback(spark, sf))
    return re_.prune_counts(fx.history(spark, sf), audit(spark, sf), buckets, CUT)


def _json_length(columns: dict[str, str]) -> str:
    """The length of a record as JSON, without its null members."""
    members = ", ".join(f"""CASE WHEN {c} IS NOT NULL THEN '"{n}":' || {v} END""" for n, (c, v) in columns.items())
    return f"length(array_to_string(list_filter([{members}], lambda m: m IS NOT NULL), ',')) + 2"


def _members(names: str, plain: str = "") -> dict[str, tuple[str, str]]:
    """Members as JSON texts; ``plain`` ones are numbers and booleans."""
    quoted = {n: (f'"{n}"', f'CAST(to_json("{n}") AS VARCHAR)') for n in names.split()}
    return quoted | {n: (f'"{n}"', f'CAST("{n}" AS VARCHAR)') for n in plain.split()}


_RUN = _members("scan_id project", "started_at completed_at file_count") | {"cwd": ("true", """'"/work"'"""), "target_paths": ("true", """'["src"]'""")}
_FINDING = _members(
    "scan_id finding_id type severity message file_path evidence suggestion detection_layer detection_rule dismissed_reason author_name author_email",
    "line column timestamp dismissed",
)
_BUCKET_KEY = "day rule_fingerprint source scope finding_type detection_layer severity"
SIZES_SQL = f"""per_run AS (SELECT scan_id, sum({_json_length(_FINDING)}) AS bytes FROM f GROUP BY scan_id),
  sizes AS (
  SELECT 0 AS tier, completed_at AS "at", scan_id AS id, CAST({_json_length(_RUN)} + coalesce(bytes, 0) AS BIGINT) AS bytes FROM runs LEFT JOIN per_run USING (scan_id)
  UNION ALL SELECT 1, occurred_at, event_id, {_json_length(_members("event_id action outcome details", "occurred_at"))} FROM a
  UNION ALL SELECT 2, last_received_at, concat_ws('|', {', '.join(_BUCKET_KEY.split())}),
    {_json_length(_members(_BUCKET_KEY, "event_count first_received_at last_received_at"))} FROM buckets)"""


def record_sizes(spark, sf):
    """Runs with their findings, audit events and feedback buckets, each with its length as JSON."""
    return re_.history_sizes(fx.history(spark, sf), audit(spark, sf).drop("user_id"), re_.feedback_buckets(feedback(spark, sf)))


@query("history_sizes", f"WITH {fx.H_SQL}, {FEEDBACK_SQL}, {AUDIT_CTE}, {SIZES_SQL} SELECT * FROM sizes")
def _(spark, sf):
    return record_sizes(spark, sf)


BUDGET = 1_000_000


@query(
    "prune_to_budget",
    f"""WITH {fx.H_SQL}, {FEEDBACK_SQL}, {AUDIT_CTE}, {SIZES_SQL},
    t AS (SELECT *, id = 'p1_2024-01-02' AS protected, sum(bytes) OVER (
      ORDER BY CASE WHEN id = 'p1_2024-01-02' THEN 0 ELSE 1 END, tier DESC, "at" DESC, id DESC) AS running FROM sizes)
    SELECT tier, "at", id, bytes, CAST(running AS BIGINT) AS running_bytes, protected FROM t WHERE running <= {BUDGET} OR protected""",
)
def _(spark, sf):
    return re_.prune_to_budget(record_sizes(spark, sf), BUDGET, protected="p1_2024-01-02", strict=False)


@query(
    "sanitize_audit",
    f"""{AUDIT_SQL} SELECT event_id, 'user ' || user_id AS subject, substr(action || repeat('x', 130), 1, 120) AS action,
      '{{"city":"line one two","count":"' || user_id || '"}}' AS details FROM a""",
)
def _(spark, sf):
    rows = audit(spark, sf).select(
        "event_id",
        F.concat(F.lit("  user\n"), F.col("user_id").cast("string"), F.lit(" ")).alias("subject"),
        F.concat("action", F.expr("repeat('x', 130)")).alias("action"),
        F.create_map(
            F.lit(" City "), F.lit("line one\rtwo "), F.lit("api_token"), F.lit("x"), F.lit("Count"), F.col("user_id").cast("string"),
            F.expr("repeat('k', 81)"), F.lit("long name"), F.lit("blank"), F.lit("  "),
        ).alias("details"),
    )
    return re_.sanitize_audit(rows).withColumn("details", F.to_json("details"))


@query(
    "validate_feedback",
    f"""{WITH_FB} SELECT CASE WHEN k % 13 = 0 THEN 'unsupported_fields' WHEN k % 11 = 0 THEN 'unsupported_schema' WHEN k % 7 = 0 THEN 'invalid_source_or_scope'
      WHEN k % 5 = 0 THEN 'invalid_fingerprint' WHEN k % 3 = 0 THEN 'invalid_severity' END AS error, count(*) AS n FROM e GROUP BY 1""",
)
def _(spark, sf):
    k = F.col("k")
    event = F.struct(
        F.when(k % 11 == 0, 2).otherwise(1).alias("schemaVersion"),
        F.lit(re_.FEEDBACK_EVENT).alias("event"),
        F.when(k % 7 == 0, "web").otherwise("cli").alias("source"),
        F.lit("file").alias("scope"),
        F.when(k % 5 == 0, "ABC").otherwise(hi.rule_fingerprint(F.col("event_type"))).alias("ruleFingerprint"),
        F.when(k % 3 == 0, "urgent").otherwise("high").alias("severity"),
        F.when(k % 13 == 0, "src/a.py").alias("path"),
    )
    rows = fx.events(spark, sf).select(F.to_json(event).alias("body"))
    return re_.validate_feedback(rows).groupBy("error").agg(F.count("*").alias("n"))


@query(
    "feedback_event",
    f"""{WITH_H} SELECT 1 AS "schemaVersion", 'false_positive_dismissal' AS event, 'cli' AS source, 'file' AS scope,
      substr(sha256(detection_rule), 1, 24) AS "ruleFingerprint", type AS "findingType", detection_layer AS "detectionLayer", severity
    FROM f WHERE dismissed AND dismissed_reason IN ('False positive', 'false_positive: reviewed')""",
)
def _(spark, sf):
    return re_.feedback_event(fx.history(spark, sf).findings, "cli", "file")


@query(
    "merge_ranges",
    f"""WITH {fx.E_SQL}, r0 AS (SELECT 'u' || user_id || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS file, k AS start_line, CAST(k + event_id % 7 AS INT) AS end_line FROM e),
    s AS (SELECT *, max(end_line) OVER (PARTITION BY file ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r0),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS grp FROM s)
    SELECT file, min(start_line) AS start_line, max(end_line) AS end_line FROM g GROUP BY file, grp""",
)
def _(spark, sf):
    day = F.col("ts").cast("date").cast("string")
    r = fx.events(spark, sf).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_"), day).alias("file"),
        F.col("k").alias("start_line"),
        (F.col("k") + F.col("event_id") % 7).cast("int").alias("end_line"),
    )
    return iv.merge_ranges(r)


@query(
    "lines_to_ranges",
    f"""WITH {fx.E_SQL}, l AS (SELECT DISTINCT 'u' || user_id AS file, k AS line FROM e),
    g AS (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS grp FROM l)
    SELECT file, min(line) AS start_line, max(line) AS end_line FROM g GROUP BY file, grp""",
)
def _(spark, sf):
    lines = fx.events(spark, sf).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("k").alias("line"))
    return iv.lines_to_ranges(lines)


@query(
    "filter_to_ranges",
    f"""{WITH_FV}, rr AS (SELECT 'src/f' || (user_id % 20) || '.py' AS file, k * 2 AS start_line, k * 2 + 1 AS end_line FROM e
        WHERE user_id % 20 < 15 AND event_type = 'view' AND k % 9 = 0)
    SELECT id, file, line FROM fv WHERE file NOT IN (SELECT file FROM rr)
      OR EXISTS (SELECT 1 FROM rr WHERE rr.file = fv.file AND rr.start_line <= fv.line AND rr.end_line >= fv.line)""",
)
def _(spark, sf):
    h = fx.history(spark, sf)
    e = fx.events(spark, sf)
    rr = e.filter("user_id % 20 < 15 AND event_type = 'view' AND k % 9 = 0").select(
        F.concat(F.lit("src/f"), (F.col("user_id") % 20).cast("string"), F.lit(".py")).alias("file"),
        (F.col("k") * 2).alias("start_line"),
        (F.col("k") * 2 + 1).alias("end_line"),
    )
    return iv.filter_to_ranges(fx.findings_view(h), rr).select("id", "file", "line")


@query(
    "is_ai_commit",
    """WITH c AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN text || ' Generated by Copilot'
        WHEN conv_id % 3 = 1 THEN 'AI-generated: ' || text ELSE text END AS message,
        CASE WHEN turn % 4 = 1 THEN 'cursor-bot' ELSE 'Dev' END AS name FROM conversations)
    SELECT conv_id, turn, name = 'cursor-bot' AS by_author, conv_id % 3 < 2 AS by_message,
      name = 'cursor-bot' OR conv_id % 3 < 2 AS by_either FROM c""",
)
def _(spark, sf):
    c = fx.table(spark, sf, "conversations")
    conv, text = F.col("conv_id") % 3, F.col("text")
    message = F.when(conv == 0, F.concat(text, F.lit(" Generated by Copilot"))).when(conv == 1, F.concat(F.lit("AI-generated: "), text)).otherwise(text)
    c = c.withColumn("message", message).withColumn("name", F.when(F.col("turn") % 4 == 1, "cursor-bot").otherwise("Dev"))
    mark = lambda mode: iv.is_ai_commit(mode, F.col("name"), F.lit("dev@example.org"), F.col("message"))
    return c.select("conv_id", "turn", mark("author").alias("by_author"), mark("message").alias("by_message"), mark("aggressive").alias("by_either"))


# Diffs, blame lines and commits derived from the event table: one file per user, one hunk per event.
DIFF_SQL = """hunks AS (SELECT DISTINCT 'u' || user_id AS file, k * 3 + 1 AS start_line, CAST(1 + event_id % 4 AS INT) AS n FROM e),
lines AS (SELECT DISTINCT file, start_line + i AS line FROM hunks, range(4) t(i) WHERE i < n)"""


def diffs(spark, sf):
    e = fx.events(spark, sf)
    n = 1 + F.col("event_id") % 4
    count = F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string")))
    hunk = F.concat(F.lit("@@ -1,2 +"), (F.col("k") * 3 + 1).cast("string"), count, F.lit(" @@ fn\n+changed\n"))
    return e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file")).agg(
        F.concat(F.lit("--- a\n+++ b\n"), F.concat_ws("", F.collect_list(hunk))).alias("diff")
    )


@query(
    "parse_hunks",
    f"""WITH {fx.E_SQL}, {DIFF_SQL}, g AS (SELECT file, line, line - row_number() OVER (PARTITION BY file ORDER BY line) AS grp FROM lines)
    SELECT file, CAST(min(line) AS INT) AS start_line, CAST(max(line) AS INT) AS end_line FROM g GROUP BY file, grp""",
)
def _(spark, sf):
    return iv.parse_hunks(diffs(spark, sf))


@query(
    "ai_line_ranges",
    f"""WITH {fx.E_SQL}, {DIFF_SQL}, sized AS (SELECT file, count(*) AS n FROM lines GROUP BY file),
    ai AS (SELECT file, line FROM lines JOIN sized USING (file) WHERE n >= 50 OR line % 5 = 0 OR line % 7 = 0),
    g AS (SELECT file, line, line - row_number() OVER (PARTITION BY file ORDER BY line) AS grp FROM ai)
    SELECT file, CAST(min(line) AS INT) AS start_line, CAST(max(line) AS INT) AS end_line FROM g GROUP BY file, grp""",
)
def _(spark, sf):
    users = fx.events(spark, sf).select("user_id").distinct()
    line = F.col("line")
    blame = users.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.explode(F.sequence(F.lit(1), F.lit(400))).alias("line")).select(
        "file", "line",
        F.concat(F.lit("h"), (line % 7).cast("string")).alias("hash"),
        F.when(line % 5 == 0, "github-actions[bot]").otherwise("Dev").alias("author_name"),
        F.lit("dev@example.org").alias("author_email"),
    )
    commits = spark.range(7).select(
        F.concat(F.lit("h"), F.col("id").cast("string")).alias("hash"),
        F.when(F.col("id") == 0, "Fix\n\nCo-authored-by: Copilot <x@y>").otherwise("Fix").alias("message"),
    )
    return iv.ai_line_ranges(diffs(spark, sf), blame, commits, "aggressive")
