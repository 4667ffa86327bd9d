"""History reports, retention and finding algebra over the history view of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import findings as fo
from ..operators import history as hi
from .registry import ORACLES, query

WITH_H = "WITH " + fx.H_SQL
SINCE = 1_704_844_800_000  # 2024-01-10

FP = """(dismissed AND (
  replace(replace(lower(trim(coalesce(dismissed_reason, ''))), '_', ' '), '-', ' ') = 'false positive'
  OR replace(replace(lower(trim(coalesce(dismissed_reason, ''))), '_', ' '), '-', ' ') LIKE 'false positive %'
  OR replace(replace(lower(trim(coalesce(dismissed_reason, ''))), '_', ' '), '-', ' ') LIKE 'false positive(%'
  OR replace(replace(lower(trim(coalesce(dismissed_reason, ''))), '_', ' '), '-', ' ') LIKE 'false positive:%'))"""
COUNTS = """count(*) AS count, count(*) FILTER (NOT dismissed) AS active_count,
  count(*) FILTER (dismissed) AS dismissed_count"""
HIGH = "count(*) FILTER (NOT dismissed AND severity IN ('critical', 'high'))"
TOTALS = """count(DISTINCT r.scan_id) AS scan_count, count(finding_id) AS finding_count,
  count(*) FILTER (NOT dismissed) AS active_count, count(*) FILTER (dismissed) AS dismissed_count"""


@query("history_stats", f"{WITH_H} SELECT {TOTALS}, max(completed_at) AS latest_scan_at FROM runs r LEFT JOIN f USING (scan_id)")
def _(spark, sf):
    return hi.history_stats(fx.history(spark, sf))


@query(
    "history_stats_scoped",
    f"""{WITH_H} SELECT {TOTALS}, max(completed_at) AS latest_scan_at FROM runs r LEFT JOIN f USING (scan_id)
    WHERE completed_at >= {SINCE} AND project = 'p2'""",
)
def _(spark, sf):
    return hi.history_stats(fx.history(spark, sf), since=SINCE, project="p2")


@query("severity_counts", f"{WITH_H} SELECT severity AS key, {COUNTS} FROM f GROUP BY severity")
def _(spark, sf):
    return hi.severity_counts(fx.history(spark, sf))


@query(
    "type_counts",
    f"{WITH_H} SELECT type AS key, {COUNTS} FROM f JOIN runs USING (scan_id) WHERE completed_at >= {SINCE} GROUP BY type",
)
def _(spark, sf):
    return hi.type_counts(fx.history(spark, sf), since=SINCE)


RULES = f"""SELECT detection_rule AS key, type, severity, {COUNTS}, count(*) FILTER ({FP}) AS false_positive_count,
  count(*) FILTER ({FP}) / count(*)::DOUBLE AS false_positive_rate FROM f GROUP BY detection_rule, type, severity"""


@query(
    "top_rules",
    f"{WITH_H} {RULES} ORDER BY count DESC, active_count DESC, key, type, severity LIMIT 10",
)
def top_rules(spark, sf):
    return hi.top_rules(fx.history(spark, sf))


@query(
    "false_positive_rules",
    f"""{WITH_H} SELECT * FROM ({RULES}) WHERE false_positive_count > 0
    ORDER BY false_positive_rate DESC, false_positive_count DESC, count DESC, key, type, severity LIMIT 10""",
)
def _(spark, sf):
    return hi.false_positive_rules(fx.history(spark, sf))


@query(
    "dismissal_reasons",
    f"""{WITH_H} SELECT coalesce(nullif(trim(dismissed_reason), ''), 'unspecified') AS key, count(*) AS count,
    0::BIGINT AS active_count, count(*) AS dismissed_count FROM f WHERE dismissed GROUP BY 1""",
)
def _(spark, sf):
    return hi.dismissal_reasons(fx.history(spark, sf))


AUTHOR = "coalesce(nullif(lower(trim(author_email)), ''), nullif(trim(author_name), ''), 'unknown')"


@query(
    "author_risk",
    f"""{WITH_H} SELECT {AUTHOR} AS key, max(nullif(trim(author_name), '')) AS name, max(nullif(trim(author_email), '')) AS email,
    {COUNTS}, {HIGH} AS high_risk_count,
    CASE WHEN count(*) FILTER (NOT dismissed) = 0 THEN 0.0 ELSE {HIGH} / (count(*) FILTER (NOT dismissed))::DOUBLE END AS high_risk_rate
    FROM f GROUP BY 1 ORDER BY high_risk_count DESC, active_count DESC, count DESC, key LIMIT 10""",
)
def _(spark, sf):
    return hi.author_risk(fx.history(spark, sf))


@query(
    "project_risk",
    f"""{WITH_H} SELECT coalesce(nullif(trim(project), ''), 'Unassigned') AS key, {TOTALS}, {HIGH} AS high_risk_count,
    CASE WHEN count(*) FILTER (NOT dismissed) = 0 THEN 0.0 ELSE {HIGH} / (count(*) FILTER (NOT dismissed))::DOUBLE END AS high_risk_rate
    FROM runs r LEFT JOIN f USING (scan_id) GROUP BY 1
    ORDER BY high_risk_count DESC, active_count DESC, finding_count DESC, key LIMIT 10""",
)
def _(spark, sf):
    return hi.project_risk(fx.history(spark, sf))


@query(
    "daily_trend",
    f"""{WITH_H} SELECT CAST(make_timestamp(completed_at * 1000) AS DATE) AS date, {TOTALS}
    FROM runs r LEFT JOIN f USING (scan_id) GROUP BY 1""",
)
def _(spark, sf):
    return hi.daily_trend(fx.history(spark, sf))


DELTA = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY completed_at, scan_id) AS n FROM runs {where}
),
pairs AS (
  SELECT c.project, p.scan_id AS previous_scan_id, c.scan_id AS current_scan_id, c.completed_at AS current_completed_at
  FROM numbered c JOIN numbered p ON c.n = p.n + 1 {same}
),
act AS (SELECT scan_id, finding_id FROM f WHERE NOT dismissed)
SELECT {project} previous_scan_id, current_scan_id, current_completed_at,
  (SELECT count(*) FROM act a WHERE a.scan_id = current_scan_id AND a.finding_id NOT IN
     (SELECT finding_id FROM act b WHERE b.scan_id = previous_scan_id)) AS introduced_count,
  (SELECT count(*) FROM act a WHERE a.scan_id = previous_scan_id AND a.finding_id NOT IN
     (SELECT finding_id FROM act b WHERE b.scan_id = current_scan_id)) AS resolved_count,
  (SELECT count(*) FROM act a WHERE a.scan_id = current_scan_id AND a.finding_id IN
     (SELECT finding_id FROM act b WHERE b.scan_id = previous_scan_id)) AS persistent_count
FROM pairs"""


@query(
    "scan_delta",
    WITH_H + ",\n" + DELTA.format(part="coalesce(project, '')", where="", same="AND c.project IS NOT DISTINCT FROM p.project", project="project,"),
)
def _(spark, sf):
    return hi.scan_delta(fx.history(spark, sf))


@query(
    "latest_scan_delta",
    WITH_H + ",\n" + DELTA.format(
        part="1", where="WHERE completed_at < 1706659200000 AND project = 'p1'", same="", project=""
    ) + " ORDER BY current_completed_at DESC, current_scan_id DESC LIMIT 1",
)
def _(spark, sf):
    h = fx.history(spark, sf)
    h = hi.History(h.runs.filter("completed_at < 1706659200000"), h.findings)
    return hi.latest_scan_delta(h, project="p1")


TYPE_LIST = ", ".join(f"'{t}'" for t in hi.schema.FINDING_TYPES)
CONTROL_ROWS = ", ".join(
    f"('{fw}', '{cid}', '{title}', [{', '.join(repr(t) for t in (types or hi.schema.FINDING_TYPES))}])"
    for fw, cid, title, types in hi.CONTROLS
)


@query(
    "compliance_controls",
    f"""{WITH_H}, c(framework, control, title, types) AS (VALUES {CONTROL_ROWS})
    SELECT framework, control, title, active_finding_count,
      CASE WHEN (SELECT count(*) FROM runs) = 0 THEN 'not_assessed' WHEN active_finding_count > 0 THEN 'attention' ELSE 'observed' END AS status
    FROM (SELECT framework, control, title,
            (SELECT count(*) FROM f WHERE NOT dismissed AND list_contains(c.types, f.type)) AS active_finding_count FROM c)""",
)
def _(spark, sf):
    return hi.compliance_controls(fx.history(spark, sf))


AUDIT_SQL = f"""WITH {fx.E_SQL}, a AS (
  SELECT 'audit_' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, ms AS occurred_at, event_type AS action,
         CASE WHEN k < 10 THEN 'denied' ELSE 'success' END AS outcome, props AS details, user_id FROM e)"""


def audit(spark, sf):
    return fx.events(spark, sf).select(
        F.concat(F.lit("audit_"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("event_id"),
        F.col("ms").alias("occurred_at"),
        F.col("event_type").alias("action"),
        F.when(F.col("k") < 10, "denied").otherwise("success").alias("outcome"),
        F.col("props").alias("details"),
        "user_id",
    )


@query("audit_activity", f"{AUDIT_SQL} SELECT action, outcome, count(*) AS count FROM a GROUP BY ALL")
def _(spark, sf):
    return hi.audit_activity(audit(spark, sf))


_DELTA_ALL = WITH_H + ",\n" + DELTA.format(part="1", where="", same="", project="") + " ORDER BY current_completed_at DESC, current_scan_id DESC LIMIT 1"
_LISTED = [
    ("finding_count", "''", "finding_count", ORACLES["history_stats"]),
    ("introduced", "current_scan_id", "introduced_count", _DELTA_ALL),
    ("resolved", "current_scan_id", "resolved_count", _DELTA_ALL),
    ("reason", "key", "dismissed_count", ORACLES["dismissal_reasons"]),
    ("rule", "key", "count", ORACLES["top_rules"]),
    ("activity", "action || '|' || outcome", "count", ORACLES["audit_activity"]),
    ("control", "framework || '|' || control || '|' || status", "active_finding_count", ORACLES["compliance_controls"]),
]


@query(
    "compliance_report",
    " UNION ALL ".join(f"SELECT '{name}' AS section, {key} AS key, CAST({value} AS BIGINT) AS value FROM ({sql})" for name, key, value, sql in _LISTED),
)
def _(spark, sf):
    """The report's lists as rows."""
    report = hi.compliance_report(fx.history(spark, sf), audit(spark, sf), 1_710_000_000_000)

    def entry(section, key, value):
        return F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("bigint").alias("value"))

    lists = [
        F.array(entry("finding_count", F.lit(""), F.col("finding_count"))),
        F.transform("latest_scan_delta", lambda x: entry("introduced", x["current_scan_id"], x["introduced_count"])),
        F.transform("latest_scan_delta", lambda x: entry("resolved", x["current_scan_id"], x["resolved_count"])),
        F.transform("dismissal_reasons", lambda x: entry("reason", x["reason"], x["count"])),
        F.transform("top_rules", lambda x: entry("rule", x["key"], x["count"])),
        F.transform("activity", lambda x: entry("activity", F.concat_ws("|", x["action"], x["outcome"]), x["count"])),
        F.transform("controls", lambda x: entry("control", F.concat_ws("|", x["framework"], x["control"], x["status"]), x["active_finding_count"])),
    ]
    return report.select(F.explode(F.concat(*lists)).alias("e")).select("e.*")


@query(
    "risk_posture",
    f"""{WITH_H} SELECT key, critical, high, active,
      CASE WHEN critical > 0 THEN 'Critical' WHEN high > 0 THEN 'High' WHEN active > 0 THEN 'Watch' ELSE 'Clear' END AS posture
    FROM (SELECT coalesce(nullif(trim(project), ''), 'Unassigned') AS key,
      count(*) FILTER (NOT dismissed AND severity = 'critical') AS critical,
      count(*) FILTER (NOT dismissed AND severity = 'high') AS high, count(*) FILTER (NOT dismissed) AS active
    FROM runs LEFT JOIN f USING (scan_id) GROUP BY 1)""",
)
def _(spark, sf):
    return hi.risk_posture(fx.history(spark, sf), per_project=True)


PERF_SQL = f"""WITH {fx.E_SQL}, p AS (
  SELECT 'u' || user_id || '/e' || event_id AS file, k + 1 AS line_count, value AS l1_ms,
         CASE WHEN event_id % 2 = 0 THEN value * 8 END AS l2_ms, CASE WHEN event_id % 5 = 0 THEN value * 16 END AS l3_ms FROM e),
q AS (SELECT *, l1_ms + coalesce(l2_ms, 0) + coalesce(l3_ms, 0) AS total_ms, greatest(50, 50 * line_count)::DOUBLE AS b1 FROM p)"""


def performance(spark, sf):
    rows = fx.events(spark, sf).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/e"), F.col("event_id").cast("string")).alias("file"),
        (F.col("k") + 1).alias("line_count"),
        F.col("value").alias("l1_ms"),
        F.when(F.col("event_id") % 2 == 0, F.col("value") * 8).alias("l2_ms"),
        F.when(F.col("event_id") % 5 == 0, F.col("value") * 16).alias("l3_ms"),
    )
    zero = F.lit(0.0)
    return rows.withColumn("total_ms", F.col("l1_ms") + F.coalesce("l2_ms", zero) + F.coalesce("l3_ms", zero))


@query(
    "scan_performance_summary",
    f"""{PERF_SQL} SELECT count(*) AS file_count, round(sum(total_ms), 3) AS total_ms, round(sum(total_ms) / count(*), 3) AS average_ms,
      round(sum(l1_ms), 3) AS l1_ms, round(sum(l2_ms), 3) AS l2_ms, round(sum(l3_ms), 3) AS l3_ms,
      (SELECT file FROM q ORDER BY total_ms DESC, file DESC LIMIT 1) AS slowest_file, max(total_ms) AS slowest_ms,
      count(*) FILTER (l1_ms > b1) + count(*) FILTER (l2_ms > 2000) + count(*) FILTER (l3_ms > 5000) AS budget_exceeded_count FROM q""",
)
def _(spark, sf):
    out = hi.scan_performance_summary(performance(spark, sf))
    sums = ["total_ms", "average_ms", "l1_ms", "l2_ms", "l3_ms"]
    return out.select(*[F.round(c, 3).alias(c) if c in sums else F.col(c) for c in out.columns])


@query(
    "budget_warnings",
    f"""{PERF_SQL} SELECT file, 'L1' AS layer, l1_ms AS elapsed_ms, b1 AS budget_ms FROM q WHERE l1_ms > b1
    UNION ALL SELECT file, 'L2', l2_ms, 2000.0 FROM q WHERE l2_ms > 2000
    UNION ALL SELECT file, 'L3', l3_ms, 5000.0 FROM q WHERE l3_ms > 5000""",
)
def _(spark, sf):
    return hi.budget_warnings(performance(spark, sf))


@query(
    "active_severity_counts",
    f"""{WITH_H} SELECT s.severity, count(finding_id) AS active_count
    FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) s(severity)
    LEFT JOIN f ON f.severity = s.severity AND NOT f.dismissed GROUP BY s.severity""",
)
def _(spark, sf):
    return hi.active_severity_counts(fx.history(spark, sf))


_SECTION = lambda name, key, where="TRUE", type="NULL", severity="NULL": f"""SELECT '{name}' AS section, {key} AS key, {type} AS type,
  {severity} AS severity, {COUNTS}, count(*) FILTER ({FP}) AS false_positive_count, {HIGH} AS high_risk_count
  FROM f JOIN runs USING (scan_id) WHERE {where} GROUP BY 2, 3, 4"""


@query(
    "full_summary",
    WITH_H + """ SELECT *, CAST(row_number() OVER (PARTITION BY section ORDER BY count DESC, active_count DESC, key,
      type NULLS FIRST, severity NULLS FIRST) AS INT) AS position FROM (""" + " UNION ALL ".join([
        _SECTION("total", "'all'"), _SECTION("project", "coalesce(nullif(trim(project), ''), 'Unassigned')"),
        _SECTION("day", "CAST(CAST(make_timestamp(completed_at * 1000) AS DATE) AS VARCHAR)"),
        _SECTION("severity", "severity"), _SECTION("type", "type"), _SECTION("rule", "detection_rule", type="type", severity="severity"),
        _SECTION("reason", "coalesce(nullif(trim(dismissed_reason), ''), 'unspecified')", "dismissed"),
        _SECTION("author", AUTHOR)]) + ")",
)
def _(spark, sf):
    return hi.full_summary(fx.history(spark, sf))


WITH_FV = "WITH " + fx.FINDINGS_SQL


@query(
    "unique_findings",
    f"""{WITH_FV} SELECT id, detection_rule, file, line, "column" FROM (
      SELECT *, row_number() OVER (PARTITION BY detection_rule, file, line, "column" ORDER BY "timestamp", id) AS rn FROM fv) WHERE rn = 1""",
)
def _(spark, sf):
    view = fx.findings_view(fx.history(spark, sf))
    return fo.unique_findings(view, ["timestamp", "id"]).select("id", *fo.POSITION)


@query(
    "rank_findings",
    f"""{WITH_FV} SELECT id, severity, file, line, "column", detection_rule FROM fv
    ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END,
      file, line, "column", detection_rule""",
)
def _(spark, sf):
    view = fx.findings_view(fx.history(spark, sf))
    return fo.rank_findings(view).select("id", "severity", "file", "line", "column", "detection_rule")


IGNORE_RULES = [
    {"rule": "rule_click_0", "path": "src/f1?.py", "reason": "Reviewed"},
    {"rules": ["hardcoded_secret", "rule_view_1"], "path": "**/f[2-4].py"},
    {"line": 7, "scope": "file:SRC/F5.PY", "reason": "One line"},
    {"rule": "rule_purchase_2", "path": "{f6,f7}.py", "reason": "Two files"},
    {"package": "left_pad", "registry": "npm", "reason": "Internal package"},
]


@query(
    "apply_ignore_rules",
    f"""{WITH_FV}, m AS (SELECT *, CASE
      WHEN detection_rule = 'rule_click_0' AND regexp_full_match(file, 'src/f1[0-9].py') THEN 'Reviewed'
      WHEN (type = 'hardcoded_secret' OR detection_rule IN ('hardcoded_secret', 'rule_view_1')) AND regexp_full_match(file, 'src/f[2-4].py')
        THEN 'Matched ignore-rules.yml'
      WHEN line = 7 AND file = 'src/f5.py' THEN 'One line'
      WHEN detection_rule = 'rule_purchase_2' AND file IN ('src/f6.py', 'src/f7.py') THEN 'Two files' END AS why FROM fv)
    SELECT id, dismissed OR why IS NOT NULL AS dismissed, coalesce(why, dismissed_reason) AS dismissed_reason FROM m""",
)
def _(spark, sf):
    view = fx.findings_view(fx.history(spark, sf))
    return fo.apply_ignore_rules(view, IGNORE_RULES).select("id", "dismissed", "dismissed_reason")


@query(
    "apply_ignored_ids",
    f"""{WITH_FV}, ids AS (SELECT DISTINCT scan_id || ':' || finding_id AS id FROM f WHERE user_id % 7 = 0)
    SELECT fv.id, dismissed OR ids.id IS NOT NULL AS dismissed,
      CASE WHEN ids.id IS NOT NULL AND NOT dismissed THEN 'Matched config.ignored_findings' ELSE dismissed_reason END AS dismissed_reason
    FROM fv LEFT JOIN ids USING (id)""",
)
def _(spark, sf):
    h = fx.history(spark, sf)
    user = F.element_at(F.split("finding_id", "_"), -1).cast("bigint")
    ids = h.findings.filter(user % 7 == 0).select(F.concat_ws(":", "scan_id", "finding_id").alias("id"))
    return fo.apply_ignored_ids(fx.findings_view(h), ids).select("id", "dismissed", "dismissed_reason")


@query(
    "merge_layers",
    f"""{WITH_FV}, both_ AS (
      SELECT *, 0 AS s FROM fv WHERE detection_layer <> 'L2' AND "timestamp" < {SINCE}
      UNION ALL SELECT *, 1 AS s FROM fv WHERE "timestamp" >= {SINCE})
    SELECT id, detection_layer, detection_rule, file, line, "column" FROM (SELECT *, row_number() OVER (
      PARTITION BY detection_rule, file, line, "column" ORDER BY s, id) AS rn FROM both_) WHERE rn = 1""",
)
def _(spark, sf):
    view = fx.findings_view(fx.history(spark, sf))
    old, new = view.filter(F.col("timestamp") < SINCE), view.filter(F.col("timestamp") >= SINCE)
    return fo.merge_layers(old, new, ["L2"]).select("id", "detection_layer", *fo.POSITION)


@query(
    "gate",
    f"""{WITH_FV} SELECT scan_id, coalesce(bool_or(NOT dismissed AND severity IN ('critical', 'high')), FALSE) AS failed,
    count(*) FILTER (NOT dismissed AND severity IN ('critical', 'high')) AS failing_count FROM fv GROUP BY scan_id""",
)
def _(spark, sf):
    return fo.gate(fx.findings_view(fx.history(spark, sf)), "high", by=["scan_id"])


COMMITS_SQL = """commits AS (SELECT 'src/f' || (user_id % 20) || '.py' AS file, ms AS committed_at,
  'h' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS hash, CASE WHEN k % 9 = 0 THEN ' ' ELSE 'Dev ' || user_id END AS author_name,
  'dev' || user_id || '@example.com' AS author_email FROM e)"""


def commits(spark, sf):
    user = F.col("user_id").cast("string")
    return fx.events(spark, sf).select(
        F.concat(F.lit("src/f"), (F.col("user_id") % 20).cast("string"), F.lit(".py")).alias("file"),
        F.col("ms").alias("committed_at"),
        F.concat(F.lit("h"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("hash"),
        F.when(F.col("k") % 9 == 0, " ").otherwise(F.concat(F.lit("Dev "), user)).alias("author_name"),
        F.concat(F.lit("dev"), user, F.lit("@example.com")).alias("author_email"),
    )


@query(
    "attribute_authors",
    f"""{WITH_FV}, {COMMITS_SQL}, last_ AS (SELECT file, nullif(trim(author_name), '') AS author_name,
      nullif(trim(author_email), '') AS author_email FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY committed_at DESC, hash DESC) AS rn
      FROM commits) WHERE rn = 1)
    SELECT id, file, author_name, author_email FROM fv LEFT JOIN last_ USING (file)""",
)
def _(spark, sf):
    view = fx.findings_view(fx.history(spark, sf))
    out = fo.attribute_authors(view, commits(spark, sf))
    return out.select("id", "file", "author_name", "author_email")


@query(
    "review_comments",
    f"""{WITH_FV}, r AS (SELECT file AS path, end_line AS line, detection_rule AS rule, upper(severity) AS sev, message, suggestion,
        row_number() OVER (ORDER BY "timestamp", id) AS pos FROM fv WHERE NOT dismissed AND file IN ('src/f1.py', 'src/f3.py', 'src/f5.py')),
      fresh AS (SELECT *, row_number() OVER (PARTITION BY path, line, rule ORDER BY pos) AS rn FROM r
        WHERE NOT (path = 'src/f1.py' AND rule = 'rule_click_0' AND line <= 50))
    SELECT path, line, rule, '<!-- inline-finding:' || rule || ' -->' || chr(10) || '**' || sev || '** `' || rule || '`' || chr(10) || chr(10)
      || message || chr(10) || chr(10) || 'Suggested remediation: ' || suggestion AS body
    FROM fresh WHERE rn = 1 ORDER BY pos LIMIT 20""",
)
def _(spark, sf):
    h = fx.history(spark, sf)
    view = fx.findings_view(h).withColumn("position", F.struct("timestamp", "id"))
    changed = spark.createDataFrame([("src/f1.py",), ("src/f3.py",), ("src/f5.py",)], "path string")
    posted = spark.range(1, 51).select(
        F.lit("src\\f1.py").alias("path"), F.col("id").cast("int").alias("line"),
        F.lit("<!-- inline-finding:rule_click_0 -->\nseen").alias("body"),
    )
    return fo.review_comments(view, changed, posted).select("path", "line", "rule", "body")


@query(
    "fingerprint_rules",
    f"{WITH_H} SELECT DISTINCT detection_rule, substr(sha256(trim(detection_rule)), 1, 24) AS rule_fingerprint FROM f",
)
def _(spark, sf):
    f = fx.history(spark, sf).findings
    return f.select("detection_rule", fo.rule_fingerprint(F.col("detection_rule")).alias("rule_fingerprint")).distinct()


@query(
    "false_positive_reasons",
    f"""{WITH_H} SELECT scan_id, finding_id, coalesce({FP}, FALSE) AS counted,
      regexp_matches(trim(coalesce(dismissed_reason, '')), '(?i)^false[\\s_-]*positive($|[\\s(:])') AS reported FROM f WHERE dismissed""",
)
def _(spark, sf):
    f = fx.history(spark, sf).findings.filter("dismissed")
    reason = F.col("dismissed_reason")
    return f.select("scan_id", "finding_id", fo.is_false_positive(reason).alias("counted"), fo.is_false_positive_event(reason).alias("reported"))


@query(
    "normalize_ignore_reasons",
    f"""{WITH_H}, n AS (SELECT scan_id, finding_id, trim(coalesce(dismissed_reason, 'not-ISSUE')) AS v FROM f),
    m AS (SELECT scan_id, finding_id, CASE WHEN v = '' THEN NULL
       WHEN regexp_replace(lower(v), '[\\s-]+', '_', 'g') = 'false_positive' THEN 'False positive'
       WHEN regexp_replace(lower(v), '[\\s-]+', '_', 'g') = 'not_issue' OR lower(v) = 'not an issue' THEN 'Not an issue'
       WHEN regexp_replace(lower(v), '[\\s-]+', '_', 'g') = 'internal_package' THEN 'Internal package' ELSE v END AS reason FROM n)
    SELECT scan_id, finding_id, reason, reason || ' (global rule ignore)' AS scoped FROM m""",
)
def _(spark, sf):
    f = fx.history(spark, sf).findings.withColumn("r", F.coalesce("dismissed_reason", F.lit("not-ISSUE")))
    return f.select(
        "scan_id",
        "finding_id",
        fo.normalize_ignore_reason(F.col("r")).alias("reason"),
        fo.scoped_ignore_reason(F.col("r"), "global").alias("scoped"),
    )
