"""Analytics over the findings history: runs ``scan_run`` and stored findings ``finding_result``.

One run or project may own a large share of all findings. Every report therefore aggregates findings by ``scan_id`` (with
map-side partial aggregation) before it meets the run table, so the join moves one row per run and key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import utc_day
from .findings import is_false_positive, rule_fingerprint
from .ranks import numbered

HIGH_RISK = ["critical", "high"]


@dataclass(frozen=True)
class History:
    runs: DataFrame
    findings: DataFrame

    def scoped(self, since: int | None = None, project: str | None = None) -> "History":
        """Runs completed since a time and of one project; absent arguments add no predicate to the plan."""
        if since is None and project is None:
            return self
        runs = self.runs
        if since is not None:
            runs = runs.filter(F.col("completed_at") >= since)
        if project is not None:
            runs = runs.filter(F.col("project") == project)
        return History(runs, self.findings.join(runs.select("scan_id"), "scan_id", "left_semi"))


def clamp(limit: int | None, default: int, top: int) -> int:
    return max(1, min(default if limit is None else limit, top))


def _active() -> Column:
    return F.count_if(~F.col("dismissed"))


def _counts() -> list[Column]:
    return [
        F.count("*").alias("count"),
        _active().alias("active_count"),
        F.count_if("dismissed").alias("dismissed_count"),
    ]


def _high_risk() -> Column:
    return F.count_if(~F.col("dismissed") & F.col("severity").isin(HIGH_RISK))


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) == 0, 0.0).otherwise(F.col(part) / F.col(whole))


def per_scan(h: History) -> DataFrame:
    """Run table with the counts of each run; runs without findings count zero."""
    counted = h.findings.groupBy("scan_id").agg(
        F.count("*").alias("finding_count"),
        _active().alias("active_count"),
        F.count_if("dismissed").alias("dismissed_count"),
        _high_risk().alias("high_risk_count"),
    )
    names = ["finding_count", "active_count", "dismissed_count", "high_risk_count"]
    # Stored runs already carry counts; they are taken from the findings at hand.
    return h.runs.drop(*names).join(counted, "scan_id", "left").fillna(0, names)


def _totals() -> list[Column]:
    return [
        F.countDistinct("scan_id").alias("scan_count"),
        F.coalesce(F.sum("finding_count"), F.lit(0)).alias("finding_count"),
        F.coalesce(F.sum("active_count"), F.lit(0)).alias("active_count"),
        F.coalesce(F.sum("dismissed_count"), F.lit(0)).alias("dismissed_count"),
    ]


def history_stats(h: History, since: int | None = None, project: str | None = None) -> DataFrame:
    runs = per_scan(h.scoped(since, project))
    return runs.agg(*_totals(), F.max("completed_at").alias("latest_scan_at"))


def severity_counts(h: History, since: int | None = None, project: str | None = None) -> DataFrame:
    grouped = h.scoped(since, project).findings.groupBy(F.col("severity").alias("key")).agg(*_counts())
    return grouped.orderBy(F.desc("count"), "key")


def type_counts(h: History, since: int | None = None, project: str | None = None) -> DataFrame:
    grouped = h.scoped(since, project).findings.groupBy(F.col("type").alias("key")).agg(*_counts())
    return grouped.orderBy(F.desc("count"), "key")


def _rules(h: History) -> DataFrame:
    false_positive = F.col("dismissed") & is_false_positive(F.col("dismissed_reason"))
    return (
        h.findings.groupBy(F.col("detection_rule").alias("key"), "type", "severity")
        .agg(*_counts(), F.count_if(false_positive).alias("false_positive_count"))
        .withColumn("false_positive_rate", _rate("false_positive_count", "count"))
    )


def top_rules(h: History, k: int | None = None, since: int | None = None, project: str | None = None) -> DataFrame:
    order = [F.desc("count"), F.desc("active_count"), "key", "type", "severity"]
    return _rules(h.scoped(since, project)).orderBy(*order).limit(clamp(k, 10, 100))


def false_positive_rules(h: History, k: int | None = None, since: int | None = None, project: str | None = None) -> DataFrame:
    order = [F.desc("false_positive_rate"), F.desc("false_positive_count"), F.desc("count"), "key", "type", "severity"]
    rules = _rules(h.scoped(since, project)).filter("false_positive_count > 0")
    return rules.orderBy(*order).limit(clamp(k, 10, 100))


def _reason() -> Column:
    return F.coalesce(F.nullif(F.trim("dismissed_reason"), F.lit("")), F.lit("unspecified"))


def dismissal_reasons(h: History, since: int | None = None, project: str | None = None) -> DataFrame:
    return (
        h.scoped(since, project)
        .findings.filter("dismissed")
        .groupBy(_reason().alias("key"))
        .agg(F.count("*").alias("count"), F.lit(0).cast("bigint").alias("active_count"), F.count("*").alias("dismissed_count"))
        .orderBy(F.desc("count"), "key")
    )


def _author_key() -> Column:
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.lower(filled(F.col("author_email"))), filled(F.col("author_name")), F.lit("unknown"))


def author_risk(h: History, k: int | None = None, since: int | None = None, project: str | None = None) -> DataFrame:
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    grouped = (
        h.scoped(since, project)
        .findings.groupBy(_author_key().alias("key"))
        .agg(
            F.max(filled("author_name")).alias("name"),
            F.max(filled("author_email")).alias("email"),
            *_counts(),
            _high_risk().alias("high_risk_count"),
        )
        .withColumn("high_risk_rate", _rate("high_risk_count", "active_count"))
    )
    order = [F.desc("high_risk_count"), F.desc("active_count"), F.desc("count"), "key"]
    return grouped.orderBy(*order).limit(clamp(k, 10, 100))


def project_risk(h: History, k: int | None = None, since: int | None = None, project: str | None = None) -> DataFrame:
    label = F.coalesce(F.nullif(F.trim("project"), F.lit("")), F.lit("Unassigned"))
    grouped = (
        per_scan(h.scoped(since, project))
        .groupBy(label.alias("key"))
        .agg(*_totals(), F.sum("high_risk_count").alias("high_risk_count"))
        .withColumn("high_risk_rate", _rate("high_risk_count", "active_count"))
    )
    order = [F.desc("high_risk_count"), F.desc("active_count"), F.desc("finding_count"), "key"]
    return grouped.orderBy(*order).limit(clamp(k, 10, 100))


def daily_trend(h: History, since: int | None = None, project: str | None = None) -> DataFrame:
    runs = per_scan(h.scoped(since, project))
    return runs.groupBy(utc_day(F.col("completed_at")).alias("date")).agg(*_totals()).orderBy("date")


def scan_delta(h: History, per_project: bool = True) -> DataFrame:
    """Active findings introduced, resolved and persistent between each run and the one before it.

    With run numbers dense, a finding persists exactly when its previous appearance is one run earlier and is resolved
    when its next appearance is later than one run on. That needs one shuffle by finding instead of a join of each run
    with its predecessor.
    """
    scope = ["_project"] if per_project else []
    label = F.coalesce("project", F.lit("\u0000")) if per_project else F.lit("")
    # One project may hold most runs, and its runs most findings: numbers come from ranges of the run table.
    runs = numbered(h.runs.withColumn("_project", label), ["_project"], ["completed_at", "scan_id"], "_n")
    runs = runs.select("scan_id", "_project", (F.col("_n") + 1).alias("_n"), "completed_at", "project")
    active = h.findings.filter(~F.col("dismissed")).select("scan_id", "finding_id").join(
        runs.select("scan_id", "_project", "_n"), "scan_id"
    )
    by_finding = Window.partitionBy("_project", "finding_id").orderBy("_n")
    seen = active.withColumn("_before", F.lag("_n").over(by_finding)).withColumn("_after", F.lead("_n").over(by_finding))
    persists = F.coalesce(F.col("_before") == F.col("_n") - 1, F.lit(False))
    leaves = F.coalesce(F.col("_after") != F.col("_n") + 1, F.lit(True))
    events = seen.select(
        "_project",
        F.explode(
            F.array(
                F.struct(F.col("_n").alias("n"), F.when(persists, "persistent").otherwise("introduced").alias("what")),
                F.struct((F.col("_n") + 1).alias("n"), F.when(leaves, "resolved").alias("what")),
            )
        ).alias("ev"),
    ).select("_project", F.col("ev.n").alias("_n"), F.col("ev.what").alias("what"))
    counted = events.groupBy("_project", "_n").agg(
        *[F.count_if(F.col("what") == w).alias(f"{w}_count") for w in ("introduced", "resolved", "persistent")]
    )
    previous = runs.select("_project", (F.col("_n") + 1).alias("_n"), F.col("scan_id").alias("previous_scan_id"))
    pairs = runs.join(previous, ["_project", "_n"])
    return (
        pairs.join(counted, ["_project", "_n"], "left")
        .fillna(0, ["introduced_count", "resolved_count", "persistent_count"])
        .select(
            "project",
            "previous_scan_id",
            F.col("scan_id").alias("current_scan_id"),
            F.col("completed_at").alias("current_completed_at"),
            "introduced_count",
            "resolved_count",
            "persistent_count",
        )
    )


def latest_scan_delta(h: History, since: int | None = None, project: str | None = None) -> DataFrame:
    """Delta of the two newest runs in scope; no row when there are fewer than two.

    Only those two runs' findings are read: the run ids come from a top-2 over the run table.
    """
    scoped = h.scoped(since, project)
    newest = scoped.runs.orderBy(F.desc("completed_at"), F.desc("scan_id")).limit(2)
    pair = History(newest, scoped.findings.join(newest.select("scan_id"), "scan_id", "left_semi"))
    return scan_delta(pair, per_project=False).drop("project")


def feedback_summary(buckets: DataFrame, k: int | None = None, since: int | None = None, project: str | None = None) -> DataFrame:
    """Anonymous feedback per rule fingerprint. It carries no project, so a project filter hides all of it."""
    rows = buckets.filter(F.lit(project is None))
    if since is not None:
        rows = rows.filter(F.col("last_received_at") >= since)
    known = lambda c: F.max(F.nullif(F.col(c), F.lit("")))
    grouped = rows.groupBy("rule_fingerprint").agg(
        F.sum("event_count").alias("event_count"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
        F.array_join(F.sort_array(F.collect_set("scope")), ",").alias("scopes"),
        known("finding_type").alias("finding_type"),
        known("detection_layer").alias("detection_layer"),
        known("severity").alias("severity"),
        F.min("first_received_at").alias("first_received_at"),
        F.max("last_received_at").alias("last_received_at"),
    )
    order = [F.desc("event_count"), F.desc("last_received_at"), "rule_fingerprint"]
    return grouped.orderBy(*order).limit(clamp(k, 10, 100))


def match_fingerprints(feedback: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach the rule name where exactly one known rule (``detection_rule``) has the fingerprint."""
    known = (
        rules.filter("detection_rule <> ''")
        .select("detection_rule")
        .distinct()
        .groupBy(rule_fingerprint(F.col("detection_rule")).alias("rule_fingerprint"))
        .agg(F.count("*").alias("_n"), F.max("detection_rule").alias("matched_rule"))
        .filter("_n = 1")
        .drop("_n")
    )
    return feedback.join(known, "rule_fingerprint", "left")


_VULNERABILITIES = [t for t in schema.FINDING_TYPES if t not in ("missing_security_measure", "other")]
# Fixed values: (framework, control, title, finding types it maps to; none means every type).
CONTROLS = [
    ("soc2", "CC6.1", "Logical access safeguards", ["missing_security_measure"]),
    ("soc2", "CC7.1", "Vulnerability identification", _VULNERABILITIES),
    ("soc2", "CC7.2", "Security event monitoring", []),
    ("iso27001", "A.8.8", "Management of technical vulnerabilities", _VULNERABILITIES),
    ("iso27001", "A.8.16", "Monitoring activities", []),
    ("iso27001", "A.8.25", "Secure development life cycle",
     ["missing_security_measure", "insecure_config", "ai_pattern_error", "sql_injection", "xss"]),
]
FRAMEWORKS = ["soc2", "iso27001"]


def compliance_controls(
    h: History, frameworks: Sequence[str] = FRAMEWORKS, since: int | None = None, project: str | None = None
) -> DataFrame:
    """Active findings behind each control and whether they call for attention."""
    scoped = h.scoped(since, project)
    spark = h.runs.sparkSession
    wanted = [(fw, id, title, types or schema.FINDING_TYPES) for fw, id, title, types in CONTROLS if fw in frameworks]
    controls = spark.createDataFrame(wanted, "framework string, control string, title string, types array<string>")
    # At most one row per finding type, so Spark sees both sides small.
    active = scoped.findings.groupBy("type").agg(_active().alias("active"))
    scans = scoped.runs.agg(F.countDistinct("scan_id").alias("scan_count"))
    mapped = (
        controls.withColumn("type", F.explode("types"))
        .join(active, "type", "left")
        .groupBy("framework", "control", "title")
        .agg(F.coalesce(F.sum("active"), F.lit(0)).alias("active_finding_count"))
    )
    # One row joins one row per control.
    return mapped.join(scans, F.lit(True)).select(
        "framework",
        "control",
        "title",
        "active_finding_count",
        F.when(F.col("scan_count") == 0, "not_assessed")
        .when(F.col("active_finding_count") > 0, "attention")
        .otherwise("observed")
        .alias("status"),
    )


def audit_activity(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action", "outcome").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "action", "outcome")


def compliance_report(
    h: History, audit: DataFrame, generated_at: int, since: int | None = None, project: str | None = None, k: int | None = 100
) -> DataFrame:
    """One nested row: window, totals, newest delta, reasons, rules, activity and controls.

    Free texts of the history (reasons, actions, rules) make lists of any length, so a list holds its ``k`` foremost entries
    (``None``: all). The sections meet in one union and one aggregation; nothing is joined.
    """
    reasons = dismissal_reasons(h, since, project).select(F.col("key").alias("reason"), F.col("dismissed_count").alias("count"))
    rules = top_rules(h, None, since, project).drop("type", "severity", "dismissed_count")
    parts = [
        ("_totals", history_stats(h, since, project), []),
        ("latest_scan_delta", latest_scan_delta(h, since, project), []),
        ("dismissal_reasons", reasons, [F.desc("count"), F.col("reason")]),
        ("top_rules", rules, [F.desc("count"), F.desc("active_count"), F.col("key")]),
        ("activity", audit_activity(audit), [F.desc("count"), F.col("action"), F.col("outcome")]),
        ("controls", compliance_controls(h, FRAMEWORKS, since, project), [F.col("framework"), F.col("control")]),
    ]
    nested = []
    for name, df, order in parts:
        entries = df.orderBy(*order) if order else df
        entries = entries.limit(k) if order and k is not None else entries
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) if order else F.lit(1)
        nested.append((name, entries.select(place.alias("_i"), F.struct(*df.columns).alias(name))))
    kinds = {name: df.schema[name].dataType for name, df in nested}
    rows = None
    for name, df in nested:
        wide = df.select("_i", *[F.col(n) if n == name else F.lit(None).cast(kind).alias(n) for n, kind in kinds.items()])
        rows = wide if rows is None else rows.unionByName(wide)
    packed = lambda n: F.transform(
        F.sort_array(F.collect_list(F.when(F.col(n).isNotNull(), F.struct("_i", F.col(n).alias("v"))))), lambda x: x["v"]
    )
    report = rows.agg(*[packed(n).alias(n) for n in kinds])
    return report.select(
        F.lit(generated_at).cast("bigint").alias("generated_at"),
        F.lit(since).cast("bigint").alias("since"),
        F.lit(project).cast("string").alias("project"),
        F.col("_totals")[0].alias("_totals"),
        *[n for n in kinds if n != "_totals"],
    ).select("generated_at", "since", "project", "_totals.*", *[n for n in kinds if n != "_totals"])


def risk_posture(h: History, per_project: bool = False, since: int | None = None, project: str | None = None) -> DataFrame:
    """Critical, High, Watch or Clear by what is still active."""
    scoped = h.scoped(since, project)
    counted = scoped.findings.groupBy("scan_id").agg(
        F.count_if(~F.col("dismissed") & (F.col("severity") == "critical")).alias("critical"),
        F.count_if(~F.col("dismissed") & (F.col("severity") == "high")).alias("high"),
        _active().alias("active"),
    )
    label = F.coalesce(F.nullif(F.trim("project"), F.lit("")), F.lit("Unassigned")) if per_project else F.lit("all")
    joined = scoped.runs.join(counted, "scan_id", "left").fillna(0, ["critical", "high", "active"])
    return (
        joined.groupBy(label.alias("key"))
        .agg(F.sum("critical").alias("critical"), F.sum("high").alias("high"), F.sum("active").alias("active"))
        .withColumn(
            "posture",
            F.when(F.col("critical") > 0, "Critical").when(F.col("high") > 0, "High").when(F.col("active") > 0, "Watch").otherwise("Clear"),
        )
    )


# Per-file time budgets in milliseconds.
L1_MIN_MS, L1_MS_PER_LINE, L2_MS, L3_MS = 50, 50, 2000, 5000


def with_budgets(performance: DataFrame) -> DataFrame:
    """Attach ``budgets(layer, elapsed_ms, budget_ms, exceeded)`` to per-file timings; a null timing means not run."""
    limits = [
        ("L1", "l1_ms", F.greatest(F.lit(float(L1_MIN_MS)), F.col("line_count") * float(L1_MS_PER_LINE))),
        ("L2", "l2_ms", F.lit(float(L2_MS))),
        ("L3", "l3_ms", F.lit(float(L3_MS))),
    ]
    checks = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(ms).isNotNull(),
                    F.struct(
                        F.lit(layer).alias("layer"),
                        F.col(ms).alias("elapsed_ms"),
                        limit.alias("budget_ms"),
                        (F.col(ms) > limit).alias("exceeded"),
                    ),
                )
                for layer, ms, limit in limits
            ]
        )
    )
    return performance.withColumn("budgets", checks)


def scan_performance_summary(performance: DataFrame) -> DataFrame:
    rows = with_budgets(performance)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("file_count"),
        total("total_ms").alias("total_ms"),
        (total("total_ms") / F.greatest(F.lit(1), F.count("*"))).alias("average_ms"),
        total("l1_ms").alias("l1_ms"),
        total("l2_ms").alias("l2_ms"),
        total("l3_ms").alias("l3_ms"),
        F.max_by("file", F.struct("total_ms", "file")).alias("slowest_file"),
        F.max("total_ms").alias("slowest_ms"),
        F.sum(F.size(F.filter("budgets", lambda b: b["exceeded"]))).alias("budget_exceeded_count"),
    )


def budget_warnings(performance: DataFrame) -> DataFrame:
    rows = with_budgets(performance)
    return rows.select("file", F.explode(F.filter("budgets", lambda b: b["exceeded"])).alias("b")).select(
        "file", F.col("b.layer").alias("layer"), F.col("b.elapsed_ms").alias("elapsed_ms"), F.col("b.budget_ms").alias("budget_ms")
    )


def active_severity_counts(h: History, since: int | None = None, project: str | None = None) -> DataFrame:
    """Active findings for each of the five severities, zero included, in one aggregation."""
    active = h.scoped(since, project).findings.filter(~F.col("dismissed"))
    wide = active.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in schema.SEVERITIES])
    pairs = ", ".join(f"'{s}', `{s}`" for s in schema.SEVERITIES)
    return wide.select(F.expr(f"stack({len(schema.SEVERITIES)}, {pairs}) AS (severity, active_count)"))


def full_summary(h: History, since: int | None = None, project: str | None = None, k: int | None = None) -> DataFrame:
    """Counts in total and by severity, type, rule (with its type and severity), dismissal reason, author, project and day.

    One read of the findings: they are counted per run and all keys first, so what meets the runs and is then regrouped by
    every section is as small as the distinct combinations, and a hot run or project sends one row per combination.
    ``position`` ranks the keys of a section as its report does (most findings, then most active, then key); ``k`` keeps that
    many of each. Deltas and feedback have rows of another kind: ``scan_delta``, ``feedback_summary``.
    """
    scope = h.scoped(since, project)
    keys = ["severity", "type", "rule", "reason", "author"]
    counts = ["count", "active_count", "dismissed_count", "false_positive_count", "high_risk_count"]
    rows = scope.findings.select(
        "scan_id",
        "severity",
        "type",
        F.col("detection_rule").alias("rule"),
        F.when(F.col("dismissed"), _reason()).alias("reason"),
        _author_key().alias("author"),
        "dismissed",
        (F.col("dismissed") & is_false_positive(F.col("dismissed_reason"))).alias("fp"),
        (~F.col("dismissed") & F.col("severity").isin(HIGH_RISK)).alias("risky"),
    )
    per_run = rows.groupBy("scan_id", *keys).agg(
        *_counts(), F.count_if("fp").alias("false_positive_count"), F.count_if("risky").alias("high_risk_count")
    )
    label = F.coalesce(F.nullif(F.trim("project"), F.lit("")), F.lit("Unassigned"))
    runs = scope.runs.select("scan_id", label.alias("project"), utc_day(F.col("completed_at")).cast("string").alias("day"))
    joined = per_run.join(runs, "scan_id").withColumn("total", F.lit("all"))
    sections = ["total", *keys, "project", "day"]
    key = F.create_map(*[x for s in sections for x in (F.lit(s), F.col(s))])
    named = joined.select(F.explode(key).alias("section", "key"), "type", "severity", *counts).filter(F.col("key").isNotNull())
    of_rule = lambda c: F.when(F.col("section") == "rule", F.col(c))
    out = named.groupBy("section", "key", of_rule("type").alias("type"), of_rule("severity").alias("severity")).agg(
        *[F.sum(c).alias(c) for c in counts]
    )
    best = Window.partitionBy("section").orderBy(F.desc("count"), F.desc("active_count"), "key", "type", "severity")
    ranked = out.withColumn("position", F.row_number().over(best))
    return ranked if k is None else ranked.filter(F.col("position") <= k)
