"""Deduplication, ordering, suppression, gating and attribution of findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import names
from ..functions import text as tx
from ..functions.globs import glob_regex

POSITION = ["detection_rule", "file", "line", "column"]


def unique_findings(findings: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """First finding per (rule, file, line, column) in the given order.

    The rank limit runs before the shuffle too, so copies of one position are dropped where they are read.
    """
    ranked = findings.withColumn("_rn", F.row_number().over(Window.partitionBy(*POSITION).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def rank_findings(findings: DataFrame) -> DataFrame:
    rank = schema.severity_rank(F.col("severity"))
    return findings.orderBy(rank, "file", "line", "column", "detection_rule")


# Suppression tags and the tools whose comments may name a finding.
SUPPRESSION_TAG = r"\b(?:NOSONAR|nosemgrep|snyk(?::ignore|-ignore|\s+ignore)|codeql\s*\[|lgtm\s*\[)\b"
NAMED_TOOL = r"\b(?:sonar(?:cloud|qube|js)?|snyk|semgrep|codeql)\b"
_COMMENT = r"(?://|#|--|/\*|\*)\s*(.+)\z"


def _words(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def comment_lines(corpus: DataFrame) -> DataFrame:
    """Comment text per line that carries a suppression tag or names a scanning tool."""
    relevant = corpus.filter(F.col("text").rlike("(?i)nosonar|nosemgrep|snyk|codeql|lgtm|sonar|semgrep"))
    lines = relevant.select("file", F.posexplode(F.split("text", "\r?\n", -1)).alias("_i", "_text"))
    comment = F.trim(F.regexp_extract("_text", _COMMENT, 1))
    return (
        lines.select("file", (F.col("_i") + 1).alias("comment_line"), comment.alias("comment"))
        .withColumn("tagged", F.col("comment").rlike(tx.java_regex(SUPPRESSION_TAG, "i")))
        .filter(F.col("tagged") | F.col("comment").rlike(tx.java_regex(NAMED_TOOL, "i")))
    )


# Fixed value: the note in front of another tool's comment.
ANNOTATION_REASON = "Deduplicated with existing SAST annotation: "


def dedup_existing_tools(findings: DataFrame, corpus: DataFrame) -> DataFrame:
    """Dismiss active layer-2 findings that another tool's comment on the same line or the two lines before explains.

    A suppression tag suffices; a tool's name needs the rule or the type beside it. The first such line counts. Comments are filed
    under the three lines they may explain, so findings, and the detectors behind them, are read once.
    """
    comments = comment_lines(corpus).withColumn("line", F.explode(F.sequence(F.col("comment_line"), F.col("comment_line") + 2)))
    said = F.struct("comment_line", "comment", "tagged", _words(F.col("comment")).alias("said"))
    near = comments.groupBy("file", "line").agg(F.sort_array(F.collect_set(said)).alias("_near"))
    variants = [
        v
        for c in ("detection_rule", "type")
        for v in (_words(F.col(c)), _words(F.regexp_replace(F.lower(c), "^sast_", "")))
    ]
    mentioned = lambda c: reduce(or_, [(v != "") & F.contains(c["said"], v) for v in variants])
    note = F.get(F.filter("_near", lambda c: c["tagged"] | mentioned(c)), F.lit(0))["comment"]
    known = F.col("_near").isNotNull() & F.col("detection_rule").isNotNull() & F.col("type").isNotNull()
    joined = findings.join(near, ["file", "line"], "left").withColumn("_note", F.when(known, tx.clip(tx.collapse_spaces(note), 120)))
    hit = F.col("_note").isNotNull() & (F.col("detection_layer") == "L2") & ~F.col("dismissed")
    reason = F.concat(F.lit(ANNOTATION_REASON), F.col("_note"))
    return (
        joined.withColumn("dismissed_reason", F.when(hit, reason).otherwise(F.col("dismissed_reason")))
        .withColumn("dismissed", F.col("dismissed") | hit)
        .select(*findings.columns)
    )


def ignore_rule(entry: Mapping, file: str = "file") -> Column:
    """Condition under which a finding falls to one suppression rule."""
    ids = [x for x in [entry.get("rule"), *(entry.get("rules") or [])] if isinstance(x, str) and x]
    matches = F.lit(True)
    if ids:
        matches = matches & (F.col("detection_rule").isin(ids) | F.col("type").isin(ids))
    if entry.get("line") is not None:
        matches = matches & (F.col("line") == int(entry["line"]))
    package, registry = entry.get("package"), entry.get("registry")
    if package or registry:
        matches = matches & (F.col("type") == "hallucinated_package")
        if registry:
            matches = matches & (F.regexp_replace("detection_rule", "^hallucinated_package_", "") == registry)
        if package:
            matches = matches & (names.index_key(F.col("evidence")) == package.strip().lower().replace("_", "-"))
    scope = entry.get("scope") or ""
    glob = entry.get("path") or (scope[len("file:") :] if scope.startswith("file:") else None)
    if glob:
        glob = glob.replace("\\", "/")
        path = F.regexp_replace(F.col(file), r"\\", "/")
        suffix = glob.removeprefix("**/") if glob.startswith("**/") else glob.removeprefix("*/")
        regex = f"^{glob_regex(glob)}\\z"
        matches = matches & (
            path.rlike(regex) | F.substring_index(path, "/", -1).rlike(regex) | path.endswith(suffix)
        )
    return F.coalesce(matches, F.lit(False))


# Fixed value: the note of a suppression rule that names no reason.
DEFAULT_IGNORE_REASON = "Matched ignore-rules.yml"


def apply_ignore_rules(findings: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Dismiss findings by the first matching suppression rule.

    Rules are configuration held by the driver. They become one first-match expression, so nothing is joined or shuffled.
    """
    if not rules:
        return findings
    reason = F.lit(None).cast("string")
    for entry in reversed(rules):
        reason = F.when(ignore_rule(entry), F.lit(entry.get("reason") or DEFAULT_IGNORE_REASON)).otherwise(reason)
    return (
        findings.withColumn("_why", reason)
        .withColumn("dismissed_reason", F.coalesce("_why", "dismissed_reason"))
        .withColumn("dismissed", F.col("dismissed") | F.col("_why").isNotNull())
        .drop("_why")
    )


def apply_ignored_ids(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """Dismiss listed findings that are still active. ``ids(id)`` may be of any size: Spark picks the join."""
    listed = ids.filter("id is not null and id <> ''").select("id").distinct().withColumn("_listed", F.lit(True))
    joined = findings.join(listed, "id", "left")
    hit = F.coalesce(F.col("_listed"), F.lit(False)) & ~F.col("dismissed")
    return (
        joined.withColumn("dismissed_reason", F.when(hit, "Matched config.ignored_findings").otherwise(F.col("dismissed_reason")))
        .withColumn("dismissed", F.col("dismissed") | hit)
        .select(*findings.columns)
    )


def merge_layers(existing: DataFrame, new: DataFrame, executed: Sequence[str], replace_all: bool = False) -> DataFrame:
    """Keep stored findings of layers that did not run, take the rest from the new scan."""
    if replace_all:
        return unique_findings(new, ["id"])
    kept = existing.filter(~F.col("detection_layer").isin(list(executed))).withColumn("_source", F.lit(0))
    both = kept.unionByName(new.withColumn("_source", F.lit(1)))
    return unique_findings(both, ["_source", "id"]).drop("_source")


def gate(findings: DataFrame, threshold: str, by: Sequence[str] = ()) -> DataFrame:
    """Whether any active finding reaches the threshold, overall or per group; ``none`` never fails."""
    order = {s: i for i, s in enumerate(schema.SEVERITIES)}
    fails = F.lit(False)
    if threshold != "none":
        fails = ~F.col("dismissed") & (schema.severity_rank(F.col("severity")) <= order[threshold])
    return findings.groupBy(*by).agg(
        F.coalesce(F.max(fails), F.lit(False)).alias("failed"), F.count_if(fails).alias("failing_count")
    )


def attribute_authors(findings: DataFrame, commits: DataFrame) -> DataFrame:
    """Author of the newest commit of each file: ``commits(file, author_name, author_email, committed_at)``."""
    trimmed = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    latest = (
        commits.groupBy("file")
        .agg(F.max(F.struct("committed_at", "hash", "author_name", "author_email")).alias("c"))
        .select("file", F.col("c.author_name").alias("author_name"), F.col("c.author_email").alias("author_email"))
        .select("file", trimmed("author_name").alias("author_name"), trimmed("author_email").alias("author_email"))
    )
    return findings.join(latest, "file", "left")


def review_comments(findings: DataFrame, changed_files: DataFrame, existing: DataFrame, limit: int = 20) -> DataFrame:
    """First findings on changed files that no earlier comment covers: ``existing(path, line, body)``.

    Findings are taken in ``position`` order; a comment is keyed by file, last line and rule.
    """
    rule = F.left(F.regexp_replace("detection_rule", "[^a-zA-Z0-9_.-]+", "_"), F.lit(120))
    line = F.when(F.col("end_line") > 0, F.col("end_line")).otherwise(F.col("line"))
    path = F.regexp_replace(F.regexp_replace("file", r"\\", "/"), r"^\./", "")
    rows = findings.filter(~F.col("dismissed")).select(
        path.alias("path"),
        line.alias("line"),
        F.when(rule == "", "finding").otherwise(rule).alias("rule"),
        "severity",
        "message",
        "suggestion",
        "position",
    )
    marked = existing.select(
        F.regexp_replace("path", r"\\", "/").alias("path"),
        "line",
        F.regexp_extract("body", r"<!--\s*inline-finding:([^\s>]+)\s*-->", 1).alias("rule"),
    ).filter("rule <> ''")
    key = ["path", "line", "rule"]
    fresh = (
        rows.filter("line >= 1")
        .join(changed_files.select("path").distinct(), "path", "left_semi")
        .join(marked, key, "left_anti")
    )
    first = fresh.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy("position"))).filter("_rn = 1").drop("_rn")
    text = lambda c, n: F.left(F.trim(F.regexp_replace(c, "[\r\n]+", " ")), F.lit(n))
    body = F.concat(
        F.lit("<!-- inline-finding:"), F.col("rule"), F.lit(" -->\n**"), F.upper("severity"), F.lit("** `"), F.col("rule"),
        F.lit("`\n\n"), text("message", 700),
        F.coalesce(F.concat(F.lit("\n\nSuggested remediation: "), F.nullif(text("suggestion", 500), F.lit(""))), F.lit("")),
    )
    return first.orderBy("position").limit(max(1, min(limit, 50))).select("path", "line", "rule", body.alias("body"), "position")


def rule_fingerprint(rule: Column) -> Column:
    return F.left(F.sha2(F.trim(rule), 256), F.lit(24))


def is_false_positive(reason: Column) -> Column:
    """As reports count it: underscores and dashes read as spaces."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(reason, F.lit("")))), "[_-]", " ")
    return (text == "false positive") | text.rlike(r"^false positive[ (:]")


def is_false_positive_event(reason: Column) -> Column:
    """As feedback events decide it; unlike reports it also accepts the words written together."""
    return F.trim(F.coalesce(reason, F.lit(""))).rlike(r"(?i)^false[\s_-]*positive(?:\z|[\s(:])")


# Standard reasons and the wording of the scopes.
STANDARD_REASONS = {"false_positive": "False positive", "not_issue": "Not an issue", "internal_package": "Internal package"}
SCOPE_SUFFIX = {"line": "line", "file": "file", "global": "global rule", "package": "package"}


def normalize_ignore_reason(reason: Column, fallback: Column | None = None) -> Column:
    value = F.trim(reason)
    slug = F.regexp_replace(F.lower(value), r"[\s-]+", "_")
    known = value
    for id, label in STANDARD_REASONS.items():
        known = F.when((slug == id) | (F.lower(value) == label.lower()), F.lit(label)).otherwise(known)
    return F.when(value != "", known).otherwise(F.lit(None).cast("string") if fallback is None else fallback)


def scoped_ignore_reason(reason: Column, scope: str) -> Column:
    return F.concat(normalize_ignore_reason(reason), F.lit(f" ({SCOPE_SUFFIX[scope]} ignore)"))
