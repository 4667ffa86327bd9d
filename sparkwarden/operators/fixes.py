"""Replacement texts, their planning per file and their later validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import java_regex
from ..session import ensure_checkpoint_dir
from .intervals import points_in_intervals

_EXECUTE = (
    r"^(\s*(?:(?:[A-Za-z_][A-Za-z0-9_]*\s*\.)+)?execute\s*\(\s*)f([\"'])([^\"'{}]*)\{([A-Za-z_][A-Za-z0-9_]*)\}"
    r"([^\"'{}]*)\2\s*\)\z"
)
_SQLITE = r"\b(?:import\s+sqlite3|from\s+sqlite3\s+import|sqlite3\s*\.\s*connect)\b"


def mechanical_replacement(rule: Column, evidence: Column, source: Column | None = None) -> Column:
    """Deterministic new text for the rules that have one; null for all others."""

    def once(pattern: str, new: str, flags: str = "") -> Column:
        # Replace the first occurrence only: the rest of the text is captured and put back.
        return F.regexp_replace(evidence, f"^([\\s\\S]*?){java_regex(pattern, flags)}([\\s\\S]*)\\z", f"$1{new}$2")

    chosen = (
        F.when(rule.isin("insecure_config_debug_true", "insecure_config_cors_allow_all"), once(r"\bTrue\b", "False"))
        .when(
            rule == "insecure_config_app_debug_true",
            F.when(F.contains(evidence, F.lit("True")), once(r"\b(?:True|true)\b", "False")).otherwise(
                once(r"\b(?:True|true)\b", "false")
            ),
        )
        .when(rule == "insecure_config_allowed_hosts_wildcard", F.lit("ALLOWED_HOSTS = []"))
        .when(rule == "insecure_config_disable_host_check", once(r"\b(?i:true|1)\b", "false"))
        .when(rule == "insecure_config_spring_security_disable", once(r"\b(?i:true)\b", "false"))
        .when(rule == "insecure_config_yaml_load_without_loader", once(r"\byaml\.load\s*\(", "yaml.safe_load("))
        .when(rule == "sast_insecure_deserialization_yaml", once(r"\b(?i:yaml\.load)\s*\(", "yaml.safe_load("))
        .when(rule == "sast_xss_inner_html", once(r"\.(?:innerHTML|outerHTML)\s*=", ".textContent ="))
    )
    if source is not None:
        bound = F.regexp_replace(evidence, _EXECUTE, "$1$2$3?$5$2, ($4,))")
        chosen = chosen.when(
            (rule == "sast_sql_python_f_string_execute")
            & evidence.rlike(_EXECUTE)
            & source.rlike(java_regex(_SQLITE, "i")),
            bound,
        )
    return chosen


_LINE = 1 << 26  # columns that a line has room for in a position


def _position(line: Column, column: Column) -> Column:
    """One number that grows along the text."""
    return line.cast("bigint") * _LINE + F.least(column.cast("bigint"), F.lit(_LINE - 1))


def _conflicts(candidates: DataFrame) -> DataFrame:
    """``early, late``: rows of fixes with overlapping edits, by rank; each pair once.

    Edits are half-open; two of them overlap only if one starts inside the other, so they meet in an interval join on (file,
    block of positions) instead of file by file.
    """
    place = lambda line, column: F.struct(F.col(f"_e.{line}").alias("line"), F.col(f"_e.{column}").alias("column"))
    each = candidates.select("file", "_row", "_rank", F.explode("edits").alias("_e")).select(
        "file", "_row", "_rank", place("startLine", "startColumn").alias("_s"), place("endLine", "endColumn").alias("_t"),
        _position(F.col("_e.startLine"), F.col("_e.startColumn")).alias("_from"), _position(F.col("_e.endLine"), F.col("_e.endColumn")).alias("_to"),
    )
    names = ["_row", "_rank", "_s", "_t"]
    points = each.select("file", F.col("_from").alias("_at"), *(F.col(c).alias(f"p{c}") for c in names))
    met = points_in_intervals(points, each.select("file", "_from", "_to", *names), ["file"], "_at", "_from", "_to")
    met = met.filter((F.col("p_row") != F.col("_row")) & (F.col("p_s") < F.col("_t")) & (F.col("_s") < F.col("p_t")))
    first = F.col("p_rank") < F.col("_rank")
    early, late = F.when(first, F.col("p_row")).otherwise(F.col("_row")), F.when(first, F.col("_row")).otherwise(F.col("p_row"))
    return met.select(early.alias("early"), late.alias("late")).distinct()


def plan_fixes(findings: DataFrame, reviewed_layer3: bool = False) -> DataFrame:
    """Choose non-overlapping fixes per file: ``outcome`` is safe, reviewable, skipped or excluded.

    By severity, then position, a fix is taken if none of its edits overlaps an edit taken before. That is decided in rounds on the
    graph of conflicts: a fix that ranks before all undecided fixes it conflicts with is taken, and those go. Fixes
    without conflicts are decided at once, so rounds see only fixes in conflict, and no file meets in one task. Layer-3 fixes are
    left out, or with ``reviewed_layer3`` come after every mechanical fix. Edits that are no range skip their fix.
    """
    ensure_checkpoint_dir(findings.sparkSession)
    edits = F.col("fix.edits")
    ready = findings.filter(~F.col("dismissed") & (F.size(F.coalesce(edits, F.array().cast(f"array<{schema.EDIT}>"))) > 0)).select(
        "file", "id", "line", "column", F.coalesce(schema.severity_rank(F.col("severity")), F.lit(len(schema.SEVERITIES))).alias("rank"),
        (F.col("detection_layer") == "L3").alias("generated"), edits.alias("edits"),
    )
    rows = (ready if reviewed_layer3 else ready.filter(~F.col("generated"))).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    after = lambda e: (e["startLine"] < e["endLine"]) | ((e["startLine"] == e["endLine"]) & (e["startColumn"] <= e["endColumn"]))
    sound = F.coalesce(F.forall("edits", lambda e: (e["startLine"] >= 1) & (e["startColumn"] >= 1) & after(e)), F.lit(False))
    good = rows.filter(sound).withColumn("_rank", F.struct("generated", "rank", "line", "column", "id", "_row"))
    edges = _conflicts(good).checkpoint()
    gone = []
    while not edges.isEmpty():
        open_ = edges.select(F.col("early").alias("_row")).union(edges.select(F.col("late"))).distinct()
        taken = open_.join(edges.select(F.col("late").alias("_row")).distinct(), "_row", "left_anti")
        dropped = edges.join(taken.withColumnRenamed("_row", "early"), "early", "left_semi").select(F.col("late").alias("_row")).distinct().checkpoint()
        gone.append(dropped)
        edges = edges.join(taken.withColumnRenamed("_row", "early"), "early", "left_anti")  # a taken fix is never a later one
        for end in ("early", "late"):
            edges = edges.join(dropped.withColumnRenamed("_row", end), end, "left_anti")
        edges = edges.select("early", "late").checkpoint()
    skipped = rows.filter(~sound).select("_row")
    for dropped in gone:
        skipped = skipped.union(dropped)
    planned = rows.join(skipped.distinct().withColumn("_skipped", F.lit(True)), "_row", "left")
    outcome = F.when(F.col("_skipped"), "skipped").when(F.col("generated"), "reviewable").otherwise("safe")
    planned = planned.select("file", "id", outcome.alias("outcome"))
    if reviewed_layer3:
        return planned
    return planned.unionByName(ready.filter("generated").select("file", "id", F.lit("excluded").alias("outcome")))


def secret_environment_fix(file: Column, name: Column, value: Column, match: Column) -> Column:
    """New text for a secret assigned to a plain name: read it from the environment instead; null where no fix is known.

    Known for script and Python files, for values assigned with ``=``; a bearer value keeps no fix. ``match`` ends with the
    quoted ``value``.
    """
    python = F.lower(file).endswith(".py")
    script = F.lower(file).rlike(r"\.(?:js|jsx|ts|tsx|mjs|cjs)\z")
    # camelCase and dashes become the upper-case form of an environment variable.
    variable = F.upper(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), "-", "_"))
    new = F.when(python, F.concat(F.lit('os.getenv("'), variable, F.lit('", "")'))).when(
        script, F.concat(F.lit("process.env."), variable, F.lit(' ?? ""'))
    )
    lead = F.left(match, F.length(match) - F.length(value) - 2)
    known = lead.rlike(r"=\s*\z") & ~F.lower(F.trim(value)).rlike(r"^(?:bearer|token)\s")
    return F.when(known, F.concat(lead, new))


def verify_fix(findings: DataFrame, current: DataFrame) -> DataFrame:
    """Whether each stored secret fix still fits: detection on the present text must report the same rule at the same
    position with the same edits. ``current`` holds that detection's findings, with fixes."""
    keys = ["file", "detection_rule", "line", "column"]
    now = current.filter(F.col("type") == "hardcoded_secret").select(*keys, F.col("fix").alias("_fix")).distinct()
    asked = findings.select("id", "type", *keys, "fix")
    same = F.col("fix").isNotNull() & (F.to_json("fix") == F.to_json("_fix")) & (F.col("type") == "hardcoded_secret")
    return (
        asked.join(now, keys, "left")
        .groupBy("id", *keys)
        .agg(F.max(F.coalesce(same, F.lit(False))).alias("still_valid"))
    )
