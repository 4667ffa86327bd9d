"""SARIF documents from findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Document version and schema.
VERSION = "2.1.0"
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
TOOL = "sparkwarden"


def sarif_results(findings: DataFrame) -> DataFrame:
    """One nested result per active finding, with the rule description it needs."""
    text = F.concat_ws(" ", "message", "suggestion")
    level = (
        F.when(F.col("severity").isin("critical", "high"), "error")
        .when(F.col("severity").isin("medium", "low"), "warning")
        .otherwise("note")
    )
    region = F.struct(
        F.col("line").alias("startLine"),
        F.col("column").alias("startColumn"),
        F.coalesce("end_line", "line").alias("endLine"),
        F.coalesce(F.col("end_column"), F.col("column") + F.greatest(F.lit(1), F.length("evidence"))).alias("endColumn"),
    )
    location = F.struct(
        F.struct(F.struct(F.regexp_replace("file", r"\\", "/").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")
    )
    result = F.struct(
        F.col("detection_rule").alias("ruleId"),
        level.alias("level"),
        F.struct(text.alias("text")).alias("message"),
        F.array(location).alias("locations"),
        F.struct("id", F.col("detection_layer").alias("detectionLayer"), F.col("type").alias("findingType"), "evidence").alias("properties"),
    )
    rule = F.struct(
        F.col("detection_rule").alias("id"),
        F.col("detection_rule").alias("name"),
        F.struct(F.col("message").alias("text")).alias("shortDescription"),
        F.struct(text.alias("text")).alias("fullDescription"),
        F.struct(F.col("detection_layer").alias("detectionLayer"), F.col("type").alias("findingType"), "severity").alias("properties"),
    )
    return findings.filter(~F.col("dismissed")).withColumn("result", result).withColumn("rule", rule)


def to_sarif(findings: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One SARIF document per group (for instance per run and file), results and rules in ``order``.

    The rule text comes from the first finding of the rule. Choose groups whose findings fit one document: a document is
    one value.
    """
    by = list(by)
    at = F.struct(*order)
    rows = sarif_results(findings).withColumn("_at", at)
    rules = (
        rows.groupBy(*by, "detection_rule")
        .agg(F.min(F.struct("_at", "rule")).alias("first"))
        .groupBy(*by)
        .agg(F.transform(F.sort_array(F.collect_list("first")), lambda x: x["rule"]).alias("rules"))
    )
    results = rows.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "result"))), lambda x: x["result"]).alias("results")
    )
    run = F.struct(
        F.struct(F.struct(F.lit(TOOL).alias("name"), F.col("rules").alias("rules")).alias("driver")).alias("tool"),
        F.col("results"),
    )
    document = F.struct(F.lit(VERSION).alias("version"), F.lit(SCHEMA).alias("$schema"), F.array(run).alias("runs"))
    return results.join(rules, by).select(*by, F.size("results").alias("result_count"), F.to_json(document).alias("sarif"))


def write_sarif(documents: DataFrame, path: str) -> None:
    documents.select("sarif").write.mode("overwrite").text(path)
