"""Review answers of a language model, normalised into findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from .spans import to_findings, with_positions

# Limits of one answer.
MAX_FINDINGS, MAX_MESSAGE, MAX_SUGGESTION = 10, 240, 400


def _json(body: Column) -> Column:
    """The JSON in an answer: the whole text, a fenced block, or the span of its outermost brackets."""
    trimmed = F.trim(body)
    fenced = F.trim(F.regexp_extract(trimmed, r"(?i)```(?:json)?\s*([\s\S]*?)```", 1))
    bracketed = F.regexp_extract(trimmed, r"[\[{][\s\S]*[\]}]", 0)
    return F.coalesce(
        F.try_parse_json(trimmed), F.try_parse_json(F.when(trimmed.rlike(r"(?i)```(?:json)?\s*[\s\S]*?```"), fenced).otherwise(bracketed))
    )


def normalize_review_responses(answers: DataFrame, corpus: DataFrame, now: int) -> DataFrame:
    """Findings of ``answers(response_id, file, body)`` placed in the text of their file.

    A finding needs a message, and evidence of its own or from the line it names. It is placed where the evidence
    occurs, else at that line, else at the start. At most ten usable findings of an answer count, in its order.
    """
    parsed = answers.withColumn("_v", _json(F.col("body")))
    items = F.coalesce(
        F.try_variant_get("_v", "$", "array<variant>"), F.try_variant_get("_v", "$.findings", "array<variant>")
    )
    text_of = lambda *names: F.coalesce(
        *[F.nullif(F.trim(F.try_variant_get("_i", f"$.{n}", "string")), F.lit("")) for n in names]
    )
    whole = lambda n: F.try_variant_get("_i", f"$.{n}", "int")
    rows = parsed.select("response_id", "file", F.posexplode(items).alias("_n", "_i")).select(
        "response_id", "file", "_n",
        text_of("message").alias("message"), text_of("evidence").alias("evidence"), text_of("suggestion").alias("suggestion"),
        text_of("severity").alias("severity"), text_of("ruleId", "rule_id").alias("rule_id"), text_of("replacement").alias("replacement"),
        whole("line").alias("_line"), whole("column").alias("_column"),
    ).filter(F.col("message").isNotNull())
    placed = rows.join(corpus.select("file", "text"), "file")
    lines = F.split("text", "\n", -1)
    named = F.when((F.col("_line") >= 1) & (F.col("_line") <= F.size(lines)), F.col("_line"))
    before = F.aggregate(F.slice(lines, F.lit(1), named - 1), F.lit(0), lambda acc, s: acc + F.length(s) + 1)
    by_line = F.least(F.length("text"), before + F.when(F.col("_column") > 0, F.col("_column") - 1).otherwise(0))
    placed = placed.withColumn("evidence", F.coalesce("evidence", F.nullif(F.trim(F.get(lines, named - 1)), F.lit(""))))
    placed = placed.filter(F.col("evidence").isNotNull())
    exact = F.instr("text", F.col("evidence"))
    placed = placed.withColumn("start", F.when(exact > 0, exact - 1).otherwise(F.coalesce(by_line, F.lit(0)))).withColumn(
        "end", F.least(F.length("text"), F.col("start") + F.greatest(F.lit(1), F.length("evidence")))
    )
    first = Window.partitionBy("response_id", "file").orderBy("_n")
    placed = placed.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= MAX_FINDINGS)
    placed = with_positions(with_positions(placed, "start"), "end", prefix="end_")

    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("rule_id", F.lit("security_review"))), "[^a-z0-9_.-]+", "_"), r"^_+|_+\z", "")
    id = F.when(slug.startswith("l3_"), slug).otherwise(F.concat(F.lit("l3_llm_"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("security_review"))))
    rule = F.struct(
        F.lit(0).alias("ordinal"), id.alias("id"),
        F.when(F.col("severity").isin(schema.SEVERITIES), F.col("severity")).otherwise("medium").alias("severity"),
        F.lit("missing_security_measure").alias("type"), F.left("message", F.lit(MAX_MESSAGE)).alias("message"),
        F.left("suggestion", F.lit(MAX_SUGGESTION)).alias("suggestion"), F.lit("L3").alias("layer"),
    )
    new, n = F.col("replacement"), F.length("replacement")
    unsafe = (
        (new == F.col("evidence")) | (n > 8000) | (n > F.greatest(F.lit(2000), F.length("evidence") * 20)) | F.contains(new, F.lit("```"))
        | new.startswith("diff --git") | new.startswith("--- ") | F.contains(new, F.lit("\n@@ ")) | F.contains(new, F.lit("\u0000"))
        | (F.substr("text", F.col("start") + 1, F.length("evidence")) != F.col("evidence"))
    )
    placed = placed.withColumn("match", F.col("evidence")).withColumn("_new", F.when(~unsafe, new)).withColumn("rule", rule)
    found = to_findings(placed.withColumn("evidence", F.col("match")), now, fix=F.col("_new"), detector=5)
    described = F.when(F.col("fix").isNotNull(), F.col("fix").withField("description", F.lit("Review LLM-generated replacement")))
    return found.withColumn("fix", described)
