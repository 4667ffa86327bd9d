"""Propagation of untrusted input through local assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import java_regex
from ..session import ensure_checkpoint_dir
from .intervals import points_in_intervals

# Expressions that read untrusted input, per language.
SOURCES = {
    "javascript": r"(?i)\breq\.(?:query|body|params)\b",
    "python": r"(?i)\brequest\.(?:args|form|json|data)\b|\b(?:raw_)?input\s*\(",
}


def visible_bindings(bindings: DataFrame) -> DataFrame:
    """Edges ``(file, id, source_id)``: each name in a value with the binding it means.

    That is, of the bindings of the name that come earlier in an enclosing scope, the one in the smallest scope, and there
    the latest. Scopes nest, so a reference asks once per enclosing scope; within a scope the answer is an as-of lookup.
    No two bindings of a name are paired.
    """
    scopes = bindings.select("file", "scope_start", "scope_end").distinct()
    outer = scopes.select("file", F.col("scope_start").alias("outer_start"), F.col("scope_end").alias("outer_end"))
    chain = points_in_intervals(scopes, outer, ["file"], "scope_start", "outer_start", "outer_end").filter("outer_end >= scope_end")
    names = F.array_distinct(F.regexp_extract_all("value", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))
    uses = bindings.select("file", "id", "start", "scope_start", "scope_end", F.explode(names).alias("name"))
    # Names that are never bound drop out early.
    uses = uses.join(bindings.select("file", "name").distinct(), ["file", "name"], "left_semi")
    asked = uses.join(chain, ["file", "scope_start", "scope_end"]).select(
        "file", "name", F.col("outer_start").alias("scope_start"), F.col("outer_end").alias("scope_end"), "start", "id",
        F.lit(None).cast("string").alias("source_id"),
    )
    given = bindings.select("file", "name", "scope_start", "scope_end", "start", F.lit(None).cast("string").alias("id"), F.col("id").alias("source_id"))
    earlier = Window.partitionBy("file", "name", "scope_start", "scope_end").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    found = (
        asked.unionByName(given)
        .withColumn("_latest", F.max(F.when(F.col("source_id").isNotNull(), F.struct("start", "source_id"))).over(earlier))
        .filter(F.col("id").isNotNull() & F.col("_latest").isNotNull())
    )
    size = F.col("scope_end") - F.col("scope_start")
    return (
        found.groupBy("file", "id", "name")
        .agg(F.min_by("_latest", size).alias("best"))
        .select("file", "id", F.col("best.source_id").alias("source_id"))
        .distinct()
    )


def propagate_taint(bindings: DataFrame, language: str = "javascript") -> DataFrame:
    """Bindings that hold untrusted input: ``bindings(file, id, name, value, start, scope_start, scope_end)``; ``round`` is
    the number of assignments between a binding and the nearest read of a source.

    Reach doubles: after k rounds all bindings within ``2**k`` assignments of a source are known, and the edges have been
    joined with themselves to jumps of ``2**k`` assignments. A binding comes after its sources, so the jumps run out after as
    many rounds as the longest chain has binary digits. Each round is checkpointed.
    """
    ensure_checkpoint_dir(bindings.sparkSession)
    jumps = visible_bindings(bindings).checkpoint()
    seeds = bindings.filter(F.col("value").rlike(java_regex(SOURCES[language]))).select("file", "id", F.lit(0).alias("round"))
    tainted, length = seeds.distinct().checkpoint(), 1
    while not jumps.isEmpty():
        known = tainted.select("file", F.col("id").alias("source_id"), "round")
        reached = jumps.join(known, ["file", "source_id"]).select("file", "id", (F.col("round") + length).alias("round"))
        tainted = tainted.unionByName(reached).groupBy("file", "id").agg(F.min("round").alias("round")).checkpoint()
        further = jumps.select("file", F.col("id").alias("source_id"), F.col("source_id").alias("_next"))
        jumps = jumps.join(further, ["file", "source_id"]).select("file", "id", F.col("_next").alias("source_id")).distinct().checkpoint()
        length *= 2
    return tainted
