"""Verification of package references against index, seed catalogue and cache, and the findings it yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..functions.names import index_key, seed_key
from ..rules.seeds import INVENTED_PACKAGES, KNOWN_PACKAGES
from .similarity import suggest_from, suggest_names

DAY_MS = 24 * 60 * 60 * 1000
_ABSENT = "Package was absent from a full local package index."
_UNKNOWN = "Package was not in the local seed catalog."


def seed_table(spark: SparkSession) -> DataFrame:
    """``(registry, package_name, exists, alternatives)`` of the seed catalogue."""
    rows = [(r, n, True, []) for r, ns in KNOWN_PACKAGES.items() for n in ns]
    rows += [(r, n, False, alt) for r, ns in INVENTED_PACKAGES.items() for n, alt in ns.items()]
    return spark.createDataFrame(rows, "registry string, package_name string, exists boolean, alternatives array<string>")


def verify(
    references: DataFrame,
    index: DataFrame,
    coverage: DataFrame,
    cache: DataFrame,
    now: int,
    ttl: int = DAY_MS,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Three-valued existence of each distinct referenced package.

    ``references(registry, package_name, lookup)``, ``index(registry, package_name)`` with normalised names,
    ``coverage(registry, coverage)``, ``cache(registry, package_name, exists, last_verified)``. Order of trust: index
    hit, full index without it, seed, cache within its lifetime; else ``exists`` stays null. Names are made distinct
    before any lookup, so a name used by a third of all files is looked up once. Class lookups skip index and seed.
    """
    spark = references.sparkSession
    seed = seed_table(spark) if seed is None else seed
    asked = references.select("registry", "package_name", "lookup").distinct()
    by_class = F.coalesce(F.col("lookup") == "class", F.lit(False))
    keyed = asked.withColumn("_key", index_key(F.col("package_name"))).withColumn(
        "_seed", seed_key(F.col("registry"), F.col("package_name"))
    )
    known = index.select("registry", F.col("package_name").alias("_key"), F.lit(True).alias("_hit"))
    # One row per registry.
    full = coverage.groupBy("registry").agg((F.max("coverage") == "full").alias("_complete")).filter(
        F.col("registry").isin(schema.REGISTRIES)
    )
    seeds = seed.groupBy("registry", seed_key(F.col("registry"), F.col("package_name")).alias("_seed")).agg(
        F.bool_or("exists").alias("_seeded")
    )
    cached = cache.select(
        "registry", F.col("package_name").alias("_key"), F.col("exists").alias("_cached"), F.col("last_verified").alias("_at"),
        F.lit(True).alias("_in_cache"),
    )
    rows = (
        keyed.join(known, ["registry", "_key"], "left")
        .join(F.broadcast(full), "registry", "left")
        .join(F.broadcast(seeds), ["registry", "_seed"], "left")
        .join(cached, ["registry", "_key"], "left")
    )
    fresh = F.coalesce(F.col("_in_cache"), F.lit(False)) & (F.lit(now) - F.col("_at") < ttl)
    indexed = ~by_class & F.col("_hit").isNotNull()
    absent = ~by_class & F.col("_hit").isNull() & F.coalesce(F.col("_complete"), F.lit(False))
    seeded = ~by_class & F.col("_seeded").isNotNull()
    verdict = lambda value, source, at, message: F.struct(
        value.cast("boolean").alias("exists"), F.lit(source).alias("source"), at.cast("bigint").alias("last_verified"),
        F.lit(message).cast("string").alias("message"),
    )
    at = F.lit(now)
    chosen = (
        F.when(indexed, verdict(F.lit(True), "index", at, None))
        .when(absent, verdict(F.lit(False), "index", at, _ABSENT))
        .when(seeded, verdict(F.col("_seeded"), "seed", at, None))
        .when(fresh, verdict(F.col("_cached"), "cache", F.col("_at"), None))
        .otherwise(verdict(F.lit(None), "unverified", at, _UNKNOWN))
    )
    return rows.withColumn("v", chosen).select("registry", "package_name", "lookup", "v.*")


def similar_packages(unresolved: DataFrame, index: DataFrame, seed: DataFrame, keep: int = 3) -> DataFrame:
    """Up to three alternatives per name: index suggestions first, then the seed's, each name once."""
    wanted = unresolved.select("registry", "package_name").distinct()
    indexed = suggest_names(wanted, index, 5).select("registry", "package_name", "candidate", "rank")
    keyed = wanted.withColumn("_seed", seed_key(F.col("registry"), F.col("package_name")))
    invented = seed.filter(~F.col("exists")).select(
        "registry", seed_key(F.col("registry"), F.col("package_name")).alias("_seed"), "alternatives"
    )
    direct = keyed.join(F.broadcast(invented), ["registry", "_seed"]).select(
        "registry", "package_name", F.posexplode("alternatives").alias("_pos", "candidate")
    ).select("registry", "package_name", "candidate", (F.col("_pos") + 101).alias("rank"))
    others = keyed.join(F.broadcast(invented), ["registry", "_seed"], "left_anti")
    scored = suggest_from(others, seed.filter("exists"), 3).select(
        "registry", "package_name", "candidate", (F.col("rank") + 100).alias("rank")
    )
    merged = indexed.unionByName(direct).unionByName(scored)
    first = merged.groupBy("registry", "package_name", "candidate").agg(F.min("rank").alias("rank"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "candidate")))
    return first.groupBy("registry", "package_name").agg(
        F.slice(F.transform(ordered, lambda x: x["candidate"]), 1, keep).alias("similar")
    )


def replacement_candidates(similar: Column, original: Column) -> Column:
    """Alternatives that are safe to write into a manifest, in order, without the original."""
    trimmed = F.array_distinct(F.transform(similar, lambda s: F.trim(s)))
    return F.filter(
        trimmed, lambda s: (s != original) & (F.length(s).between(1, 256)) & s.rlike(r"^[A-Za-z0-9@._/+:-]+\z")
    )


# Wording of the package findings.
_RISK = (
    "This may be a slopsquatting risk: AI-generated code often invents plausible package names. "
    "Verify the package before installing from %s."
)
_UNVERIFIED = (
    "The package could not be confirmed because the local index had no answer and the remote registry was unavailable."
)
_CHECK = "Check registry connectivity or synchronize the local package-name index before installing it."


def missing_packages(
    references: DataFrame, resolutions: DataFrame, similar: DataFrame, now: int, remote: bool = False
) -> DataFrame:
    """A critical finding for each reference to a package that does not exist; in remote mode also a medium one for each
    that could not be verified. ``exists`` null is never read as false.

    Only unresolved names enter the join, so references to existing packages are dropped by it.
    """
    keys = ["registry", "package_name"]
    relevant = resolutions.filter(~F.col("exists") | (F.col("exists").isNull() & F.lit(remote)))
    rows = (
        references.join(
            relevant.select(*keys, "lookup", "exists", F.col("message").alias("detail")).withColumn("_lookup", F.coalesce("lookup", F.lit(""))).drop("lookup"),
            [*keys],
        )
        .filter(F.coalesce(references["lookup"], F.lit("")) == F.col("_lookup"))
        .join(similar, keys, "left")
        .withColumn("similar", F.coalesce("similar", F.array().cast("array<string>")))
    )
    gone = F.coalesce(~F.col("exists"), F.lit(False))
    quoted = F.concat(F.lit('"'), F.col("package_name"), F.lit('"'))
    asked = F.array_join(F.transform("similar", lambda s: F.concat(F.lit('"'), s, F.lit('"'))), " or ")
    advice = F.concat(
        F.format_string(_RISK, F.col("registry")),
        F.coalesce(F.concat(F.lit(" "), F.col("detail")), F.lit("")),
        F.when(F.size("similar") > 0, F.concat(F.lit(" Did you mean "), asked, F.lit("?"))).otherwise(""),
    )
    rule = F.concat(
        F.when(gone, "hallucinated_package_").otherwise("package_verification_unavailable_"), F.col("registry")
    )
    usable = F.when(
        gone & (F.col("raw_specifier") == F.col("package_name")), replacement_candidates(F.col("similar"), F.col("package_name"))
    ).otherwise(F.array().cast("array<string>"))
    fixes = F.transform(
        usable,
        lambda name: F.struct(
            F.concat(F.lit("Replace with "), name).alias("description"),
            F.array(
                F.struct(
                    F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.col("end_line").alias("endLine"),
                    F.col("end_column").alias("endColumn"), name.alias("newText"),
                )
            ).alias("edits"),
        ),
    )
    rows = rows.withColumn("detection_rule", rule).withColumn("_fixes", fixes)
    return rows.select(
        tx.stable_id(F.col("file"), F.col("detection_rule"), F.col("line"), F.col("column"), F.col("package_name")).alias("id"),
        F.when(gone, "hallucinated_package").otherwise("other").alias("type"),
        F.when(gone, "critical").otherwise("medium").alias("severity"),
        F.when(gone, F.concat(quoted, F.lit(" does not exist in "), F.col("registry"), F.lit(".")))
        .otherwise(F.concat(quoted, F.lit(" could not be verified in "), F.col("registry"), F.lit(".")))
        .alias("message"),
        "file",
        "line",
        "column",
        "end_line",
        "end_column",
        F.col("package_name").alias("evidence"),
        F.when(gone, advice).otherwise(F.concat_ws(" ", F.lit(_UNVERIFIED), F.col("detail"), F.lit(_CHECK))).alias("suggestion"),
        F.get("_fixes", F.lit(0)).cast(schema.FIX).alias("fix"),
        F.when(F.size("_fixes") > 1, F.expr("slice(_fixes, 2, size(_fixes))")).cast(f"array<{schema.FIX}>").alias("alternative_fixes"),
        F.lit("L1").alias("detection_layer"),
        "detection_rule",
        F.lit(now).cast("bigint").alias("timestamp"),
        F.lit(False).alias("dismissed"),
        F.lit(None).cast("string").alias("dismissed_reason"),
        F.lit(3).alias("_detector"),
        F.struct(F.lit(0).alias("rule"), F.col("line").alias("start")).alias("_order"),
    )
