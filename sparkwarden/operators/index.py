"""Maintenance of the package-name index and the resolution cache as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import index_key
from ..schema import REGISTRIES

DAY_MS = 24 * 60 * 60 * 1000
# How many names a light index holds.
LIGHT_LIMIT, LIGHT_LIMIT_CARGO = 100_000, 100


def normalized(names: DataFrame) -> DataFrame:
    """Distinct non-empty index keys of ``names(registry, package_name)``."""
    return names.select("registry", index_key(F.col("package_name")).alias("package_name")).filter("package_name <> ''").distinct()


def import_index(index: DataFrame, names: DataFrame, coverage: str) -> DataFrame:
    """Index after an import: a full import replaces the registries it names, a partial one adds to them."""
    new = normalized(names)
    if coverage == "full":
        index = index.join(names.select("registry").distinct(), "registry", "left_anti")
    return index.select("registry", "package_name").unionByName(new).distinct()


def write_index(index: DataFrame, path: str) -> None:
    """Replace only the registries present in ``index``."""
    index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("registry").parquet(path)


def apply_changes(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Index after a change feed ``(registry, package_name, deleted, seq)``: the last change of a name counts.

    A registry without any entry in the index is not created. The last change per raw name is found first, with map-side
    aggregation; where raw names share a key, deletion wins, as removals are applied after additions.
    """
    last = (
        changes.groupBy("registry", "package_name")
        .agg(F.max(F.struct("seq", "deleted")).alias("c"))
        .select("registry", index_key(F.col("package_name")).alias("package_name"), F.col("c.deleted").alias("deleted"))
        .filter("package_name <> ''")
        .groupBy("registry", "package_name")
        .agg(F.bool_or("deleted").alias("deleted"))
    )
    present = index.select("registry").distinct()
    known = last.join(present, "registry", "left_semi")
    kept = index.select("registry", "package_name").join(known.select("registry", "package_name"), ["registry", "package_name"], "left_anti")
    return kept.unionByName(known.filter(~F.col("deleted")).select("registry", "package_name"))


def merge_sync_metadata(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Metadata ``(registry, source_url, etag, last_modified, change_source_url, change_sequence)`` after a refresh: new
    values win, unset ones keep the old; another source URL replaces the whole row."""
    fields = ["source_url", "etag", "last_modified", "change_source_url", "change_sequence"]
    old = current.select("registry", *[F.col(c).alias(f"_{c}") for c in fields])
    replaced = (F.col("source_url") != F.col("_source_url")) & F.col("source_url").isNotNull()
    merged = incoming.join(old, "registry", "full_outer")
    return merged.select(
        "registry",
        *[F.when(F.coalesce(replaced, F.lit(False)), F.col(c)).otherwise(F.coalesce(F.col(c), F.col(f"_{c}"))).alias(c) for c in fields],
    )


def upsert_resolutions(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Cache after storing verified results: the newest per (registry, key) wins; open results are not stored."""
    columns = ["registry", "package_name", "exists", "source", "last_verified"]
    keyed = new.filter(F.col("exists").isNotNull()).withColumn("package_name", index_key(F.col("package_name")))
    both = cache.select(columns).withColumn("_new", F.lit(0)).unionByName(keyed.select(columns).withColumn("_new", F.lit(1)))
    newest = F.max(F.struct("_new", "last_verified", "exists", "source")).alias("r")
    return both.groupBy("registry", "package_name").agg(newest).select(
        "registry", "package_name", F.col("r.exists").alias("exists"), F.col("r.source").alias("source"), F.col("r.last_verified").alias("last_verified")
    )


def index_stats(registries: DataFrame, packages: DataFrame) -> DataFrame:
    """Registry rows with the number of names each holds; counting comes before the join."""
    counts = packages.groupBy("registry").agg(F.count("*").alias("package_count"))
    return registries.join(counts, "registry", "left").fillna(0, ["package_count"]).orderBy("registry")


def sync_plan(
    stats: DataFrame,
    configured: Sequence[str],
    now: int,
    interval: str = "daily",
    light: bool = True,
    force: bool = False,
    detected: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Which configured registries are due for a refresh, why, and how many names to take.

    Registries that the project uses come first. ``stats(registry, coverage, updated_at, package_count)``.
    """
    spark = stats.sparkSession
    chosen = [r for r in dict.fromkeys(configured) if r in REGISTRIES]
    order = [r for r in dict.fromkeys(detected) if r in chosen]
    order += [r for r in chosen if r not in order]
    wanted = spark.createDataFrame([(i, r) for i, r in enumerate(order)], "position int, registry string")
    span = 7 * DAY_MS if interval == "weekly" else DAY_MS
    age = F.greatest(F.lit(0), F.lit(now) - F.col("updated_at"))
    reason = (
        F.when(F.lit(force), "forced")
        .when(F.col("updated_at").isNull(), "missing")
        .when(F.lit(not light) & (F.col("coverage") != "full"), "partial-needs-full")
        .when(age >= span, "stale")
        .otherwise("fresh")
    )
    take = F.lit(limit) if limit is not None or not light else F.when(F.col("registry") == "cargo", LIGHT_LIMIT_CARGO).otherwise(LIGHT_LIMIT)
    return wanted.join(stats, "registry", "left").select(
        "position",
        "registry",
        reason.alias("reason"),
        (reason != "fresh").alias("due"),
        F.when(~F.lit(force) & F.col("updated_at").isNotNull(), age).alias("age_ms"),
        F.lit("partial" if light else "full").alias("requested_coverage"),
        take.cast("bigint").alias("name_limit"),
    )


def effective_coverage(requested: str, truncated: bool) -> str:
    return "full" if requested == "full" and not truncated else "partial"


def dedupe_names(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """First spelling of each name over all pages, in page order: ``pages(page, position, name, total)``.

    With a limit the earliest names are taken by a top-n, not by sorting everything. ``truncated`` says whether the limit
    or the registry's own total leaves names out.
    """
    trimmed = pages.withColumn("name", F.trim("name")).filter("name <> ''")
    at = F.struct("page", "position")
    unique = trimmed.groupBy(index_key(F.col("name")).alias("key")).agg(F.min(F.struct(at.alias("at"), "name")).alias("f"))
    rows = unique.select("key", F.col("f.name").alias("name"), F.col("f.at.page").alias("page"), F.col("f.at.position").alias("position"))
    total = pages.agg(F.max("total").alias("_total"))
    size = rows.agg(F.count("*").alias("_size"))
    taken = rows if limit is None else rows.orderBy("page", "position").limit(limit)
    count = F.col("_size") if limit is None else F.least(F.col("_size"), F.lit(limit))
    cut = (F.col("_size") > count) | (F.coalesce(F.col("_total"), F.lit(0)) > count)
    return taken.join(size.join(total, F.lit(True)), F.lit(True)).select("name", "key", "page", "position", cut.alias("truncated"))
