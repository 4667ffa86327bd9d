"""The whole corpus scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import scan_catalogue
from ..operators.endpoints import scan_endpoints
from ..operators.findings import apply_ignore_rules, apply_ignored_ids, dedup_existing_tools, unique_findings
from ..operators.packages import missing_packages, seed_table, similar_packages, verify
from ..operators.references import extract_references
from ..rules import Rule
from ..session import ensure_checkpoint_dir


@dataclass(frozen=True)
class ScanOptions:
    layers: Sequence[str] = ("L1", "L2")
    custom_rules: Sequence[Rule] = ()
    packages: str = "seed"  # off, seed or remote
    index: DataFrame | None = None
    coverage: DataFrame | None = None
    cache: DataFrame | None = None
    ignore_rules: Sequence[Mapping] = field(default_factory=tuple)
    ignored_ids: DataFrame | None = None
    dedup_with_existing_tools: bool = True


def scan_packages(corpus: DataFrame, now: int, options: ScanOptions) -> DataFrame:
    """Findings for references to packages that do not exist."""
    spark = corpus.sparkSession
    empty = lambda ddl: spark.createDataFrame([], ddl)
    index = options.index if options.index is not None else empty("registry string, package_name string")
    coverage = options.coverage if options.coverage is not None else empty("registry string, coverage string")
    cache = options.cache if options.cache is not None else empty("registry string, package_name string, exists boolean, last_verified bigint")
    ensure_checkpoint_dir(spark)
    references, seed = extract_references(corpus).checkpoint(), seed_table(spark)
    resolved = verify(references, index, coverage, cache, now, seed=seed)
    gone = resolved.filter(~F.col("exists"))
    return missing_packages(references, resolved, similar_packages(gone, index, seed), now, options.packages == "remote")


def scan_corpus(corpus: DataFrame, now: int, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Detection, then removal of duplicates and suppression, in that order.

    The text rules of layers 1 and 2 and all custom rules share one scan of the corpus.
    """
    found = scan_catalogue(corpus, now, options.layers, options.custom_rules)
    if "L1" in options.layers and options.packages != "off":
        found = found.unionByName(scan_packages(corpus, now, options))
    if "L3" in options.layers:
        found = found.unionByName(scan_endpoints(corpus, now))
    if options.dedup_with_existing_tools and "L2" in options.layers:
        found = dedup_existing_tools(found, corpus)
    unique = unique_findings(found, ["_detector", "_order", "id"]).drop("_detector", "_order")
    ignored = apply_ignore_rules(unique, options.ignore_rules)
    return ignored if options.ignored_ids is None else apply_ignored_ids(ignored, options.ignored_ids)
