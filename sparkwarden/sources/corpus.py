"""Corpora: file trees and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, extension

# What counts as source text and which folders are skipped.
EXTENSIONS = [
    "js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "rs", "go", "java", "kt", "kts", "json", "toml", "xml", "gradle",
    "sh", "bash", "zsh", "ps1", "yml", "yaml", "txt",
]
FILE_NAMES = [
    "package.json", "requirements.txt", "pyproject.toml", "cargo.toml", "go.mod", "pom.xml", "build.gradle",
    "build.gradle.kts", "dockerfile",
]
SKIPPED_FOLDERS = ["node_modules", ".git", "out", "dist", "build", "coverage", ".vscode-test"]


def is_source_path(path):
    """Supported file outside the skipped folders. ``path`` is relative to the scanned root."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))
    return ~skipped & (F.lower(basename(path)).isin(FILE_NAMES) | extension(path).isin(EXTENSIONS))


def _any_case(name: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)


NAME_GLOB = "{" + ",".join([f"*.{_any_case(e)}" for e in EXTENSIONS] + [_any_case(n) for n in FILE_NAMES]) + "}"


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Every supported file below ``root`` as ``(file, text, language)``; ``file`` is the path below the root.

    Names are matched while files are listed, so images, archives and other files are never opened. Files of skipped folders
    with a source name are opened and dropped by their path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", NAME_GLOB).load(root)
    base = root.rstrip("/").split("://")[-1]
    relative = F.substring_index(F.col("path"), base + "/", -1)
    return (
        files.select(relative.alias("file"), "content")
        .filter(is_source_path(F.col("file")))
        .select("file", F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("string").alias("language"))
    )


def corpus_from_table(df: DataFrame, id: str, text: str, language: str | None = None) -> DataFrame:
    """Any table with a text column as a corpus."""
    lang = F.col(language) if language else F.lit(None)
    return df.select(F.col(id).cast("string").alias("file"), F.col(text).alias("text"), lang.cast("string").alias("language"))
