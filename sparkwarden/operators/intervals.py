"""Line-range algebra: interval joins without cross joins, merging and change attribution.

An interval is filed under blocks of lines. Wide intervals use wider blocks, so no interval is filed more than 17 times,
and a point probes one block per width. Both sides then meet in an equi-join on (key, width, block), which splits the
lines of one very large file over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WIDTHS = [64 * 16**i for i in range(6)]


def _blocks(start: Column, end: Column) -> Column:
    widths = F.array(*[F.lit(w).cast("bigint") for w in _WIDTHS])
    level = F.size(F.filter(F.slice(widths, 1, len(_WIDTHS) - 1), lambda w: end - start >= w * 16))
    width = F.get(widths, level)
    return F.transform(
        F.sequence(F.floor(start / width), F.floor(end / width)),
        lambda b: F.struct(level.alias("level"), b.cast("bigint").alias("block")),
    )


def _probes(point: Column) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("level"), F.floor(point / F.lit(w)).cast("bigint").alias("block"))
            for i, w in enumerate(_WIDTHS)
        ]
    )


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str
) -> DataFrame:
    """Inner join: every pair with equal ``keys`` and ``start <= point <= end``. Each pair appears once.

    Spark's size estimates miss the rows that exploding adds, so a side that looks small could be broadcast at many times its
    estimate; the merge join keeps both sides off the driver.
    """
    keys = list(keys)
    p = points.withColumn("_probe", F.explode(_probes(F.col(point))))
    i = intervals.filter(F.col(start) <= F.col(end)).withColumn(
        "_probe", F.explode(_blocks(F.col(start), F.col(end)))
    )
    joined = p.hint("merge").join(i, [*keys, "_probe"])
    return joined.filter(F.col(point).between(F.col(start), F.col(end))).drop("_probe")


def overlapping(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str]
) -> DataFrame:
    """Distinct left (keys, start, end) that share a point with some right interval; ends are inclusive.

    Two intervals meet exactly when one of them starts inside the other.
    """
    keys, (ls, le), (rs, re) = list(keys), left_span, right_span
    a = left.select(*keys, F.col(ls).cast("bigint").alias(ls), F.col(le).cast("bigint").alias(le)).filter(F.col(ls) <= F.col(le)).distinct()
    b = right.select(*keys, F.col(rs).cast("bigint").alias("_rs"), F.col(re).cast("bigint").alias("_re")).filter("_rs <= _re").distinct()
    left_starts_inside = points_in_intervals(a, b, keys, ls, "_rs", "_re").select(*keys, ls, le)
    right_starts_inside = points_in_intervals(b.select(*keys, "_rs").distinct(), a, keys, "_rs", ls, le).select(*keys, ls, le)
    return left_starts_inside.union(right_starts_inside).distinct()


def merge_ranges(ranges: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Union of overlapping or adjacent inclusive ranges per key.

    Ranges with one start collapse before the window, so the window sees at most one row per line of a file.
    """
    keys = list(keys)
    compact = ranges.groupBy(*keys, "start_line").agg(F.max("end_line").alias("end_line"))
    by_start = Window.partitionBy(*keys).orderBy("start_line")
    reach = F.max("end_line").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("start_line") > reach + 1), 1).otherwise(0)
    island = F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        compact.withColumn("_new", begins)
        .withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
        .drop("_island")
    )


def lines_to_ranges(lines: DataFrame, keys: Sequence[str] = ("file",), line: str = "line") -> DataFrame:
    """Consecutive runs of the distinct line numbers of each key."""
    keys = list(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(line))
    return (
        lines.select(*keys, line)
        .distinct()
        .withColumn("_run", F.col(line) - rank)
        .groupBy(*keys, "_run")
        .agg(F.min(line).alias("start_line"), F.max(line).alias("end_line"))
        .drop("_run")
    )


# Hunk header, and the author and message marks of assisted commits.
HUNK = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
AI_AUTHOR = r"(?i)(?:github-actions\[bot]|cursor-bot|claude\[bot]|copilot|anthropic|openai|chatgpt|gpt|cursor)"
AI_MESSAGES = [
    r"(?i)co-authored-by:.*(?:copilot|cursor|claude|openai|chatgpt|gpt|anthropic)",
    r"(?i)\b(?:generated|created|written|authored)\s+by\s+(?:ai|copilot|cursor|claude|openai|chatgpt|gpt)\b",
    r"(?i)\b(?:copilot|cursor|claude|openai|chatgpt|gpt)\b.*\b(?:generated|created|wrote|authored)\b",
    r"(?i)\bai[- ]generated\b",
]
WHOLE_CHANGE_LINES = 50


def parse_hunks(diffs: DataFrame) -> DataFrame:
    """Added line ranges of unified diffs ``(file, diff)``, merged per file."""
    header = "(?m)^" + HUNK
    hunks = diffs.select(
        "file",
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all("diff", F.lit(header), F.lit(1)).alias("start"),
                F.regexp_extract_all("diff", F.lit(header), F.lit(2)).alias("count"),
            )
        ).alias("h"),
    ).select(
        "file",
        F.col("h.start").cast("int").alias("start_line"),
        F.when(F.col("h.count") == "", 1).otherwise(F.col("h.count").try_cast("int")).alias("_count"),
    )
    return merge_ranges(
        hunks.filter((F.col("start_line") > 0) & (F.col("_count") > 0)).select(
            "file", "start_line", (F.col("start_line") + F.col("_count") - 1).alias("end_line")
        )
    )


def is_ai_commit(mode: str, name: Column, email: Column, message: Column) -> Column:
    """Whether a commit looks machine-written, by ``author``, by ``message`` or by either (``aggressive``)."""
    author = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(email, F.lit(""))).rlike(AI_AUTHOR)
    text = F.coalesce(message, F.lit(""))
    from ..functions.text import java_regex

    worded = F.lit(False)
    for pattern in AI_MESSAGES:
        worded = worded | text.rlike(java_regex(pattern))
    return {"author": author, "message": worded, "aggressive": author | worded}[mode]


def ai_line_ranges(diffs: DataFrame, blame: DataFrame, commits: DataFrame, mode: str) -> DataFrame:
    """Changed lines of each file that an assisted commit wrote, as ranges.

    ``blame(file, line, hash, author_name, author_email)`` and ``commits(hash, message)``. In aggressive mode a file with
    at least 50 changed lines counts as a whole.
    """
    changed = parse_hunks(diffs)
    whole = None
    if mode == "aggressive":
        large = (
            changed.groupBy("file")
            .agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("n"))
            .filter(F.col("n") >= WHOLE_CHANGE_LINES)
            .select("file")
        )
        whole = changed.join(large, "file", "left_semi")
        changed = changed.join(large, "file", "left_anti")
    touched = points_in_intervals(blame, changed, ["file"], "line", "start_line", "end_line")
    facts = touched.join(commits.select("hash", "message"), "hash", "left")
    lines = facts.filter(is_ai_commit(mode, F.col("author_name"), F.col("author_email"), F.col("message")))
    ranges = lines_to_ranges(lines.select("file", "line"))
    return ranges if whole is None else ranges.unionByName(whole)


def filter_to_ranges(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings that touch a listed range of their file; files without any listed range keep all of theirs."""
    spans = findings.withColumn("_from", F.col("line").cast("bigint")).withColumn(
        "_to", F.greatest(F.col("line"), F.coalesce(F.col("end_line"), F.col("line"))).cast("bigint")
    )
    listed = ranges.select("file").distinct()
    hits = overlapping(spans, merge_ranges(ranges.select("file", "start_line", "end_line")), ["file"], ("_from", "_to"), ("start_line", "end_line"))
    kept = spans.join(hits, ["file", "_from", "_to"], "left_semi")
    unlisted = spans.join(listed, "file", "left_anti")
    return kept.unionByName(unlisted).drop("_from", "_to")
