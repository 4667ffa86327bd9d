"""Reading and appending the findings history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utc_day
from ..operators.history import History, clamp, per_scan


def run_report(h: History) -> DataFrame:
    """Run table with the number of findings of each run: all, active and dismissed."""
    return per_scan(h).drop("high_risk_count")


def write_history(h: History, path: str) -> None:
    """Append runs and findings as Parquet, partitioned by the UTC day on which the run completed."""
    day = utc_day(F.col("completed_at"))
    run_report(h).withColumn("day", day).write.mode("append").partitionBy("day").parquet(f"{path}/scan_run")
    days = h.runs.select("scan_id", day.alias("day"))
    # Sort by day inside each task: one open file per task instead of one per day.
    h.findings.join(days, "scan_id").sortWithinPartitions("day").write.mode("append").partitionBy("day").parquet(
        f"{path}/finding_result"
    )


def read_history(spark: SparkSession, path: str) -> History:
    return History(spark.read.parquet(f"{path}/scan_run"), spark.read.parquet(f"{path}/finding_result"))


def list_findings(h: History, limit: int | None = None, include_dismissed: bool = False, project: str | None = None) -> DataFrame:
    """Newest findings first, then by place."""
    scoped = h.scoped(project=project)
    rows = scoped.findings if include_dismissed else scoped.findings.filter(~F.col("dismissed"))
    joined = rows.join(scoped.runs.select("scan_id", F.col("completed_at").alias("scan_completed_at"), "project"), "scan_id")
    order = [F.desc("scan_completed_at"), "file_path", "line", "column", "scan_id", "finding_id"]
    return joined.orderBy(*order).limit(clamp(limit, 50, 1000))


def list_scan_runs(h: History, limit: int | None = None, project: str | None = None) -> DataFrame:
    runs = h.runs if project is None else h.runs.filter(F.col("project") == project)
    newest = runs.orderBy(F.desc("completed_at"), F.desc("scan_id")).limit(clamp(limit, 20, 1000))
    # Only the listed runs meet the findings.
    chosen = h.findings.join(newest.select("scan_id"), "scan_id", "left_semi")
    return run_report(History(newest, chosen)).orderBy(F.desc("completed_at"), F.desc("scan_id"))


def list_audit_events(audit: DataFrame, since: int | None = None, limit: int | None = None) -> DataFrame:
    rows = audit if since is None else audit.filter(F.col("occurred_at") >= since)
    return rows.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(clamp(limit, 100, 1000))
