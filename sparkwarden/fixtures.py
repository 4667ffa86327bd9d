"""Adapters that give the operators something to work on at every scale factor: views over the driver's tables.

They are bindings for queries, benchmarks and tests, not part of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.history import History

DAY_MS = 86_400_000
EMPTY_RUN_MS = 1_707_955_200_000  # 2024-02-15, a day without findings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. ``spark.sparkwarden.inputPartitions`` (set by the local sessions, whose tables are single row groups that
    cannot be split) spreads its rows; without it the splits of the files stand."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("spark.sparkwarden.inputPartitions", None)
    if spread and name in ("documents", "pages", "events", "conversations"):
        return df.repartition(int(spread))
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` if its files give fewer splits than there are cores; for narrow rows that much work is made of."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, key) if df.rdd.getNumPartitions() < cores else df


def event_ms() -> Column:
    return F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``k`` and epoch milliseconds ``ms``."""
    df = table(spark, sf_dir, "events")
    return df.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("ms", event_ms())


def _pick(key: Column, *pairs: tuple) -> Column:
    out = F.lit(None)
    for value, result in reversed(pairs):
        out = F.when(key == value, F.lit(result)).otherwise(out)
    return out


SEVERITY = [("error", "critical"), ("purchase", "high"), ("click", "medium"), ("view", "low"), ("signup", "info")]
TYPE = [
    ("error", "hardcoded_secret"),
    ("purchase", "sql_injection"),
    ("click", "xss"),
    ("view", "insecure_config"),
    ("signup", "missing_security_measure"),
]


def history(spark: SparkSession, sf_dir: str) -> History:
    """Scan runs and stored findings derived from ``events``: one run per project and day."""
    e = events(spark, sf_dir)
    user, kind, k = F.col("user_id"), F.col("event_type"), F.col("k")
    project = F.when(user % 5 != 0, F.concat(F.lit("p"), (user % 5).cast("string")))
    rows = e.withColumn("project", project).withColumn(
        "scan_id", F.concat_ws("_", F.coalesce("project", F.lit("none")), F.col("ts").cast("date").cast("string"))
    )
    runs = (
        rows.groupBy("scan_id", "project")
        .agg(
            F.min("ms").alias("started_at"),
            F.max("ms").alias("completed_at"),
            F.countDistinct(user % 20).cast("int").alias("file_count"),
        )
        .select("scan_id", "started_at", "completed_at", "project", "file_count")
    )
    empty = spark.range(5).select(
        F.concat(F.when(F.col("id") == 0, F.lit("none")).otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))), F.lit("_2024-02-15")).alias("scan_id"),
        F.lit(EMPTY_RUN_MS).alias("started_at"),
        F.lit(EMPTY_RUN_MS).alias("completed_at"),
        F.when(F.col("id") > 0, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("project"),
        F.lit(0).alias("file_count"),
    )
    runs = (
        runs.unionByName(empty)
        .withColumn("cwd", F.lit("/work"))
        .withColumn("target_paths", F.array(F.lit("src")))
    )
    first = (
        rows.withColumn("finding_id", F.concat_ws("_", kind, user.cast("string")))
        .groupBy("scan_id", "finding_id")
        .agg(F.min(F.struct("event_id", "user_id", "event_type", "value", "k", "ms")).alias("e"))
        .select("scan_id", "finding_id", "e.*")
    )
    dismissed = F.col("value") < 100
    number = lambda m: (F.col("user_id") % m).cast("string")
    findings = first.select(
        "scan_id",
        "finding_id",
        _pick(kind, *TYPE).alias("type"),
        _pick(kind, *SEVERITY).alias("severity"),
        F.concat(F.lit("Finding "), kind).alias("message"),
        F.concat(F.lit("src/f"), number(20), F.lit(".py")).alias("file_path"),
        (k + 1).cast("int").alias("line"),
        (F.col("event_id") % 80 + 1).cast("int").alias("column"),
        F.concat(kind, F.lit("("), k.cast("string"), F.lit(")")).alias("evidence"),
        F.lit("Review it.").alias("suggestion"),
        _pick(user % 3, (0, "L1"), (1, "L2"), (2, "L3")).alias("detection_layer"),
        F.concat(F.lit("rule_"), kind, F.lit("_"), number(3)).alias("detection_rule"),
        F.col("ms").alias("timestamp"),
        dismissed.alias("dismissed"),
        F.when(
            dismissed,
            _pick(k % 4, (0, "False positive"), (1, "false_positive: reviewed"), (2, "Not an issue"), (3, "")),
        ).alias("dismissed_reason"),
        F.concat(F.lit("User "), number(10)).alias("author_name"),
        F.when(k % 10 != 0, F.concat(F.lit("U"), number(10), F.lit("@Example.com"))).alias("author_email"),
    )
    return History(runs, findings)


# The same views as DuckDB common table expressions.
E_SQL = """e AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS ms FROM events
)"""
H_SQL = (
    E_SQL
    + """,
rows_ AS (
  SELECT *, CASE WHEN user_id % 5 <> 0 THEN 'p' || (user_id % 5) END AS project,
         coalesce(CASE WHEN user_id % 5 <> 0 THEN 'p' || (user_id % 5) END, 'none') || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS scan_id
  FROM e
),
runs AS (
  SELECT scan_id, project, min(ms) AS started_at, max(ms) AS completed_at,
         CAST(count(DISTINCT user_id % 20) AS INT) AS file_count
  FROM rows_ GROUP BY scan_id, project
  UNION ALL
  SELECT (CASE WHEN i = 0 THEN 'none' ELSE 'p' || i END) || '_2024-02-15', CASE WHEN i > 0 THEN 'p' || i END,
         1707955200000, 1707955200000, 0
  FROM range(5) t(i)
),
first_ AS (
  SELECT * FROM (
    SELECT *, event_type || '_' || user_id AS finding_id,
           row_number() OVER (PARTITION BY scan_id, event_type || '_' || user_id ORDER BY event_id) AS rn
    FROM rows_) WHERE rn = 1
),
f AS (
  SELECT scan_id, finding_id,
    CASE event_type WHEN 'error' THEN 'hardcoded_secret' WHEN 'purchase' THEN 'sql_injection' WHEN 'click' THEN 'xss'
         WHEN 'view' THEN 'insecure_config' ELSE 'missing_security_measure' END AS type,
    CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium'
         WHEN 'view' THEN 'low' ELSE 'info' END AS severity,
    'Finding ' || event_type AS message,
    'src/f' || (user_id % 20) || '.py' AS file_path,
    k + 1 AS line, CAST(event_id % 80 + 1 AS INT) AS "column",
    event_type || '(' || k || ')' AS evidence, 'Review it.' AS suggestion,
    CASE user_id % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' ELSE 'L3' END AS detection_layer,
    'rule_' || event_type || '_' || (user_id % 3) AS detection_rule,
    ms AS "timestamp", value < 100 AS dismissed,
    CASE WHEN value < 100 THEN CASE k % 4 WHEN 0 THEN 'False positive' WHEN 1 THEN 'false_positive: reviewed'
         WHEN 2 THEN 'Not an issue' ELSE '' END END AS dismissed_reason,
    'User ' || (user_id % 10) AS author_name,
    CASE WHEN k % 10 <> 0 THEN 'U' || (user_id % 10) || '@Example.com' END AS author_email,
    user_id, event_id, k
  FROM first_
)"""
)


def findings_view(h: History) -> DataFrame:
    """Stored findings in the shape of finding records (one row per run and finding)."""
    return h.findings.select(
        F.concat_ws(":", "scan_id", "finding_id").alias("id"),
        "type",
        "severity",
        "message",
        F.col("file_path").alias("file"),
        "line",
        "column",
        F.col("line").alias("end_line"),
        (F.col("column") + 10).alias("end_column"),
        "evidence",
        "suggestion",
        "detection_layer",
        "detection_rule",
        "timestamp",
        "dismissed",
        "dismissed_reason",
        "scan_id",
    )


FINDINGS_SQL = (
    H_SQL
    + """,
fv AS (
  SELECT scan_id || ':' || finding_id AS id, type, severity, message, file_path AS file, line, "column",
         line AS end_line, "column" + 10 AS end_column, evidence, suggestion, detection_layer, detection_rule,
         "timestamp", dismissed, dismissed_reason, scan_id
  FROM f
)"""
)


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.corpus import corpus_from_table

    return corpus_from_table(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
