"""Row numbers within a key when one key may hold most of the rows.

A window over the key would put all rows of a hot key in one task. Here rows are dealt by ranges of (key, order), so that a hot
key is spread over as many tasks as its size asks for; each task then holds at most a few runs of equal keys, and only the counts
of these runs meet per key to carry offsets from task to task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_TASK_BITS = 33  # monotonically_increasing_id: task number above, row within the task below


def _same(names: list[str]) -> Column:
    on = F.lit(True)
    for name in names:
        on = on & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    return on


def numbered(
    df: DataFrame, keys: list[str], order: list[Column | str], number: str = "number", total: str | None = None, position: str | None = None
) -> DataFrame:
    """``df`` with ``number``: 0, 1, ... within equal ``keys`` by ``order``; on request ``total``, the rows of the key, and
    ``position``, the row's place in the whole table by (keys, order).

    Null keys are one key. Rows equal in ``order`` are numbered in any order, but each number occurs once. An empty table stays
    empty. The dealt rows are checkpointed, so numbers don't change when a task is repeated.
    """
    ensure_checkpoint_dir(df.sparkSession)
    by = [*keys, *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_task", F.shiftright("_at", _TASK_BITS)).checkpoint()
    runs = dealt.groupBy("_task", *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    of_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = of_key.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    if total:
        runs = runs.withColumn(total, F.sum("_rows").over(of_key))
    added = [total] if total else []
    runs = runs.select(*(F.col(c).alias(f"_of_{c}") for c in ("_task", *keys)), "_first", "_before", *added)
    place = (F.col("_before") + F.col("_at") - F.col("_first")).alias(number)
    out = dealt.join(runs, _same(["_task", *keys])).select(*df.columns, "_task", "_at", place, *added)
    if position:
        tasks = dealt.groupBy("_task").agg(F.count(F.lit(1)).alias("_rows"))  # one row per task, so one window holds them
        earlier = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
        tasks = tasks.select("_task", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
        place = F.col("_start") + F.col("_at").bitwiseAND((1 << _TASK_BITS) - 1)
        out = out.join(F.broadcast(tasks), "_task").withColumn(position, place).drop("_start")
    return out.drop("_task", "_at")
