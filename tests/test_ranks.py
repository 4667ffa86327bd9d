"""Row numbers with carried offsets against plain numbering."""

import random

import pytest

from sparkwarden.operators.ranks import numbered

ROWS = "k string, v long, t string"


def plain(rows):
    out, seen = [], {}
    for place, (k, v, t) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))):
        out.append((k, v, t, seen.get(k, 0), place))
        seen[k] = seen.get(k, 0) + 1
    return [(*r[:4], seen[r[0]], r[4]) for r in out]


@pytest.mark.parametrize("tasks", ["1", "7"])
def test_numbers_of_a_hot_key_equal_plain_numbering(spark, tasks):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "", None, f"k{i}"]), rng.randrange(10**6) * 1000 + i, "x") for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbered(spark.createDataFrame(rows, ROWS), ["k"], ["v"], "n", "all", "place")
        assert out.columns == ["k", "v", "t", "n", "all", "place"]
        assert sorted(map(tuple, out.collect()), key=lambda r: r[-1]) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbers_without_a_key_with_ties_and_of_nothing(spark):
    same = spark.createDataFrame([("a", 1, "x")] * 20 + [(None, None, None)], ROWS)
    assert sorted(r["n"] for r in numbered(same, [], ["v"], "n").collect()) == list(range(21))
    assert sorted(r["n"] for r in numbered(same, ["k", "t"], ["v"], "n").collect()) == [0, *range(20)]
    assert numbered(same.limit(0), ["k"], ["v"], "n", "all", "place").count() == 0


def test_no_window_stands_over_the_rows_of_a_key(spark):
    df = numbered(spark.range(1000).selectExpr("id % 3 AS k", "id AS v"), ["k"], ["v"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")  # windows see counts only
