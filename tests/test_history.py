"""History reports on a two-day history with known numbers."""

from datetime import datetime, timezone

import pytest

from sparkwarden.operators import history as hi
from sparkwarden.operators import intervals as iv
from sparkwarden.operators import retention as rt
from sparkwarden.sources import history_store as hs

DAY1 = int(datetime(2026, 1, 1, 12, tzinfo=timezone.utc).timestamp() * 1000)
DAY2 = DAY1 + 86_400_000


@pytest.fixture(scope="module")
def history(spark):
    runs = spark.createDataFrame(
        [("one", DAY1 - 100, DAY1, None, "/w", ["a"], 1), ("two", DAY2 - 100, DAY2, None, "/w", ["b"], 1)],
        "scan_id string, started_at bigint, completed_at bigint, project string, cwd string, target_paths array<string>, file_count int",
    )
    sql, secret = ("sql_injection", "high", "sast_sql"), ("hardcoded_secret", "critical", "secret_key")
    row = lambda scan, id, kind, who, dismissed=False, reason=None: (
        scan, id, *kind, "f.ts", 1, 1, dismissed, reason, who, f"{who.split()[0].lower()}@example.com"
    )
    findings = spark.createDataFrame(
        [
            row("one", "old_sql", sql, "Ada L"), row("one", "old_secret", secret, "Ada L"), row("two", "new_sql", sql, "Grace H"),
            row("two", "gone_sql", sql, "Grace H", True, "false_positive: covered elsewhere"), row("two", "gone_secret", secret, "Ada L", True, ""),
            row("two", "new_xss", ("xss", "medium", "sast_html"), "Grace H"),
        ],
        "scan_id string, finding_id string, type string, severity string, detection_rule string, file_path string, line int, column int, "
        "dismissed boolean, dismissed_reason string, author_name string, author_email string",
    )
    return hi.History(runs, findings)


def test_totals_and_rates(history):
    stats = hi.history_stats(history).first()
    assert (stats.scan_count, stats.finding_count, stats.active_count, stats.dismissed_count, stats.latest_scan_at) == (2, 6, 4, 2, DAY2)
    rules = hi.top_rules(history, 2).collect()
    assert len(rules) == 2 and (rules[0].key, rules[0].count_ if hasattr(rules[0], "count_") else rules[0]["count"]) == ("sast_sql", 3)
    assert [(r.key, r.false_positive_rate) for r in hi.false_positive_rules(history).collect()] == [("sast_sql", 1 / 3)]
    authors = {r.name: (r.active_count, r.high_risk_count, r.high_risk_rate) for r in hi.author_risk(history).collect()}
    assert authors == {"Ada L": (2, 2, 1.0), "Grace H": (2, 1, 0.5)}
    assert [r.key for r in hi.dismissal_reasons(history).collect()] == ["false_positive: covered elsewhere", "unspecified"]
    assert [str(r.date) for r in hi.daily_trend(history).collect()] == ["2026-01-01", "2026-01-02"]


def test_delta_and_scope(history):
    d = hi.latest_scan_delta(history).first()
    assert (d.previous_scan_id, d.current_scan_id, d.introduced_count, d.resolved_count, d.persistent_count) == ("one", "two", 2, 2, 0)
    assert hi.latest_scan_delta(history, since=DAY2 - 1).count() == 0
    assert hi.history_stats(history, since=DAY2 - 1).first().finding_count == 4


def test_store_round_trip(spark, history, tmp_path):
    hs.write_history(history, str(tmp_path))
    back = hs.read_history(spark, str(tmp_path))
    assert hi.history_stats(back).first() == hi.history_stats(history).first()


def test_budget_equals_a_plain_running_sum(spark):
    import random

    import pytest

    rng = random.Random(2)
    rows = [(i % 3, rng.choice([0, 59_999, 60_000, 90_000_000, 180_000_001]) + rng.randrange(3) * 1000, f"r{i:04}", rng.choice([0, 1, 5, 40])) for i in range(600)]
    df = spark.createDataFrame(rows, "tier int, at bigint, id string, bytes bigint")
    order = sorted(rows, key=lambda r: (r[2] != "r0000", -r[0], -r[1], [-ord(c) for c in r[2]]))
    for budget in (0, 37, 900, 10**9):
        want, total = {}, 0
        for tier, at, id, size in order:
            total += size
            if total <= budget or id == "r0000":
                want[id] = total
        if rows[0][3] <= budget:
            assert {r["id"]: r["running_bytes"] for r in rt.prune_to_budget(df, budget, "r0000").collect()} == want
    with pytest.raises(Exception, match="alone exceeds"):
        rt.prune_to_budget(df.withColumn("bytes", df["bytes"] + 50), 37, "r0000").collect()


def test_interval_joins_handle_wide_and_touching_ranges(spark):
    import random

    rng = random.Random(3)
    left = [("f", s, s + rng.choice([0, 3, 90, 5000, 400000])) for s in (rng.randrange(1, 500000) for _ in range(120))]
    right = [("f", s, s + rng.choice([0, 1, 70, 3000, 200000])) for s in (rng.randrange(1, 500000) for _ in range(40))]
    a = spark.createDataFrame(left, "file string, s bigint, e bigint")
    b = spark.createDataFrame(right, "file string, x bigint, y bigint")
    got = {(r.s, r.e) for r in iv.overlapping(a, b, ["file"], ("s", "e"), ("x", "y")).collect()}
    assert got == {(s, e) for _, s, e in left if any(x <= e and y >= s for _, x, y in right)}


def test_a_protected_record_beyond_the_budget_is_kept_alone_if_asked(spark):
    rows = [(0, 1_000, "big", 90), (0, 2_000, "new", 1), (2, 3_000, "bucket", 1)]
    df = spark.createDataFrame(rows, "tier int, at bigint, id string, bytes bigint")
    kept = rt.prune_to_budget(df, 50, "big", strict=False).collect()
    assert [(r.id, r.running_bytes, r.protected) for r in kept] == [("big", 90, True)]


def test_interval_joins_broadcast_nothing(spark):
    """Estimates miss the rows that exploding adds, so a small side may be many times its estimate."""
    points = spark.createDataFrame([("f", 3), ("f", 9)], "file string, line int")
    ranges = spark.createDataFrame([("f", 1, 5)], "file string, start int, end int")
    met = iv.points_in_intervals(points, ranges, ["file"], "line", "start", "end")
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert [(r.line, r.start, r.end) for r in met.collect()] == [(3, 1, 5)]
