"""Fix planning against all pairs."""

import random

from sparkwarden import schema
from sparkwarden.operators.detect import scan_catalogue, scan_secrets
from sparkwarden.operators.fixes import plan_fixes, verify_fix

SEVERITIES = ["critical", "high", "medium", "low", "info"]


def overlap(a, b):
    return a[0] < b[1] and b[0] < a[1]


def test_plans_equal_the_plain_walk(spark):
    rng = random.Random(6)
    rows, plain = [], {}
    for i in range(300):
        edits = []
        for _ in range(rng.randint(0, 2)):
            line, column = rng.randint(1, 4), rng.randint(0, 20)
            edits.append((line, column, line + rng.randint(0, 1), rng.randint(1, 25), "x"))
        rows.append((f"f{i % 3}", f"id{i:03}", edits[0][0] if edits else 1, rng.randint(1, 30), rng.choice(SEVERITIES),
                     rng.choice(["L1", "L2", "L3"]), rng.random() < 0.1, ("d", edits) if edits else None))
    ddl = f"file string, id string, line int, column int, severity string, detection_layer string, dismissed boolean, fix {schema.FIX}"
    for file in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == file and not r[6] and r[7]]
        taken = []
        for r in sorted((r for r in own if r[5] != "L3"), key=lambda r: (SEVERITIES.index(r[4]), r[2], r[3], r[1])):
            spans = [((e[0], e[1]), (e[2], e[3])) for e in r[7][1]]
            sound = all(s[0] >= 1 and s[1] >= 1 and s <= e for s, e in spans)
            good = sound and all(not overlap(s, t) for s in spans for t in taken)
            plain[r[1]] = "safe" if good else "skipped"
            taken += spans if good else []
        plain |= {r[1]: "excluded" for r in own if r[5] == "L3"}
    assert {r["id"]: r["outcome"] for r in plan_fixes(spark.createDataFrame(rows, ddl)).collect()} == plain


def test_plan_of_one_large_file_uses_no_python_and_few_rounds(spark):
    """A chain of overlaps in rank order: every other fix is taken, decided from its start on."""
    rows = [("f", f"id{i:05}", 1, i + 1, "high", "L1", False, ("d", [(1, 10 * i + 1, 1, 10 * i + 12, "x")])) for i in range(12)]
    rows += [("f", f"x{i:05}", 2 + i, 1, "low", "L1", False, ("d", [(2 + i, 1, 2 + i, 5, "x")])) for i in range(3000)]
    ddl = f"file string, id string, line int, column int, severity string, detection_layer string, dismissed boolean, fix {schema.FIX}"
    out = plan_fixes(spark.createDataFrame(rows, ddl))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["outcome"] for r in out.collect()}
    assert len(got) == len(rows)
    assert all(got[f"id{i:05}"] == ("safe" if i % 2 == 0 else "skipped") for i in range(12)) and all(got[f"x{i:05}"] == "safe" for i in range(3000))


def test_secret_fixes_are_made_and_verified(spark):
    ddl = "file string, text string, language string"
    before = [("a.py", "x = 1\napiToken = 'mF9qT2vL8zP4xR7cN1bY'\n", None), ("b.ts", 'const dbPassword = "hunter2hunter";', None),
              ("c.yml", 'password: "hunter2hunter"', None), ("d.py", "authToken = 'Bearer mF9qT2vL8zP4xR7cN1bY'", None)]
    found = scan_secrets(spark.createDataFrame(before, ddl), 0)
    fixes = {r["file"]: r["fix"] and r["fix"]["edits"][0]["newText"] for r in found.collect()}
    assert fixes == {"a.py": 'apiToken = os.getenv("API_TOKEN", "")', "b.ts": 'dbPassword = process.env.DB_PASSWORD ?? ""', "c.yml": None, "d.py": None}
    assert {r["file"]: r["fix"] and r["fix"]["edits"][0]["newText"] for r in scan_catalogue(spark.createDataFrame(before, ddl), 0).collect()
            if r["type"] == "hardcoded_secret"} == fixes
    after = [("a.py", before[0][1] + "y = 2\n", None), ("b.ts", "\n" + before[1][1], None), *before[2:]]
    valid = {r["file"]: r["still_valid"] for r in verify_fix(found, scan_secrets(spark.createDataFrame(after, ddl), 0)).collect()}
    assert valid == {"a.py": True, "b.ts": False, "c.yml": False, "d.py": False}
