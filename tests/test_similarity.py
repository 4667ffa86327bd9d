"""Similar-name search against a direct evaluation of every pair on a small word list."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkwarden.operators import edits
from sparkwarden.operators import similarity as sim


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def last_part(s):
    parts = [p for p in re.split("[/:]", s) if p]
    return parts[-1] if parts else s


def direct(query, names, k):
    q = query.strip().lower().replace("_", "-")
    ql = last_part(q)
    out = []
    for name in names:
        c = name.strip().lower().replace("_", "-")
        cl = last_part(c)
        if not c or c == q:
            continue
        full, leaf = edit_distance(q, c), edit_distance(ql, cl)
        d, ml, mf = min(full, leaf), max(len(ql), len(cl)), max(len(q), len(c))
        inside = q in c or c in q or ql in cl or cl in ql
        if not (d <= max(2, int(ml * 0.35)) or full <= max(3, int(mf * 0.28)) or inside):
            continue
        prefixed = c.startswith(q[:3]) or cl.startswith(ql[:3])
        score = d / max(1, ml) + full / max(1, mf) + (-0.35 if inside else 0.0) + (-0.15 if prefixed else 0.0)
        out.append((score, d, name))
    return [n for _, _, n in sorted(out)[:k]]


def words(n, seed):
    rng = random.Random(seed)
    parts = ["re", "act", "ex", "press", "rate", "limit", "auth", "js", "on", "web", "tok", "en", "x", "lo", "dash", "q"]
    out = set()
    while len(out) < n:
        w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.3:
            w = w[: len(w) // 2] + rng.choice("-_") + w[len(w) // 2 :]
        if rng.random() < 0.2:
            w = "@" + rng.choice(["ng", "types"]) + "/" + w
        if rng.random() < 0.1:
            w = "org.x:" + w
        out.add(w)
    return sorted(out)


def test_top_k_equals_direct_evaluation(spark):
    names, queries = words(600, 1), words(60, 2) + ["a", "zz", "requestsx", "@ng/reactt", "a-very-long-package-name-for-rate-limit"]
    index = spark.createDataFrame([("npm", n) for n in names], "registry string, package_name string")
    missing = spark.createDataFrame([("npm", n) for n in queries], "registry string, package_name string")
    got = {}
    for r in sim.suggest_names(missing, index, 5).orderBy("package_name", "rank").collect():
        got.setdefault(r.package_name, []).append(r.candidate)
    want = {q: direct(q, names, 5) for q in queries}
    assert got == {q: v for q, v in want.items() if v}


def test_registries_do_not_mix(spark):
    index = spark.createDataFrame([("npm", "express"), ("pypi", "expresso")], "registry string, package_name string")
    missing = spark.createDataFrame([("npm", "expresss")], "registry string, package_name string")
    rows = sim.suggest_names(missing, index, 5).select("registry", "candidate").collect()
    assert [(r.registry, r.candidate) for r in rows] == [("npm", "express")]


def test_a_settled_name_leaves_the_wide_round(spark, monkeypatch):
    near_by = ["abcdefgklm", "abcdefgnop", "abcdefgqrs", "abcdefguvw", "abcdefgxyz"]
    index = spark.createDataFrame([("npm", n) for n in [*near_by, "zyxdefghij"]], "registry string, package_name string")
    missing = spark.createDataFrame([("npm", "abcdefghij")], "registry string, package_name string")
    wide, near = [], sim.near_pairs
    monkeypatch.setattr(sim, "near_pairs", lambda *a, **b: wide.append((a[2], near(*a, **b))) or wide[-1][1])
    rows = sim.suggest_names(missing, index, 5).orderBy("rank").collect()
    assert [r.candidate for r in rows] == near_by == direct("abcdefghij", [*near_by, "zyxdefghij"], 5)
    assert sum(pairs.count() for limit, pairs in wide if limit == sim.PLAUSIBLE) == 0


def test_blocks_give_all_pairs_within_the_limit():
    rng = random.Random(3)
    for m, n in ((1, 1), (1, 5), (5, 4), (10, 12), (31, 33), (32, 30), (64, 66), (70, 64), (66, 68)):
        a = ["".join(rng.choices("abçd\U0001f600", k=m)) for _ in range(6)]
        b = ["".join(rng.choices("abçd\U0001f600", k=n)) for _ in range(6)] + [(x * n)[:n] for x in a]
        rows = edits._rows("".join(a), m), edits._rows("".join(b), n)
        for limit in (1, 2, 4, 20):
            found = edits.near_rows(*rows, np.full(len(a), limit), edits.both_bits(rows[1]))
            want = sorted((i, j, d) for i, x in enumerate(a) for j, y in enumerate(b) if (d := edit_distance(x, y)) <= limit)
            assert sorted(zip(*(x.tolist() for x in found))) == want


def test_names_that_begin_alike_are_not_all_scored(spark, monkeypatch):
    rng = random.Random(4)
    names = sorted({"abc" + "".join(rng.choices("defghijklmnop", k=rng.randint(7, 9))) for _ in range(700)})
    queries, names = names[::20], [n for i, n in enumerate(names) if i % 20]
    index = spark.createDataFrame([("npm", n) for n in names], "registry string, package_name string")
    missing = spark.createDataFrame([("npm", n) for n in queries], "registry string, package_name string")
    met, score = [], sim.score_pairs
    monkeypatch.setattr(sim, "score_pairs", lambda pairs: met.append(pairs) or score(pairs))
    got = {}
    for r in sim.suggest_names(missing, index, 5).orderBy("package_name", "rank").collect():
        got.setdefault(r.package_name, []).append(r.candidate)
    assert got == {q: v for q in queries if (v := direct(q, names, 5))}
    # Before, each met nearly all names, as plausible lengths and the same three signs were enough.
    assert sum(pairs.count() for pairs in met) < len(queries) * len(names) // 4


def test_lists_of_many_names_need_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(edits, "_FEW", 0)
    monkeypatch.setattr(edits, "_ASKED", 4)
    monkeypatch.setattr(edits, "_HELD", 8)
    rows = lambda names, ddl: spark.createDataFrame([(r, *n) for n in names for r in ("npm", "pypi")], ddl)
    names = words(40, 5)
    asked = rows([(n, None) for n in names], "registry string, s string, worst double")
    found = edits.close_pairs(asked, rows([(n,) for n in names], "registry string, s string"), 2)
    want = [(r, a, b) for a in names for b in names for r in ("npm", "pypi") if edit_distance(a, b) <= 2]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_an_empty_side_has_the_columns_of_a_full_one(spark):
    some = spark.createDataFrame([("npm", "express"), ("npm", "expresss")], "registry string, package_name string")
    full = sim.suggest_names(some, some, 5)
    assert full.count() == 2
    for missing, index in ((some, some.limit(0)), (some.limit(0), some)):
        none = sim.suggest_names(missing, index, 5)
        assert none.dtypes == full.dtypes and none.count() == 0
