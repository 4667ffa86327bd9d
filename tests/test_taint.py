"""Taint over long and branching chains."""

import random

from sparkwarden.operators.taint import propagate_taint

COLUMNS = "file string, id string, name string, value string, start bigint, scope_start bigint, scope_end bigint"


def row(i, name, value):
    return ("f", str(i), name, value, i * 10, 0, 10**9)


def test_a_chain_of_a_thousand(spark):
    rows = [row(0, "v0", "req.query.x")] + [row(i, f"v{i}", f"v{i - 1} + 1") for i in range(1, 1000)]
    found = {r["id"]: r["round"] for r in propagate_taint(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert found == {str(i): i for i in range(1000)}


def test_branches_take_the_nearest_source(spark):
    rng = random.Random(3)
    rows, rounds = [], {}
    for i in range(150):
        parents = rng.sample(range(i), min(i, rng.randint(0, 2)))
        source = rng.random() < 0.06
        rows.append(row(i, f"v{i}", " + ".join([f"v{p}" for p in parents] + (["req.body"] if source else ["1"]))))
        near = [rounds[p] + 1 for p in parents if p in rounds] + ([0] if source else [])
        if near:
            rounds[i] = min(near)
    found = {int(r["id"]): r["round"] for r in propagate_taint(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert found == rounds
