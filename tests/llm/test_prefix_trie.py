"""The trie of conversations against a plain trie, with containers of all sizes, and on the hard rows."""

import random
import zlib
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def plain_lists(rows):
    key = lambda role, text: md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            found.setdefault(conv, []).append((turn is not None, turn or 0, key(role, text), role or "", text or ""))
    return {conv: [(role, text) for *_, role, text in sorted(turns)] for conv, turns in found.items()}


def plain_trie(lists):
    members, ended, children = {(): []}, {}, {}
    for conv in sorted(lists):
        turns = tuple(lists[conv])
        for depth in range(len(turns) + 1):
            members.setdefault(turns[:depth], []).append(conv)
            if depth:
                children.setdefault(turns[: depth - 1], set()).add(turns[:depth])
        ended.setdefault(turns, []).append(conv)
    if not members[()]:
        return []
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, ())
        leaves[path] = sum(leaves[c] for c in below) or 1
        saved[path] = sum(saved[c] for c in below) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        (
            (
                members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children.get(p, ())), leaves[p], saved[p],
                sha256(",".join(map(str, ended.get(p, []))).encode()).hexdigest(),
            )
            for p in members
        ),
        key=repr,
    )


def nodes_of(spark, rows, limit, rebuilt=False):
    lists = prefix_trie.turn_lists(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", depth long, key string"))
    if rebuilt:
        conv = F.col("conv_id")
        lists = prefix_trie.regrafted(lists, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5)
    out = prefix_trie.trie(lists, limit)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def conversations(seed, count):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-50, 4 * count), count):
        text = "hot" if rng.random() < 0.5 else rng.choice("ab")
        for turn in range(rng.choice([1, 2, 3, 3, 9])):
            rows.append((conv, turn * 2, rng.choice(["user", "user", "system"]) if turn else "user", text))
            text = rng.choice(["", "x", "yy", "zé\U0001f600"])
    return rows


@pytest.mark.parametrize("limit", [1, 7, 60, 4096])
def test_trie_equals_a_plain_trie(spark, limit):
    rows = conversations(limit, 300)
    assert nodes_of(spark, rows, limit) == plain_trie(plain_lists(rows))


def plain_rebuilt(lists):
    out = {}
    for conv, own in lists.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (abs(conv) % 100) * (1 if conv >= 0 else -1)
        out[conv] = lists.get(base, [])[:h] + own[h:]
    return out


def test_trie_of_rebuilt_conversations(spark):
    rows = conversations(11, 400)
    assert nodes_of(spark, rows, 40, True) == plain_trie(plain_rebuilt(plain_lists(rows)))


@pytest.mark.parametrize("limit", [1, 4096])
def test_trie_of_hard_rows(spark, limit):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 1, "user", "a"), (2, None, "", ""), (2, 1, "user", "a"), (3, 1, "b", "tie"), (3, 1, "a", "tie")]
    rows += [(3, 1, "a", "tie"), (4, 5, "use", "ra"), (5, 5, "user", "a"), (6, 1, "user", "long " * 200_000), (7, 1, "user", "long " * 200_000 + "!")]
    rows += [(100 + i, t, "user", "copy") for i in range(2000) for t in range(2)] + [(9000, t, "user", f"t{t}") for t in range(300)]
    rows += [(9001, t, "user", f"t{t}") for t in range(200)] + [(9002, t, "user", f"t{min(t, 150)}") for t in range(300)]
    rows += [(200, 0, "user", "again"), (-1, 0, "user", "copy"), (2**62, 0, "user", "copy")]
    assert nodes_of(spark, rows, limit) == plain_trie(plain_lists(rows))


def test_trie_of_nothing(spark):
    assert nodes_of(spark, [], 10) == [] and nodes_of(spark, [(None, 1, "user", "x")], 10) == []
