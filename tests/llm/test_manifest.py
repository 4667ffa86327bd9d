"""The Merkle manifest against a plain tree, on small tables and on the hard rows."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import merkle
from sparkwarden.llm.blocks import share

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*inputs):
    return sha256("".join(inputs).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """The levels above ``nodes``, each a list; the last holds one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def plain_path(levels, i):
    """(left, right) digests a level."""
    for level in levels[:-1]:
        start = i // 8 * 8
        yield "".join(level[start:i]), "".join(level[i + 1 : start + 8])
        i //= 8


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[g] = plain_tree([plain_leaf(*r) for r in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in langs])
    out = []
    for place, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = [*plain_path(trees[g], i), *plain_path(top, place)]
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                shown = (r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            folded = plain_leaf(*shown)
            for left, right in path:
                folded = h(left, folded, right)
            out.append((r[0], plain_leaf(*r), trees[g][-1][0], top[-1][0], h(*(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def shown(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 7, 8) for r in rows], DOCS + ", leaf string, number long, total long")
    out = merkle.document_manifest(docs, share(F.col("doc_id"), 0, 3))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, "de": 1}, {"en": 600, None: 65, "": 8, "é": 64, "z": 1, "de": 520}])
def test_manifest_equals_a_plain_tree(spark, sizes):
    rng = random.Random(3)
    rows = [(rng.randrange(10**9), f"Text {lang} {i}", lang, "s", i) for lang, n in sizes.items() for i in range(n)]
    assert shown(spark, rows) == plain_manifest(rows)


def test_manifest_of_many_groups_and_hard_rows(spark):
    rows = [(i, "ÀB" * i, f"l{i}", None if i % 2 else "s", None) for i in range(70)]
    rows += [(None, None, None, None, None)] * 3 + [(None, "A", "l3", "s", 1), (5, "", "l5", "", 0), (5, "", "l5", "", 0), (5, "Other", "l5", "", 0)]
    rows += [(7, "Long " * 200_000, "l5", "s", 1_000_000), (-4, "\0\U0001f600 Q", "l5", "s", -1), (33, "nothing upper", "en", "s", 1)]
    assert shown(spark, rows) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert shown(spark, []) == []


def test_tampered_rows_fail_and_all_others_pass(spark):
    rows = [(i, f"Upper {i}", "en", "s", 1) for i in range(100)]
    out = {r[0]: r[-1] for r in shown(spark, rows)}
    assert all(out[i] == (zlib.crc32(str(i).encode()) % 3 != 0) for i in out) and {True, False} == set(out.values())


def test_no_level_is_joined_with_the_leaves(spark):
    """The rows' own level is unfolded from its parents; joins see an eighth of the rows or fewer."""
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 1) for i in range(100)], DOCS)
    tree = merkle.grow(
        docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("number"), F.lit(100).cast("long").alias("total"), F.col("text").alias("digest"))
    )
    assert [level.count() for level in tree.levels] == [13, 2, 1] and tree.tops.count() == 1
