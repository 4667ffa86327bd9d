"""Merkle manifest of a dataset: every row's digest, the root over all rows, and a proof per row.

Slot pivot. Nodes of a group are numbered from 0. Conditional aggregates spread the children of a parent (``number div FANOUT``)
into ``FANOUT`` columns, one per slot; the concatenated columns hash to the parent, and without a child's own column they are
its siblings. One grouping a level, each an eighth as large as the one before, leads up to one node a group; the way down joins
every parent with the siblings met above it and unfolds its slots, so no row ever meets a level of its own size again.

``H`` is the lowercase hex sha256 of its inputs concatenated, digests as hex text. A leaf hashes the row's fields, each ``-`` if
null, else its UTF-8 byte count, ``:`` and the value. Leaves of a group ascend by id. While a group has several nodes, every
``FANOUT`` consecutive ones (the last run may be shorter, even one) become their ``H``. What remains is the group's subroot; the
subroots, by group (null first, then bytewise), are folded likewise to the root.

Defined results: null ids come first; rows that share an id follow each other by digest (equal rows hash alike, so any order of
them gives the same tree). A null group is a group of its own and differs from an empty one. Null, empty and very long texts are
hashed whole. An empty table has no nodes and gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from ..session import ensure_checkpoint_dir

FANOUT = 8
_SLOTS = [f"slot{k}" for k in range(FANOUT)]
_PATH = "array<struct<left:string,right:string>>"


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*[c.cast("binary") for c in inputs]), 256)


def row_digest(fields: list[Column]) -> Column:
    """``H`` over fields that are told apart by their lengths."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(*parts)


def _group_key(group: Column) -> Column:
    """A text that is never null and sorts like the group: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _pivot(nodes: DataFrame, value: str) -> DataFrame:
    """``group, number, total`` and a slot column per child of ``nodes`` (group, number, total, ``value``)."""
    slot = F.pmod("number", F.lit(FANOUT))
    parents = nodes.groupBy("group", F.floor(F.col("number") / FANOUT).alias("number"))
    return parents.agg(F.max("total").alias("total"), *[F.max(F.when(slot == k, F.col(value))).alias(c) for k, c in enumerate(_SLOTS)])


def _parents(level: DataFrame, text=lambda c: F.col(c)) -> DataFrame:
    """The nodes above a pivoted level; a group's only node passes as it is."""
    joined = F.sha2(F.concat_ws("", *[text(c) for c in _SLOTS]), 256)
    node = F.when(F.col("total") > 1, joined).otherwise(text(_SLOTS[0]))
    return level.select("group", "number", F.ceil(F.col("total") / FANOUT).alias("total"), node.alias("digest"))


@dataclass
class Tree:
    """``levels`` from the leaves up, each pivoted; ``tops``: one row (group, number, total, digest) per group."""

    levels: list[DataFrame]
    tops: DataFrame


def grow(nodes: DataFrame, value: str = "digest", text=lambda c: F.col(c)) -> Tree:
    """The tree over ``nodes`` (group, number, total, ``value``); ``text`` takes the digest out of a slot of the first level.

    The number of levels is that of the largest group; smaller groups pass their subroot on, at one row a level.
    """
    levels = [_pivot(nodes, value).checkpoint()]
    largest = levels[0].agg(F.max("total")).first()[0] or 1
    above = _parents(levels[0], text)
    while largest > FANOUT:
        largest = -(-largest // FANOUT)
        levels.append(_pivot(above, "digest").checkpoint())
        above = _parents(levels[-1])
    return Tree(levels, above)


def _beside(slot: int, text=lambda c: F.col(c)) -> Column:
    """The digests left and right of a slot."""
    left = F.concat_ws("", *[text(c) for c in _SLOTS[:slot]])
    right = F.concat_ws("", *[text(c) for c in _SLOTS[slot + 1 :]])
    return F.struct(left.alias("left"), right.alias("right"))


def _unfold(level: DataFrame, paths: DataFrame, kept: list[str], text=lambda c: F.col(c)) -> DataFrame:
    """One row per child: ``group, number, value, path`` and ``kept``, from the parents' ``paths`` (group, number, path, ...)."""
    slots = []
    for k, name in enumerate(_SLOTS):
        path = F.when(F.col("total") > 1, F.concat(F.array(_beside(k, text)), F.col("path"))).otherwise(F.col("path"))
        child = F.struct((F.col("number") * FANOUT + k).alias("number"), F.col(name).alias("value"), path.alias("path"))
        slots.append(F.when(F.col(name).isNotNull(), child))
    joined = level.join(paths, ["group", "number"])
    return joined.select("group", *kept, F.explode(F.filter(F.array(*slots), lambda s: s.isNotNull())).alias("child")).select("group", *kept, "child.*")


def descend(tree: Tree, tops: DataFrame, kept: list[str], text=lambda c: F.col(c)) -> DataFrame:
    """Every leaf (``group, number, value, path`` and ``kept``) with the siblings met on the way to the end of ``tops``' paths."""
    paths = tops.select("group", "number", "path", *kept)
    for level in reversed(tree.levels[1:]):
        paths = _unfold(level, paths, kept).drop("value")
    return _unfold(tree.levels[0], paths, kept, text)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """``H`` of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` (id, group, leaf, presented) as a table of ``id, leaf, presented, subroot, root, path``.

    ``presented`` is carried along: the digest that a holder shows for the row.
    """
    ensure_checkpoint_dir(leaves.sparkSession)
    rows = leaves.select("id", _group_key(F.col("group")).alias("group"), "leaf", "presented")
    rows = numbered(rows, ["group"], [F.asc_nulls_first("id"), "leaf"], "number", "total")
    held = rows.select("group", "number", "total", F.struct("id", "leaf", "presented").alias("row"))
    leaf_of = lambda c: F.col(c)["leaf"]
    groups = grow(held, "row", leaf_of)
    subroots = numbered(groups.tops.select("group", "digest"), [], ["group"], "number", "total")
    above = grow(subroots.select(F.lit("").alias("group"), F.struct("group", "digest").alias("row"), "number", "total"), "row", lambda c: F.col(c)["digest"])
    top = above.tops.select("group", "number", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    ends = descend(above, top, ["root"], lambda c: F.col(c)["digest"])
    ends = ends.select(F.col("value.group").alias("group"), F.lit(0).cast("long").alias("number"), "path", "root", F.col("value.digest").alias("subroot"))
    return descend(groups, ends, ["root", "subroot"], leaf_of).select("value.*", "subroot", "root", "path")


def verify_rows(leaves: DataFrame) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified``: does the presented digest lead to the root?"""
    folded = fold(F.col("presented"), F.col("path"))
    out = manifest(leaves).withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", folded)
    return out.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of documents; where ``tampered``, the presented row has its text's A-Z lower-cased."""
    names = ["doc_id", "source", "lang", "n_chars"]
    leaf = row_digest([*map(F.col, names), F.col("text")])
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    other = row_digest([*map(F.col, names), F.translate(F.col("text"), upper, upper.lower())])
    changed = F.coalesce(tampered, F.lit(False))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), leaf.alias("leaf"), F.when(changed, other).alias("other"))
    return rows.select("id", "group", "leaf", F.coalesce("other", "leaf").alias("presented"))


def document_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``."""
    return verify_rows(document_leaves(docs, tampered)).withColumnRenamed("id", "doc_id")
