"""The prefix trie of conversations as a burst trie: what every shared prefix saves, and who ends where.

A turn's id is the md5 of its role and text; a conversation is its ids in order, a byte string of fixed steps. Conversations with
equal turns are one class, so a group of copies is one suffix however large it is.

Burst. At first the trie is one container, under the root, with all classes. A container with more than ``limit`` turns bursts by
its next turn ids: grouping turns the ids into nodes, and what follows each of them becomes a container of its own. Only classes in
containers that are still too large go through another round, and a round takes twice as many turns at once as the one before, so
rounds grow with the logarithm of the depth; a class is never rewritten, its container is named by the hash of its first turns.
Heads too large are at most the turns over ``limit``, which bounds what is broadcast.

Sweep. Every remaining container goes to one task, its suffixes in byte order, where a prefix stands before what extends it. One
pass with a stack of open nodes closes a node when the next suffix leaves it; then its members, children, leaves and savings are
known. Nodes above the containers get the containers' totals by their hash paths, pre-aggregated.

Node columns: ``conv_id`` smallest member; ``depth``; ``parent_conv_id`` the parent's ``conv_id``; ``n_convs`` members; ``n_children``;
``n_leaves`` childless nodes of the subtree; ``saved_tokens`` summed over the subtree, a node's (n_convs - 1) times the code points of
its text; ``ends_sha256`` of the ids of the members that end there, ascending, joined by commas. The ids are concatenated in blocks
of neighbouring ids in parallel; only the digest itself runs through one task per class, block by block.

Defined results: null conversation ids take no part. Null turns come first, rows of one turn by their id; equal rows are turns of
their own. Null roles and texts are empty. Very long texts count as one turn, hashed where they are read. A conversation without
turns is a member of the root alone. An empty table has no nodes. Other columns are not read. One conversation's ids (36 bytes a
turn) meet in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .blocks import arrow_schema, ddl, in_tasks, map_blocks

STEP = 16
ROOT = bytes(STEP)
#: Turns that a container may hold, and containers that may be too large at once.
CONTAINER = 4096
MAX_HEADS = 1 << 18
_MEMBERS = 256
_EMPTY = hashlib.sha256(b"").hexdigest()
_FLUSH = 20_000


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns (id, chars) of every conversation, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), turn_id.alias("id"), F.length(text).alias("chars")
    )
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def regrafted(lists: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """Every conversation with its first ``shared`` (at most ``most``) turns replaced by those of conversation ``base``."""
    firsts = lists.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("firsts"))
    own = lists.select("conv_id", "turns", base.alias("base"), shared.cast("int").alias("shared"))
    head = F.coalesce(F.expr("slice(firsts, 1, shared)"), F.array().cast(lists.schema["turns"].dataType))
    return own.join(firsts, "base", "left").select("conv_id", F.concat(head, F.expr("slice(turns, shared + 1, size(turns))")).alias("turns"))


def paths(lists: DataFrame) -> DataFrame:
    """``conv_id, len, ids, keys, chars, last``: turn ids one after the other, and after every turn a hash of all turns so far."""
    fields = {"conv_id": "long", "len": "long", "ids": "binary", "keys": "binary", "chars": "array<int>", "last": "binary"}

    def block(conv_ids: list, turns: list, chars: list) -> dict[str, list]:
        out: dict[str, list] = {"conv_id": conv_ids, "len": [], "ids": [], "keys": [], "chars": chars, "last": []}
        for ids in turns:
            key, keys = ROOT, []
            for turn in ids:
                key = hashlib.md5(key + turn).digest()
                keys.append(key)
            out["len"].append(len(ids))
            out["ids"].append(b"".join(ids))
            out["keys"].append(b"".join(keys))
            out["last"].append(key)
        return out

    return map_blocks(lists, {"conv_id": F.col("conv_id"), "turns": F.col("turns.id"), "chars": F.col("turns.chars")}, fields, block, 1 << 20)


def member_digests(rows: DataFrame) -> DataFrame:
    """``id, n, ends``: smallest id, size and digest of the ids of every class of ``rows`` (conv_id, last)."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    part = F.floor(F.col("conv_id") / _MEMBERS).alias("part")
    blocks = rows.groupBy("last", part).agg(ids.alias("members"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    schema = arrow_schema({"id": "long", "n": "long", "ends": "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, low, n, sha, out = None, 0, 0, hashlib.sha256(), []
        for batch in batches:
            for key, members, count, first in zip(*(batch.column(c).to_pylist() for c in ("last", "members", "n", "low"))):
                if key == last:
                    sha.update(b",")
                else:
                    if last is not None:
                        out.append((low, n, sha.hexdigest()))
                    last, low, n, sha = key, first, 0, hashlib.sha256()
                sha.update(members.encode())
                n += count
            if len(out) > _FLUSH:
                yield _batch(out, schema)
                out = []
        if last is not None:
            out.append((low, n, sha.hexdigest()))
        yield _batch(out, schema)

    return in_tasks(blocks.repartition("last").sortWithinPartitions("last", "part"), run, ddl({"id": "long", "n": "long", "ends": "string"}))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _key_at(depth: Column | int) -> Column:
    """The hash of a class's first ``depth`` turns."""
    at = (F.lit(depth) if isinstance(depth, int) else depth).cast("int")
    return F.when(at == 0, F.lit(ROOT)).otherwise(F.substring("keys", (at - 1) * STEP + 1, F.lit(STEP)))


def _size(depth: Column | int) -> Column:
    """Turns of a class from ``depth`` on, one at least."""
    return F.col("len") - depth + 1


def burst(classes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``heads`` (key, path, depth, n_convs, conv_id, chars, ends, container) and classes with the depth at which their container
    starts (``cut``). Classes that end above all containers are in no container."""

    def nodes(rows: DataFrame, upto: int) -> DataFrame:
        depth, ended = F.col("depth"), F.col("len") == F.col("depth")
        found = rows.withColumn("key", _key_at(depth)).groupBy("key").agg(
            F.max(F.expr(f"substring(keys, 1, depth * {STEP})")).alias("path"), F.max("depth").alias("depth"), F.sum("n").alias("n_convs"),
            F.min("id").alias("conv_id"), F.max(F.coalesce(F.get("chars", depth.cast("int") - 1), F.lit(0))).alias("chars"),
            F.max(F.when(ended, F.col("ends"))).alias("ends"), F.sum(_size(depth)).alias("size"),
        )
        return found.withColumn("container", (F.col("depth") == upto) & (F.col("size") <= limit))

    level = nodes(classes.withColumn("depth", F.lit(0).cast("long")), 0).checkpoint()
    heads, contained, active, depth, step = [level], [], classes, 0, 1
    while True:
        inside = active.withColumn("key", _key_at(depth))
        small = level.filter("container").select("key")
        large = level.filter(f"depth = {depth} AND NOT container").select("key")
        if large.isEmpty():
            contained.append(inside.filter(F.col("len") >= depth).withColumn("cut", F.lit(depth)))
            break
        large = F.broadcast(large)  # at most MAX_HEADS keys, as each stands for more than a share of all turns
        reaching = inside.filter(F.col("len") >= depth)
        if depth:
            contained.append(reaching.join(large, "key", "left_anti").withColumn("cut", F.lit(depth)))
            active = reaching.join(large, "key", "left_semi").drop("key").checkpoint()
        upto = depth + step
        below = active.filter(F.col("len") > depth)
        each = F.explode(F.sequence(F.lit(depth + 1).cast("long"), F.least(F.lit(upto).cast("long"), F.col("len"))))
        level = nodes(below.withColumn("depth", each), upto).checkpoint()
        heads.append(level)
        active, depth, step = below, upto, min(2 * step, 64)
    out, rows = heads[0], contained[0]
    for more in heads[1:]:
        out = out.unionByName(more)
    for more in contained[1:]:
        rows = rows.unionByName(more)
    return out, rows


_NODE = {
    "head": "binary", "conv_id": "long", "depth": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long",
    "saved_tokens": "long", "ends": "string",
}


class _Open:
    """A node of which more suffixes may come."""

    __slots__ = ("low", "n", "children", "leaves", "saved", "chars", "ends")

    def __init__(self, chars: int):
        self.low, self.n, self.children, self.leaves, self.saved, self.chars, self.ends = None, 0, [], 0, 0, chars, None


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two suffixes share from their start."""
    if b.startswith(a):
        return len(a) // STEP
    at, jump = 0, STEP
    while a[at : at + jump] == b[at : at + jump]:
        at, jump = at + jump, 2 * jump
    while jump > STEP:
        jump //= 2
        if a[at : at + jump] == b[at : at + jump]:
            at += jump
    return at // STEP


class _Sweep:
    """One container: suffixes come in byte order, finished nodes leave as rows of ``_NODE``."""

    def __init__(self, key: bytes, cut: int):
        self.key, self.cut, self.last, self.open, self.rows = key, cut, b"", [_Open(0)], []

    def add(self, low: int, n: int, ids: bytes, chars: list[int], ends: str) -> None:
        kept = _shared(self.last, ids)
        while len(self.open) - 1 > kept:
            self._close()
        self.open.extend(_Open(c) for c in chars[kept:])
        top = self.open[-1]
        top.low, top.n, top.ends = low if top.low is None else min(low, top.low), top.n + n, ends
        self.last = ids

    def _close(self) -> None:
        depth, node = self.cut + len(self.open) - 1, self.open.pop()
        saved, leaves = node.saved + (node.n - 1) * node.chars, node.leaves or 1
        self._leave(node, depth)
        above = self.open[-1]
        above.children.append((node.low, node.n, len(node.children), leaves, saved, node.ends))
        above.low = node.low if above.low is None else min(above.low, node.low)
        above.n, above.leaves, above.saved = above.n + node.n, above.leaves + leaves, above.saved + saved

    def _leave(self, node: _Open, depth: int) -> None:
        """Children are complete once their parent's smallest member is known."""
        self.rows += [(None, low, depth + 1, node.low, n, kids, leaves, saved, ends) for low, n, kids, leaves, saved, ends in node.children]

    def end(self) -> list[tuple]:
        while len(self.open) > 1:
            self._close()
        head = self.open[0]
        self._leave(head, self.cut)
        self.rows.append((self.key, head.low, self.cut, None, head.n, len(head.children), head.leaves or 1, head.saved, head.ends))
        return self.rows


def sweep(contained: DataFrame) -> DataFrame:
    """Nodes inside containers, and a row with ``head`` and the totals of every container."""
    suffix = F.expr(f"substring(ids, cut * {STEP} + 1, length(ids))")
    rows = contained.select("key", "cut", "id", "n", suffix.alias("ids"), F.expr("slice(chars, cut + 1, size(chars))").alias("chars"), "ends")
    schema = arrow_schema(_NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for key, cut, low, n, ids, chars, ends in zip(*(batch.column(c).to_pylist() for c in ("key", "cut", "id", "n", "ids", "chars", "ends"))):
                if now is None or now.key != key:
                    out += now.end() if now else []
                    now = _Sweep(key, cut)
                now.add(low, n, ids, chars, ends)
            if len(out) > _FLUSH:
                yield _batch(out, schema)
                out = []
        yield _batch(out + (now.end() if now else []), schema)

    return in_tasks(rows.repartition("key").sortWithinPartitions("key", "ids"), run, ddl(_NODE))


def _assembled(heads: DataFrame, totals: DataFrame) -> DataFrame:
    """Head nodes with what the nodes and containers below them sum up to."""
    below = totals.select(F.col("head").alias("key"), "n_children", "n_leaves", "saved_tokens")
    parent = F.when(F.col("depth") > 1, F.expr(f"substring(path, (depth - 2) * {STEP} + 1, {STEP})")).when(F.col("depth") == 1, F.lit(ROOT))
    known = heads.withColumn("parent", parent).join(below, "key", "left")
    children = known.filter("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    known = known.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", "kids", F.lit(0)))
    own = (F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved_tokens", F.lit(0))
    leaves = F.coalesce("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0))
    known = known.withColumn("own_leaves", leaves).withColumn("own_saved", own).checkpoint()
    above = F.transform(F.sequence(F.lit(0), F.col("depth").cast("int")), lambda j: F.when(j == 0, F.lit(ROOT)).otherwise(F.substring("path", (j - 1) * STEP + 1, F.lit(STEP))))
    spread = known.select(F.explode(above).alias("key"), "own_leaves", "own_saved")
    sums = spread.groupBy("key").agg(F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"))
    parents = known.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = known.select("key", "parent", "conv_id", "depth", "n_convs", "n_children", "ends").join(sums, "key").join(parents, "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends"
    )


def trie(lists: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """The nodes of the trie of ``lists`` (conv_id, turns), as the module describes them."""
    ensure_checkpoint_dir(lists.sparkSession)
    rows = paths(lists).checkpoint()
    found = member_digests(rows.select("conv_id", "last"))
    classes = rows.drop("last").withColumnRenamed("conv_id", "id").join(found, "id").checkpoint()
    turns = classes.agg(F.sum(_size(0))).first()[0] or 0
    heads, contained = burst(classes, max(limit, turns // MAX_HEADS))
    swept = sweep(contained).checkpoint()
    inner = swept.filter("head IS NULL").drop("head")
    nodes = inner.unionByName(_assembled(heads, swept.filter("head IS NOT NULL")))
    counts = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return nodes.select(*counts, F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))
