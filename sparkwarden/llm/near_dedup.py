"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimates, exact confirmation.

Sets and registers. Words are lower-cased (A-Z) runs of anything but ASCII white space; a document's set holds the 64-bit
hashes of its 5-word shingles, or of its whole word sequence if that is shorter. The top byte of a hash names one of 256
buckets; a bucket keeps, of its smallest remainder, the count of leading zeros and ``MANTISSA`` further bits. Documents with
equal sets are one class, represented by its smallest id; only representatives go on.

Threshold. Two documents are linked from ``least`` hundredths of similarity on; all below follows from that number.

Candidates. Runs of registers (empty ones borrow from the next filled one) are hashed to bands: as many registers a band as
let two sets at the threshold miss each other in all bands with a chance below 1e-6 (``band_shape``: 36 bands of seven at 85,
51 of five at 80). Linked sets share more than one band: the same bound of 1e-6 gives the number k that they share at least
(``fewest_shared``, from the size of the set). A set in fewer shared bands has no link; any other leaves its k - 1 largest bands,
as two sets that share k bands still meet in one of the rest. This takes away sets that merely hold a common passage.
A band shared by many does not emit its pairs: the
member met in the largest bands becomes its hub, and every member is compared with the hub alone. That comparison, over full
sets, gives the link with the hub and the difference from it. Members that the hub does not link are then paired through
these differences: two sets x, y with ``least |x or y| <= 100 |x and y|`` have differences D(x), D(y) from the hub with
``|D(x) xor D(y)| <= s (|x| + |y|)``, ``s = (100 - least) / (100 + least)``, so in any fixed order of elements their prefixes of length
``|D| - least overlap + 1`` meet. Members that links with hubs already join need no pair. Elements held by one such component only
come first, the others by the number of their holders, so that prefixes hold what is rare in the hub's group. So no link is lost
to the hub, and what is emitted stays near the links there are. Prefix pairs are first judged by the registers (matches less the chance
collisions of compressed registers, with six standard deviations of slack) and then confirmed on full sets.

Components are found by spreading the smallest id over the links, with pointer jumping.

Defined results: null texts and texts without words have the empty set and are linked with nothing. Rows that share an id are
one document, with the links of all its texts; each input row gives one output row. A row with null id is linked with nothing,
has a null component and is kept. Empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .blocks import map_blocks, maybe_among

SHINGLE = 5
BUCKETS = 256
MANTISSA = 10
#: 100 * intersection >= least * union links two documents; this is the least of op2_near_duplicates.
LEAST = 85
MISSED = 1e-6
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 2 << 20
_PART = 1 << 18
_MIXERS = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)]
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIXERS[0]
    x = (x ^ (x >> _U(27))) * _MIXERS[1]
    return x ^ (x >> _U(31))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size, _U(_BASE))]))
    down = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size, _U(inverse))]))
    return up, down


def word_hashes(text: str) -> np.ndarray:
    """A hash per word; long texts go in parts that end in white space, so that the arrays stay small."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    parts, start = [], 0
    while len(raw) - start > _PART:
        gaps = np.flatnonzero(_WHITE[raw[start + _PART : start + 2 * _PART]])
        if not len(gaps):
            break
        parts.append(_hashed(raw[start : start + _PART + gaps[0]]))
        start += _PART + gaps[0]
    parts.append(_hashed(raw[start:]))
    return np.concatenate(parts)


def _hashed(raw: np.ndarray) -> np.ndarray:
    """From prefix sums of a polynomial over the bytes."""
    if not len(raw):
        return np.zeros(0, _U)
    solid = np.concatenate([[False], ~_WHITE[raw], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(1 << int(len(raw)).bit_length())
    sums = np.concatenate([[_U(0)], np.add.accumulate((raw.astype(_U) + _U(1)) * up[: len(raw)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _MIXERS[2])


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    total = np.full(len(words) - size + 1, _U(size * int(_MIXERS[3]) % (1 << 64)))
    for i in range(size):
        total = (total ^ words[i : len(words) - size + 1 + i]) * _MIXERS[4]
        total ^= total >> _U(29)
    return np.unique(mix(total))


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that equal sets share: order-free sums of two mixes."""
    if not len(hashes):
        return b""
    with np.errstate(over="ignore"):
        return np.array([mix(hashes).sum(dtype=_U), mix(hashes * _MIXERS[3] + _U(7)).sum(dtype=_U)]).tobytes()


def registers(hashes: np.ndarray) -> np.ndarray:
    """Per bucket: leading zeros and mantissa of the smallest remainder, plus one; 0 if the bucket is empty."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (hashes >> _U(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(hashes) else []
    rest = hashes[first] & _U((1 << 56) - 1)
    zeros = np.clip(56 - np.frexp(rest.astype(np.float64))[1], 0, 56).astype(np.int64)
    zeros[rest == 0] = 56
    spare = np.maximum(56 - zeros - 1 - MANTISSA, 0).astype(_U)
    tail = (rest >> spare) & _U((1 << MANTISSA) - 1)
    out[bucket[first]] = ((zeros << MANTISSA) | tail.astype(np.int64)) + 1
    return out


@cache
def band_shape(least: int) -> tuple[int, int]:
    """Registers a band and bands: the longest bands that miss a pair at the threshold with a chance below ``MISSED``."""
    rows = max((r for r in range(1, 65) if (1 - (least / 100) ** r) ** (BUCKETS // r) < MISSED), default=1)
    return rows, BUCKETS // rows


@cache
def fewest_shared(least: int, n: int) -> int:
    """Bands that a set of ``n`` shingles shares with any set linked to it, but for a chance below ``MISSED``.

    A band hangs on as many filled registers as it spans, and on one more if empty ones borrow; each agrees with the chance of the
    threshold. Sets below 64 shingles fill so few registers that bands are not independent: little is asked of them, of the
    smallest nothing."""
    if n < 16:
        return 1
    length, count = band_shape(least)
    filled = -math.expm1(-100 * n / least / BUCKETS)  # by the largest union with a partner
    agree = (least / 100) ** (length * filled + 1 - filled)
    shared, missed = 0, (1 - agree) ** count
    while missed < MISSED:
        shared += 1
        missed += math.comb(count, shared) * agree**shared * (1 - agree) ** (count - shared)
    return min(max(shared, 1), 8 if n < 64 else count)


def fewest_of(n: Column, least: int) -> Column:
    """``fewest_shared`` of a column: a step for every size at which it changes, until registers are full."""
    sizes = [16, *(m for m in range(17, 16 * BUCKETS) if fewest_shared(least, m) != fewest_shared(least, m - 1))]
    found = F.lit(fewest_shared(least, 1))
    for m in sizes:
        found = F.when(n >= m, fewest_shared(least, m)).otherwise(found)
    return found


def band_keys(table: np.ndarray, least: int = LEAST) -> np.ndarray:
    """rows x bands keys of a rows x BUCKETS table of registers, none of them all empty."""
    length, count = band_shape(least)
    filled = np.concatenate([table, table], axis=1) > 0
    place = np.where(filled, np.arange(2 * BUCKETS), 4 * BUCKETS)
    nearest = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BUCKETS]
    distance = nearest - np.arange(BUCKETS)
    value = np.take_along_axis(table, nearest % BUCKETS, axis=1).astype(_U) | (distance.astype(_U) << _U(20))
    value = value[:, : length * count].reshape(len(table), count, length)
    key = np.broadcast_to(mix(np.arange(1, count + 1, dtype=_U)), (len(table), count)).copy()
    for i in range(length):
        key = mix(key ^ value[:, :, i])
    return key.view(np.int64)


def chance_match(n: int, m: int) -> float:
    """Chance that unrelated registers of sets of n and m shingles agree: same leading zeros, same mantissa."""
    ks = np.arange(0, 47)

    def zeros(count: int) -> np.ndarray:
        above = np.exp(-(count / BUCKETS) * 2.0 ** -(ks + 1.0))  # no remainder below 2**-(k+1)
        below = np.exp(-(count / BUCKETS) * 2.0**-ks)
        return above - below  # smallest remainder between 2**-(k+1) and 2**-k

    return float((zeros(n) * zeros(m)).sum() / (1 << MANTISSA))


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int, least: int = LEAST) -> tuple[float, float]:
    """Collision-corrected similarity and its standard deviation at the link threshold."""
    either = int(((a > 0) | (b > 0)).sum())
    if not either:
        return 0.0, 1.0
    agree = int(((a == b) & (a > 0)).sum())
    return (agree - either * chance_match(n, m)) / either, (least * (100 - least) / 10_000 / either) ** 0.5


def linked(common: int, n: int, m: int, least: int = LEAST) -> bool:
    return 100 * common >= least * (n + m - common)


def _spread(least: int) -> float:
    """Largest symmetric difference of linked sets, as a share of the sum of their sizes."""
    return (100 - least) / (100 + least)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n, key, regs`` of every row of ``docs`` (doc_id, text)."""
    fields = {"doc_id": "long", "n": "long", "key": "binary", "regs": "binary"}

    def block(ids: list, texts: list) -> dict[str, list]:
        sets = [shingle_set(t) for t in texts]
        return {
            "doc_id": ids, "n": [len(s) for s in sets], "key": [set_key(s) for s in sets],
            "regs": [registers(s).tobytes() if len(s) else None for s in sets],
        }

    return map_blocks(docs, {"doc_id": F.col("doc_id"), "text": F.col("text")}, fields, block, _BLOCK)


def bands(classes: DataFrame, least: int = LEAST) -> DataFrame:
    """``band, id``: one row per band of every class representative."""
    fields = {"band": "long", "id": "long"}

    def block(ids: list, regs: list) -> dict[str, list]:
        if not ids:
            return {"band": [], "id": []}
        keys = band_keys(np.frombuffer(b"".join(regs), np.uint16).reshape(len(ids), BUCKETS), least)
        return {"band": keys.reshape(-1), "id": np.repeat(np.array(ids, np.int64), keys.shape[1])}

    return map_blocks(classes, {"id": F.col("id"), "regs": F.col("regs")}, fields, block, 1 << 20)


def shared_bands(filed: DataFrame) -> DataFrame:
    """``band, id, size`` of the bands with more than one member; ``filed`` is shuffled once."""
    filed = filed.select("band", "id").repartition("band")
    return filed.join(filed.groupBy("band").agg(F.count("id").alias("size")).filter("size > 1"), "band")


def rare_bands(filed: DataFrame, classes: DataFrame, least: int = LEAST) -> DataFrame:
    """``band, id`` without sets that share too few bands for a link, and without the largest bands that a set can do without."""
    fewest = classes.groupBy("id").agg(F.min(fewest_of(F.col("n"), least)).alias("fewest"))  # an id with several texts: of any of them
    members = shared_bands(filed).join(fewest, "id")
    own = Window.partitionBy("id")
    placed = members.withColumn("bands", F.count(F.lit(1)).over(own))
    placed = placed.withColumn("place", F.row_number().over(own.orderBy(F.desc("size"), "band")))
    return placed.filter("bands >= fewest AND place >= fewest").select("band", "id")


def hub_pairs(filed: DataFrame) -> DataFrame:
    """``hub, id`` without repeats: every member of a band with the band's hub."""
    members = shared_bands(filed)
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    weighed = members.select("band", "id").join(weight, "id")
    hubs = weighed.groupBy("band").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"))
    pairs = members.select("band", "id").join(hubs, "band").filter("id <> hub")
    return pairs.groupBy("hub", "id").agg(F.count(F.lit(1)).alias("bands")).select("hub", "id")


def texts_of(docs: DataFrame, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``id, text`` of the documents in ``pairs``; most texts of others are not shuffled."""
    wanted = pairs.select(F.col(left).alias("doc_id")).unionByName(pairs.select(F.col(right).alias("doc_id"))).distinct().checkpoint()
    near = docs.filter(maybe_among(wanted.select("doc_id"))(F.col("doc_id")))
    return near.join(wanted, "doc_id").select(F.col("doc_id").alias("id"), "text")


def with_texts(pairs: DataFrame, texts: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs with both texts. Joins stand bare between shuffles, so that a hot hub's rows can be split over tasks."""
    a = texts.select(F.col("id").alias(left), F.col("text").alias("left_text"))
    b = texts.select(F.col("id").alias(right), F.col("text").alias("right_text"))
    return pairs.join(b, right).join(a, left)


def compare_with_hub(pairs: DataFrame, texts: DataFrame, least: int = LEAST) -> DataFrame:
    """``hub, id, linked, n, gap, apart``: sizes of the set and of its difference from the hub's, and the difference."""
    fields = {"hub": "long", "id": "long", "linked": "boolean", "n": "long", "gap": "long", "apart": "array<long>"}

    def block(hubs: list, ids: list, hub_texts: list, id_texts: list) -> dict[str, list]:
        out: dict[str, list] = {"hub": hubs, "id": ids, "linked": [], "n": [], "gap": [], "apart": []}
        last, hub = None, None
        for hub_id, hub_text, text in zip(hubs, hub_texts, id_texts):
            if last != (hub_id, hub_text):
                last, hub = (hub_id, hub_text), shingle_set(hub_text)
            own = shingle_set(text)
            added, lost = np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)
            out["linked"].append(linked(len(own) - len(added), len(own), len(hub), least))
            out["n"].append(len(own))
            out["gap"].append(len(added) + len(lost))
            out["apart"].append(np.concatenate([added, lost]).view(np.int64))
        return out

    joined = with_texts(pairs, texts, "hub", "id")
    columns = {"hub": F.col("hub"), "id": F.col("id"), "hub_text": F.col("left_text"), "id_text": F.col("right_text")}
    return map_blocks(joined, columns, fields, block, _BLOCK)


def prefixes(compared: DataFrame, joined: DataFrame, least: int = LEAST) -> DataFrame:
    """``hub, id, component, linked, n, gap, element, at``: the elements of a difference that any link may need, of hubs whose members
    are of several components (``joined``: id, component); elements of one component come first and are left out."""
    rows = compared.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spans = rows.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rows = rows.join(spans.filter("low < high").select("hub"), "hub")
    rows = rows.select("hub", "id", "component", "linked", "n", "gap", F.explode("apart").alias("element"))
    holders = Window.partitionBy("hub", "element")
    rows = rows.withColumns({
        "holders": F.count(F.lit(1)).over(holders), "low": F.min("component").over(holders), "high": F.max("component").over(holders)
    })
    last = Window.partitionBy("hub", "id").orderBy(F.desc("holders"), F.desc("element"))
    rows = rows.filter("low < high").withColumn("at", F.col("gap") - F.row_number().over(last))
    # Partners of a link hold at most 100/least as many shingles, so this many elements suffice for every one of them.
    share = _spread(least)
    need = F.floor(share * (F.col("n") + F.floor(F.col("n") * 100 / least) + 1)) + 2
    # Partners of a set that is linked with the hub are not, so they lie beyond the slack towards it, which is at most
    # s of the gap less than the slack towards this set: they share over (1 - s) / 2 of the gap.
    need = F.when(F.col("linked"), F.least(need, F.floor((1 + share) / 2 * F.col("gap")) + 2)).otherwise(need)
    return rows.filter(F.col("at") < need).select("hub", "id", "component", "linked", "n", "gap", "element", "at")


def prefix_pairs(compared: DataFrame, joined: DataFrame, least: int = LEAST) -> DataFrame:
    """``a, b``: pairs of different components whose differences from a common hub can belong to a link; at least one is not linked
    with the hub."""
    rows = prefixes(compared, joined, least)
    named = lambda side: (F.col(c).alias(f"{side}_{c}") for c in ("id", "component", "linked", "n", "gap", "at"))
    a, b = rows.filter(~F.col("linked")).select("hub", "element", *named("a")), rows.select("hub", "element", *named("b"))
    overlap = F.ceil((F.col("a_gap") + F.col("b_gap") - _spread(least) * (F.col("a_n") + F.col("b_n"))) / 2 - 1e-6)
    on = (
        (a["hub"] == b["hub"])
        & (a["element"] == b["element"])
        & (F.col("a_component") != F.col("b_component"))
        & (F.col("b_linked") | (F.col("a_id") < F.col("b_id")))
        & (100 * F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n"))
        & (F.col("a_at") <= F.col("a_gap") - overlap)
        & (F.col("b_at") <= F.col("b_gap") - overlap)
    )
    pairs = a.join(b, on).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits")).select("a", "b")


def likely(pairs: DataFrame, classes: DataFrame, least: int = LEAST) -> DataFrame:
    """Pairs whose registers do not speak clearly against a link."""
    fields = {"a": "long", "b": "long"}

    def block(a_ids: list, b_ids: list, a_n: list, b_n: list, a_regs: list, b_regs: list) -> dict[str, list]:
        keep = []
        for i, (n, m, x, y) in enumerate(zip(a_n, b_n, a_regs, b_regs)):
            value, deviation = estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), n, m, least)
            if value >= least / 100 - 6 * deviation:
                keep.append(i)
        return {"a": [a_ids[i] for i in keep], "b": [b_ids[i] for i in keep]}

    a = classes.select(F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("regs").alias("a_regs"))
    b = classes.select(F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("regs").alias("b_regs"))
    joined = pairs.join(a, "a").join(b, "b")
    return map_blocks(joined, {c: F.col(c) for c in ("a", "b", "a_n", "b_n", "a_regs", "b_regs")}, fields, block)


def confirm(pairs: DataFrame, texts: DataFrame, least: int = LEAST) -> DataFrame:
    """``a, b`` of the pairs whose full sets are linked."""
    fields = {"a": "long", "b": "long"}

    def block(a_ids: list, b_ids: list, a_texts: list, b_texts: list) -> dict[str, list]:
        keep = []
        for i, (x, y) in enumerate(zip(a_texts, b_texts)):
            x, y = shingle_set(x), shingle_set(y)
            if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least):
                keep.append(i)
        return {"a": [a_ids[i] for i in keep], "b": [b_ids[i] for i in keep]}

    joined = with_texts(pairs, texts, "a", "b")
    return map_blocks(joined, {c: F.col(c) for c in ("a", "b", "left_text", "right_text")}, fields, block, _BLOCK)


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) of every id in ``links`` (a, b)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")).checkpoint()
    while True:
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = labels.join(jump, "component").select("id", "root")
        near = both.join(jumped.select(F.col("id").alias("b"), F.col("root")), "b").groupBy("a").agg(F.min("root").alias("low"))
        moved = jumped.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("root", "low").alias("component"))
        after = moved.checkpoint()
        changed = after.join(labels.select("id", F.col("component").alias("was")), "id").filter("component <> was")
        done = changed.isEmpty()
        labels = after
        if done:
            return labels


def signed_and_joined(df: DataFrame, id_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """``signatures`` of all rows; ``id, component`` of the documents that are linked with others."""
    ensure_checkpoint_dir(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = signatures(docs).checkpoint()
    named = signed.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = named.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")).checkpoint()
    pairs = hub_pairs(rare_bands(bands(classes, least), classes, least)).checkpoint()
    texts = texts_of(docs, pairs, "hub", "id").checkpoint()
    compared = compare_with_hub(pairs, texts, least).checkpoint()
    same_id = named.select("doc_id", "key").join(classes.select("key", "id"), "key").filter("doc_id <> id")
    links = compared.filter("linked").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    joined = components(links.unionByName(same_id.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))))
    open_pairs = likely(prefix_pairs(compared, joined, least), classes, least).checkpoint()
    more = confirm(open_pairs, texts_of(texts.withColumnRenamed("id", "doc_id"), open_pairs, "a", "b"), least).checkpoint()
    links = joined.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more)
    return signed, components(links)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    signed, found = signed_and_joined(df, id_col, text_col, least)
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``df`` with the smallest id of their component, one row an id; rows with null ids all stay. Most rows that stay
    are not shuffled: only those whose ids are dropped or repeated, and the few that ``maybe_among`` takes for them."""
    signed, found = signed_and_joined(df, id_col, text_col, least)
    dropped = found.filter("id <> component").select(F.col("id").alias("dropped"))
    repeated = signed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    touched = F.coalesce(maybe_among(dropped.unionByName(repeated.select(F.col("doc_id").alias("dropped"))))(df[id_col].cast("long")), F.lit(False))
    named = df.filter(touched).join(dropped, df[id_col].cast("long") == dropped["dropped"], "left_anti").dropDuplicates([id_col])
    return df.filter(~touched).unionByName(named)
