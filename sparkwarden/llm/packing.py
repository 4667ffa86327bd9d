"""Packing of tokenised documents into sequences of a fixed context: shortest-pack-first over the length histogram.

Every document is its ids and an end id. From its start, whole contexts are cut off; each is a sequence of its own. What remains
is shorter than a context, so all remainders together are described by a histogram of fewer lengths than the context has ids.
Lengths are placed longest first, each into the shortest pack that is open, if it fits there, else into a new pack. A step places
as many documents as the length and the pack both have left, so packs are counts of patterns and the plan's size depends on the
context, not on the corpus. If the packs lack more than ``PADDING`` of all ids, documents are cut: the packs that lack most are
laid end to end, and that stream is cut at every whole context. Its last ids are cut into powers of two, which need no padding.

The plan joins documents by rank: the n-th document of a length has the pieces that the plan states for ranks around n, counted on
from the sequence of the first of them. Ranks come from range partitions with carried offsets, as one length may hold most rows.

Defined results: a null or empty text is its end id alone. Rows that share an id are packed each for itself; their pieces can be
told apart by sequence and offset. Null ids are packed like others. Very long texts give a sequence per whole context. An empty
table gives no pieces. Ties: documents of one length are ranked by id, in any order among equal ids; which of several packs of
equal length is filled first changes no sequence's length. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from ..session import ensure_checkpoint_dir
from .blocks import map_blocks
from .word_tokens import tokenizer

CONTEXT = 4096
END_ID = 2
#: Padding stays below this share of all ids; documents are cut for no more than that.
PADDING = 0.001


@dataclass(frozen=True)
class Packs:
    """``count`` packs alike, each of ``used`` ids: the k-th holds, of every (length, rank) in ``docs``, the document k ranks later."""

    used: int
    count: int
    docs: tuple[tuple[int, int], ...]

    def first(self, count: int) -> Packs:
        return Packs(self.used, count, self.docs)

    def after(self, count: int) -> Packs:
        return Packs(self.used, self.count - count, tuple((length, rank + count) for length, rank in self.docs))

    def padding(self, context: int) -> int:
        """Ids that the packs lack to ``context``; packs of a power of two need none."""
        return 0 if self.used & (self.used - 1) == 0 else self.count * (context - self.used)


def shortest_pack_first(histogram: dict[int, int], context: int) -> list[Packs]:
    """Patterns with counts for ``histogram`` (length below ``context`` -> documents), nothing cut."""
    full: list[Packs] = []
    open_: list[tuple[int, int, Packs]] = []  # a heap by what is used
    made = 0

    def put(packs: Packs) -> None:
        nonlocal made
        made += 1
        if packs.used == context:
            full.append(packs)
        else:
            heapq.heappush(open_, (packs.used, made, packs))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if not open_ or open_[0][0] + length > context:
                count = -(-left // (context // length))  # the documents after these go on top of them
                put(Packs(length, count, ((length, rank),)))
            else:
                shortest = heapq.heappop(open_)[2]
                count = min(left, shortest.count)
                put(Packs(shortest.used + length, count, (*shortest.docs, (length, rank))))
                if count < shortest.count:
                    put(shortest.after(count))
            rank, left = rank + count, left - count
    return full + [packs for *_, packs in sorted(open_, key=lambda x: x[:2])]


class Plan:
    """Where every document's remainder goes, by its length and its rank among documents of that length.

    Packs that stay have a sequence each. The packs that lack most are laid end to end in one stream, which is cut at every whole
    context; its last ids are cut into powers of two. As many packs go there as keep the padding of the others within ``share``.
    """

    def __init__(self, histogram: dict[int, int], context: int = CONTEXT, share: float = PADDING):
        packed = sorted(shortest_pack_first(histogram, context), key=lambda p: -p.padding(context) / p.count)
        lost, most = sum(p.padding(context) for p in packed), share * sum(p.used * p.count for p in packed)
        self.context = context
        places: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # length -> (rank, first place, stride, streamed)
        at = sequence = 0
        for packs in packed:
            streamed = lost > most
            if streamed:
                lost -= packs.padding(context)
            offset = 0
            for length, rank in packs.docs:
                places[length].append((rank, (at if streamed else sequence * context) + offset, packs.used if streamed else context, streamed))
                offset += length
            at, sequence = at + streamed * packs.used * packs.count, sequence + (not streamed) * packs.count
        self.places = {length: sorted(found) for length, found in places.items()}
        self.kept = sequence
        #: where the stream's sequences begin after its whole contexts, and its end
        self.tail = [at - at % context]
        while self.tail[-1] < at:
            self.tail.append(self.tail[-1] + (1 << (at - self.tail[-1]).bit_length() - 1))
        self.sequences = sequence + at // context + len(self.tail) - 1

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, size, sequence, offset) by start, of the document of this length and rank."""
        if not length:
            return []
        held = self.places[length]
        first, place, stride, streamed = held[bisect_right(held, (rank, float("inf"))) - 1]
        place += (rank - first) * stride
        if not streamed:
            return [(0, length, *divmod(place, self.context))]
        out, start = [], 0
        while start < length:
            at = place + start
            if at < self.tail[0]:
                sequence, begin = at // self.context, at - at % self.context
                end = begin + self.context
            else:
                part = bisect_right(self.tail, at)
                sequence, begin, end = self.tail[0] // self.context + part - 1, self.tail[part - 1], self.tail[part]
            size = min(length - start, end - at)
            out.append((start, size, self.kept + sequence, at - begin))
            start += size
        return out


def token_rows(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, n, ids``: the ids of every row's text and the end id, in the tokenizer's narrowest width."""

    def block(ids: list, texts: list) -> dict[str, list]:
        known = tokenizer(path)
        end = np.array([end_id], known.dtype).tobytes()
        found = [x.tobytes() + end for x in known.encode(texts)]
        return {"doc_id": ids, "n": [len(x) // known.dtype.itemsize for x in found], "ids": found}

    columns = {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}
    return map_blocks(docs, columns, {"doc_id": "long", "n": "long", "ids": "binary"}, block, 1 << 20)


def pack(tokens: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of every piece of ``tokens`` (doc_id, n, ids).

    ``ids`` are little-endian unsigned 32-bit. Sequences of remainders are numbered from 0; a whole context's sequence is numbered
    after them by its document's place in the table and its own place in the document, which leaves gaps.
    """
    ensure_checkpoint_dir(tokens.sparkSession)
    held = tokens.select("doc_id", "n", "ids").withColumn("at", F.monotonically_increasing_id()).checkpoint()
    sizes = held.select("at", "doc_id", "n", (F.col("n") % context).alias("rest"))  # ids stay where they are until their place is known
    ranked = numbered(sizes, ["rest"], ["doc_id", "n"], "rank", position="place").select("at", "n", "rest", "rank", "place")
    counted = ranked.groupBy("rest").agg(F.count(F.lit(1)).alias("docs"), F.max(F.floor(F.col("n") / context)).alias("wholes")).collect()
    plan = Plan({r["rest"]: r["docs"] for r in counted if r["rest"]}, context)  # at most one row per length below the context
    each = max((r["wholes"] for r in counted), default=0)
    if sum(r["docs"] for r in counted) * each >= 1 << 62:
        raise OverflowError("sequences cannot be numbered in 64 bits")
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    fields = {name: "binary" if name == "ids" else "long" for name in names}

    def block(doc_ids: list, sizes: list, blobs: list, rests: list, ranks: list, places: list) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in names}
        for doc_id, n, blob, rest, rank, place in zip(doc_ids, sizes, blobs, rests, ranks, places):
            ids = np.frombuffer(blob, f"<u{len(blob) // n}").astype("<u4")
            whole = n - rest
            found = [(k * context, context, plan.sequences + place * each + k, 0) for k in range(whole // context)]
            found += [(whole + start, *piece) for start, *piece in plan.pieces(rest, rank)]
            for start, size, sequence, offset in found:
                for name, value in zip(names, (doc_id, start, size, ids[start : start + size].tobytes(), n, sequence, offset)):
                    out[name].append(value)
        return out

    placed = held.join(ranked.drop("n"), "at")
    return map_blocks(placed, {c: F.col(c) for c in ("doc_id", "n", "ids", "rest", "rank", "place")}, fields, block, 1 << 20)


def pack_documents(docs: DataFrame, path: str, context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text), tokenised by the file at ``path``."""
    return pack(token_rows(docs, path, end_id), context)


def sequences(pieces: DataFrame, context: int = CONTEXT, pad_id: int = 0) -> DataFrame:
    """``sequence_id, doc_ids, ends, ids``: one row per training sequence, with its documents and the offsets at which they end.

    A sequence is padded to ``context`` unless its length is a power of two. At most ``context`` pieces meet in one row.
    """
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(held.alias("pieces"), F.sum("length").alias("used"))
    lacking = F.when(F.bit_count("used") == 1, F.lit(0)).otherwise(context - F.col("used")).cast("int")
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), lacking))
    ids = F.concat(F.unhex(F.array_join(F.transform("pieces", lambda p: F.hex(p["ids"])), "")), pad)
    ends = F.transform("pieces", lambda p: p["offset"] + p["length"])
    return rows.select("sequence_id", F.col("pieces.doc_id").alias("doc_ids"), ends.alias("ends"), ids.alias("ids"))
