"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are brought to one form: lower case, runs of anything but letters, digits and other non-ASCII characters
become one space. An item of m characters may occur with up to ``k = m * error_rate`` edits. It is split into k + 1 pieces, so
an occurrence holds at least one of them unchanged. One Aho-Corasick automaton finds the pieces of all items. A hit climbs a
balanced tree over the item's pieces: a node of j pieces may hold j - 1 errors, as its two children cannot both hold more than
their own budgets; Myers' bit-parallel distance checks each node in the window around the hit, and most false hits end at the
first one. The root's check is the verdict: an occurrence of the whole item within its budget.

Items travel in blocks of about ``block_chars`` characters, so what a task receives has a fixed size; documents stay where
they are and are read once per block.

Defined results: null or empty texts contain nothing; items that are null or shorter than ``min_chars`` in the common form tell
nothing and match nothing. A document row and an item give at most one row, the occurrence of the fewest edits (then the first);
repeated document rows give repeated rows; repeated items (same id and text) count once. Rows with null ids are reported with
null ids. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ddl, filter_blocks, map_blocks

ERROR_RATE = 0.1
MIN_CHARS = 20
BLOCK_CHARS = 2_000_000
FIELDS = {"doc_id": "long", "item_id": "long", "edits": "int", "start": "long", "end": "long"}
_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def common_form(text: str | None) -> str:
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN)
    return b" ".join(raw.split()).decode("utf-8", "surrogatepass")


def myers(masks: dict[str, int], size: int, text: str, budget: int) -> tuple[int, int]:
    """Fewest edits that turn the pattern into a part of ``text``, and where the first such part ends; (budget + 1, 0) if over."""
    every, high = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best, end = every, 0, size, budget + 1, 0
    for at, c in enumerate(text, 1):
        equal = masks.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (every & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & every
        minus = up & vertical & every
        if score < best:
            best, end = score, at
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


@dataclass
class Item:
    item_id: int | None
    text: str
    budget: int
    edges: list[int] = field(default_factory=list)  # piece i is text[edges[i]:edges[i + 1]]
    paths: list[list[tuple[int, int]]] = field(default_factory=list)  # piece -> nodes above it, as piece ranges
    masks: dict[tuple[int, int], dict[str, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        pieces = self.budget + 1
        self.edges = [i * len(self.text) // pieces for i in range(pieces + 1)]
        self.paths = [[] for _ in range(pieces)]
        ranges = [(0, pieces)]
        while ranges:
            low, high = ranges.pop()
            for piece in range(low, high):
                self.paths[piece].insert(0, (low, high))
            if high - low > 1:
                middle = (low + high + 1) // 2
                ranges += [(low, middle), (middle, high)]

    def match_at(self, text: str, piece: int, start: int) -> tuple[int, int] | None:
        """Edits and end of an occurrence around the hit of a piece at ``start``; None if a node is over its budget."""
        edits, end = 0, start + self.edges[piece + 1] - self.edges[piece]
        for low, high in self.paths[piece]:
            if high - low == 1 and self.budget:
                continue  # the hit itself
            budget = high - low - 1
            first = max(0, start - (self.edges[piece] - self.edges[low]) - budget)
            window = text[first : start + self.edges[high] - self.edges[piece] + budget]
            pattern = self.text[self.edges[low] : self.edges[high]]
            if (masks := self.masks.get((low, high))) is None:
                masks = self.masks[(low, high)] = masks_of(pattern)
            edits, stop = myers(masks, len(pattern), window, budget)
            if edits > budget:
                return None
            end = first + stop
        return edits, end

    def start_of(self, text: str, end: int, edits: int) -> int:
        """The latest start of an occurrence of so few edits that ends at ``end``."""
        window = text[max(0, end - len(self.text) - edits) : end][::-1]
        return end - myers(masks_of(self.text[::-1]), len(self.text), window, edits)[1]


def automaton_of(items: list[Item]) -> ahocorasick.Automaton:
    pieces: dict[str, list[tuple[int, int]]] = {}
    for i, item in enumerate(items):
        for piece, (a, b) in enumerate(zip(item.edges, item.edges[1:])):
            pieces.setdefault(item.text[a:b], []).append((i, piece))
    found = ahocorasick.Automaton()
    for piece, owners in pieces.items():
        found.add_word(piece, (len(piece), owners))
    found.make_automaton()
    return found


def find_items(text: str, items: list[Item], pieces: ahocorasick.Automaton) -> list[tuple[int, int, int, int]]:
    """(item, edits, start, end) of the best occurrence of every item in a text of the common form."""
    best: dict[int, tuple[int, int]] = {}
    for last, (size, owners) in pieces.iter(text):
        for i, piece in owners:
            item, start = items[i], last + 1 - size
            if i in best and best[i][0] == 0:
                continue
            if (hit := item.match_at(text, piece, start)) and (i not in best or hit < best[i]):
                best[i] = hit
    return [(i, edits, items[i].start_of(text, end, edits), end) for i, (edits, end) in sorted(best.items())]


def prepared(rows: list[tuple[int | None, str]], error_rate: float, min_chars: int) -> list[Item]:
    plain = ((item_id, common_form(text)) for item_id, text in rows)
    return [Item(item_id, text, int(len(text) * error_rate)) for item_id, text in plain if len(text) >= max(1, min_chars)]


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, item_id, edits, start, end``: occurrences of items in documents, offsets in the common form."""
    columns = {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col)}
    found = None
    for known in item_blocks(benchmark, item_col, item_text_col, error_rate, min_chars, block_chars):

        def block(ids: list, texts: list, known: _Block = known) -> dict[str, list]:
            out: list[tuple] = []
            for doc_id, text in zip(ids, texts):
                out += [(doc_id, *hit) for hit in known.find(text)]
            return dict(zip(FIELDS, zip(*out))) if out else {name: [] for name in FIELDS}

        hits = map_blocks(docs, columns, FIELDS, block)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], ddl(FIELDS))
    return found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged."""
    for known in item_blocks(benchmark, item_col, item_text_col, error_rate, min_chars, block_chars):
        docs = filter_blocks(docs, text_col, lambda texts, known=known: [not known.find(text) for text in texts])
    return docs


def item_blocks(
    benchmark: DataFrame, item_col: str, item_text_col: str, error_rate: float, min_chars: int, block_chars: int
) -> Iterator[_Block]:
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text"))
    items = items.filter(F.col("item_text").isNotNull()).distinct()
    chars = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    for at in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == at).collect()
        yield _Block(sorted((tuple(r) for r in rows), key=repr), error_rate, min_chars)


class _Block:
    """Items of one block; the automaton is built where it is used, once per task."""

    def __init__(self, rows: list[tuple], error_rate: float, min_chars: int) -> None:
        self.rows, self.error_rate, self.min_chars = rows, error_rate, min_chars
        self.items: list[Item] | None = None

    def find(self, text: str | None) -> list[tuple]:
        if self.items is None:
            self.items = prepared(self.rows, self.error_rate, self.min_chars)
            self.pieces = automaton_of(self.items) if self.items else None
        if not self.items or not text:
            return []
        return [(self.items[i].item_id, *rest) for i, *rest in find_items(common_form(text), self.items, self.pieces)]
