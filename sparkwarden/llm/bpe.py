"""Byte-level BPE encoding and decoding with a public rank file, without regular expressions.

Pre-tokenisation works on arrays. The texts of a block become one array of code points; a table gives each its class; every
class is a transition function on the few states of the split pattern. Composition of these functions is associative and
the functions it can reach are few, so they are numbered once, composed through a table, and a two-level prefix scan gives the
state before every character. A token starts where state and class say so; only white space also needs the next class.
The slices are looked up in a cache of merged pieces; a missing piece is merged pair by pair, lowest rank first, leftmost on
ties. Token ids and the end of each token in bytes are kept side by side, so any run of tokens decodes to its slice.

Defined results: a null text counts as empty: no tokens. Each input row gives one output row, repeated rows and null ids
included. Text is taken as UTF-8 of whatever code points it holds. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import map_blocks

# Character classes. BREAK stands between texts. SHORT and LONG are apostrophes before one or two letters of a contraction.
BREAK, LETTER, NUMBER, SPACE, WHITE, OTHER, SHORT, LONG = range(8)
# States: what the character before belongs to. LEFT2 and LEFT1: so many letters of a contraction are still to come.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, LEFT2, LEFT1, CONTRACTED = range(9)
#: The white space of the pattern's ``\s`` beyond ASCII.
WIDE_WHITE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters that follow the apostrophe of a contraction.
SHORT_ENDS, LONG_ENDS = "stmd", ("re", "ve", "ll")
_STRIP = 128
_ID_BITS = 20
#: A piece of up to so many bytes is kept in the cache. When the young half holds so many pieces it becomes the old half.
CACHED_BYTES, CACHED_PIECES = 48, 100_000
#: Texts are split in blocks of about so many bytes, as the arrays take some forty bytes a character.
BLOCK_BYTES = 1 << 20
#: Longer pieces are merged with a heap.
SHORT_BYTES = 64
FIELDS = {"doc_id": "long", "n_tokens": "long", "ids": "binary", "ends": "binary"}


@cache
def class_table() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.uint8)
    table[kinds == ord("L")] = LETTER
    table[kinds == ord("N")] = NUMBER
    table[[9, 10, 11, 12, 13, *WIDE_WHITE]] = WHITE
    table[32] = SPACE
    return table


def _step(state: int, kind: int) -> int:
    if kind == BREAK:
        return START
    if state == LEFT2:
        return LEFT1
    if state == LEFT1:
        return CONTRACTED
    if kind in (SHORT, LONG):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS
        return LEFT1 if kind == SHORT else LEFT2
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE, OTHER: IN_OTHERS}[kind]


def _starts(state: int, kind: int) -> bool:
    """A token starts here; for white space after white space this is decided by what comes next."""
    if kind == BREAK or state in (LEFT2, LEFT1):
        return False
    if state == AFTER_SPACE:
        return False
    if kind in (SPACE, WHITE):
        return state != AFTER_WHITE
    same = {IN_LETTERS: (LETTER,), IN_NUMBERS: (NUMBER,), IN_OTHERS: (OTHER, SHORT, LONG)}
    return kind not in same.get(state, ())


@cache
def transition_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Composition of the functions, what each makes of START, whether a token starts by state and class, the identity."""
    functions = [tuple(_step(s, kind) for s in range(9)) for kind in range(8)]
    functions.append(tuple(range(9)))
    number = {}
    for f in functions:
        number.setdefault(f, len(number))
    known = list(number)
    at = 0
    while at < len(known):
        for g in functions:
            made = tuple(g[s] for s in known[at])
            if made not in number:
                number[made] = len(known)
                known.append(made)
        at += 1
    compose = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], np.uint16)
    generators = np.array([number[f] for f in functions], np.uint16)
    starts = np.array([[_starts(s, kind) for kind in range(8)] for s in range(9)])
    return compose, np.array([f[START] for f in known], np.uint8), starts, generators


def states_before(classes: np.ndarray) -> np.ndarray:
    """State before every character by a two-level scan: down the strips, over their totals, and down again."""
    compose, from_start, _, generators = transition_tables()
    identity = generators[8]
    columns = -(-len(classes) // _STRIP)
    grid = np.full(columns * _STRIP, identity, np.uint16)
    grid[: len(classes)] = generators[classes]
    grid = np.ascontiguousarray(grid.reshape(columns, _STRIP).T)
    for row in range(1, _STRIP):
        grid[row] = compose[grid[row - 1], grid[row]]
    totals, reach = grid[-1].copy(), 1
    while reach < columns:
        totals[reach:] = compose[totals[:-reach], totals[reach:]]
        reach *= 2
    ahead = np.concatenate([[identity], totals[:-1]]).astype(np.uint16)
    after = from_start[compose[ahead[None, :], grid]].T.reshape(-1)
    return np.concatenate([[START], after[: len(classes) - 1]]).astype(np.uint8)


def classify(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    classes = class_table()[points]
    classes[breaks] = BREAK
    quotes = np.flatnonzero(points == ord("'"))
    quotes = quotes[classes[quotes] != BREAK]
    if len(quotes):
        padded = np.concatenate([points, [0, 0]])
        next1, next2 = padded[quotes + 1], padded[quotes + 2]
        long_one = np.zeros(len(quotes), bool)
        for pair in LONG_ENDS:
            long_one |= (next1 == ord(pair[0])) & (next2 == ord(pair[1]))
        classes[quotes[long_one]] = LONG
        classes[quotes[np.isin(next1, [ord(c) for c in SHORT_ENDS])]] = SHORT
    return classes


def token_starts(classes: np.ndarray) -> np.ndarray:
    """Mask of the characters that start a pre-token; every text ends in a BREAK."""
    starts = transition_tables()[2][states_before(classes), classes]
    white = (classes == SPACE) | (classes == WHITE)
    follows = np.concatenate([[False], white[:-1]]) & white
    next_solid = np.concatenate([~white[1:] & (classes[1:] != BREAK), [False]])
    starts[follows] = next_solid[follows]
    return starts


def cut_long(text: str) -> Iterator[str]:
    """Parts of about a block. A space between two other characters always starts a token, whatever came before."""
    start = 0
    while len(text) - start > BLOCK_BYTES:
        cut = text.find(" ", start + BLOCK_BYTES // 2)
        while cut >= 0 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def split_texts(texts: list[str]) -> list[list[bytes]]:
    """Pre-tokens of every text, as UTF-8."""
    joined = "\0".join(texts) + "\0"
    raw = joined.encode("utf-8", "surrogatepass")
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
    classes = classify(points, breaks)
    widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(widths)])
    cuts = token_starts(classes)
    cuts[breaks] = True
    at = np.flatnonzero(cuts)
    edges = offsets[at].tolist()
    last = np.searchsorted(at, breaks).tolist()
    out, first = [], 0
    for end in last:
        out.append([raw[a:b] for a, b in zip(edges[first:end], edges[first + 1 : end + 1])])
        first = end + 1
    return out


def merge(piece: bytes, ranks: dict[bytes, int], joins: dict[int, int]) -> list[int]:
    """Token ids of a piece: the pair of lowest rank merges first, the leftmost of equal ones."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    return merge_short(piece, ranks, joins) if len(piece) <= SHORT_BYTES else merge_long(piece, ranks)


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """Two token ids side by side -> the token they join to, for every way to cut a token into two."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left << _ID_BITS | right] = rank
    return out


def merge_short(piece: bytes, ranks: dict[bytes, int], joins: dict[int, int]) -> list[int]:
    """Quadratic in the piece, but with little work per step."""
    find, none = joins.get, 1 << 40
    ids = [ranks[piece[i : i + 1]] for i in range(len(piece))]
    pairs = [find(a << _ID_BITS | b, none) for a, b in zip(ids, ids[1:])]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        ids[i] = low
        del ids[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = find(low << _ID_BITS | ids[i + 1], none)
        if i:
            pairs[i - 1] = find(ids[i - 1] << _ID_BITS | low, none)
    return ids


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """A heap of candidate pairs: n log n in the piece."""
    size = len(piece)
    after = list(range(1, size + 1))  # start of the next part; parts are named by their first byte
    before = list(range(-1, size - 1))
    heap = [(rank, i, i + 2) for i in range(size - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(size)
    while heap:
        _, i, end = heapq.heappop(heap)
        if gone[i] or after[i] >= size or after[after[i]] != end:
            continue
        right = after[i]
        gone[right] = 1
        after[i] = end
        if end < size:
            before[end] = i
            if (rank := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (rank, i, after[end]))
        if before[i] >= 0:
            if (rank := ranks.get(piece[before[i] : end])) is not None:
                heapq.heappush(heap, (rank, before[i], end))
    out, i = [], 0
    while i < size:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Vocabulary:
    """Ranks of a tiktoken-style file: a base64 token and its rank per line."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t or b"") for t in self.tokens], np.int64)
        self.joins = pair_table(self.ranks)
        self.pieces: dict[bytes, bytes] = {}
        self.old_pieces: dict[bytes, bytes] = {}

    def ids_of(self, piece: bytes) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            if (ids := self.old_pieces.get(piece)) is None:
                ids = array("I", merge(piece, self.ranks, self.joins)).tobytes()
            if len(piece) <= CACHED_BYTES:
                if len(self.pieces) >= CACHED_PIECES:
                    self.old_pieces, self.pieces = self.pieces, {}
                self.pieces[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [part for text in texts for part in cut_long(text)]
        coded = [b"".join(map(self.ids_of, pieces)) for pieces in split_texts(parts)] if parts else []
        at, out = 0, []
        for text in texts:
            n = sum(1 for _ in cut_long(text))
            out.append(np.frombuffer(b"".join(coded[at : at + n]), "<u4"))
            at += n
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@cache
def vocabulary(path: str) -> Vocabulary:
    """One per process; the file is part of the installation of every worker, like any library's data."""
    return Vocabulary(path)


def encode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, ends``: little-endian unsigned 32-bit token ids and the byte offset where each token ends."""

    def block(ids: list, texts: list) -> dict[str, list]:
        known = vocabulary(ranks_path)
        coded = known.encode([t or "" for t in texts])
        ends = [np.cumsum(known.lengths[c]).astype("<u4").tobytes() for c in coded]
        return {"doc_id": ids, "n_tokens": [len(c) for c in coded], "ids": [c.tobytes() for c in coded], "ends": ends}

    return map_blocks(df, {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col)}, FIELDS, block, BLOCK_BYTES)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with the bytes that its ids stand for as ``decoded``; token i is ``decoded[ends[i-1]:ends[i]]``."""
    fields = {**FIELDS, "decoded": "binary"}

    def block(doc_ids: list, counts: list, ids: list, ends: list) -> dict[str, list]:
        known = vocabulary(ranks_path)
        decoded = [known.decode(np.frombuffer(x, "<u4")) for x in ids]
        return dict(zip(fields, [doc_ids, counts, ids, ends, decoded]))

    return map_blocks(encoded, {name: F.col(name) for name in FIELDS}, fields, block, BLOCK_BYTES)


def round_trip(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: texts are encoded and their ids decoded in one task, by digests.

    The same as ``encode`` and ``decode`` after each other, without carrying ids and bytes between two Python workers.
    """
    fields = {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

    def block(ids: list, texts: list) -> dict[str, list]:
        known = vocabulary(ranks_path)
        coded = known.encode([t or "" for t in texts])
        return {
            "doc_id": ids, "n_tokens": [len(c) for c in coded], "ids_sha256": [hashlib.sha256(c.tobytes()).hexdigest() for c in coded],
            "decoded_sha256": [hashlib.sha256(known.decode(c)).hexdigest() for c in coded],
        }

    return map_blocks(df, {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col)}, fields, block, BLOCK_BYTES)
