"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its words (lower-cased, digits and edge signs kept apart) hashed to ``WORD_SLOTS`` slots with log
frequencies at unit length, and some twenty statistics of its structure and of its row's length column, each cut into bins
with one slot per bin. The score is the logistic of ``w0 + w.x + 1/2 sum_f ((V_f.x)^2 - (V_f^2).(x^2))``: the
sum-of-squares identity gives all pairwise interactions in time linear in the features of the text.

The model is fitted by mini-batch Adam over a bounded sample of labelled rows (``sample_rows``, in expectation: rows are drawn
by a hash of their id at a rate that follows from their count). Everything is deterministic.

Defined results: null and empty texts are scored by their statistics alone. A row labelled twice counts by the mean of its
labels; an even mean is left out. Without labels of both kinds the score is the share of label 1 (0.5 without any). Each
input row gives one output row, repeated rows and null ids included; rows with null ids are never learned from.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import map_blocks

WORD_SLOTS = 1 << 14
BINS = 10
#: Statistics and the largest value that their bins tell apart (the last bin is open).
STATISTICS = {
    "log_chars": 14.0, "log_words": 12.0, "log_lines": 10.0, "upper_share": 1.0, "digit_share": 0.5, "letter_share": 1.0,
    "sign_share": 0.5, "white_share": 0.5, "wide_share": 0.5, "mean_word": 15.0, "distinct_words": 1.0, "top_word": 1.0,
    "upper_words": 1.0, "signed_words": 1.0, "lone_signs": 0.5, "sentence_ends": 0.5, "distinct_lines": 1.0,
    "mean_line": 400.0, "longest_word": 60.0, "stated_length": 14.0,
}
SLOTS = WORD_SLOTS + len(STATISTICS) * (BINS + 1)
FIELDS = {"doc_id": "long", "held_out": "boolean", "score": "double", "predicted": "int"}
_SIGNED = "*$%&#!^~|<>=@"
#: Sets of bytes that are counted apart: A-Z, 0-9, a-z, ASCII signs, first bytes of longer characters.
_BYTE_SETS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"abcdefghijklmnopqrstuvwxyz", string.punctuation.encode(), bytes(range(0xC2, 0xF5)))
_BYTE_KINDS = np.zeros(256, np.int64)
for _kind, _set in enumerate(_BYTE_SETS, 1):
    _BYTE_KINDS[list(_set)] = _kind
_EDGE = string.punctuation


_known: dict[str, int] = {}
_KNOWN_WORDS = 500_000
_FLAGS = 4


def word_facts(word: str) -> int:
    """Slot, then flags (upper case, ends in a sign, nothing but signs, ends a sentence), then the length, in one number."""
    if (facts := _known.get(word)) is None:
        bare = word.strip(_EDGE)
        slot = zlib.crc32(bare.lower().encode("utf-8", "surrogatepass")) % WORD_SLOTS
        flags = word.isupper() | (word[-1] in _SIGNED) << 1 | (not bare) << 2 | (word[-1] in ".?") << 3
        facts = (len(word) << _FLAGS | flags) * WORD_SLOTS + slot
        if len(word) <= 48:
            if len(_known) >= _KNOWN_WORDS:
                _known.clear()
            _known[word] = facts
    return facts


def features(text: str | None, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one text."""
    text = text or ""
    counts = Counter(text.split())
    n = np.fromiter(counts.values(), np.float64, len(counts))
    facts = np.fromiter(map(word_facts, counts), np.int64, len(counts))
    slots, back = np.unique(facts % WORD_SLOTS, return_inverse=True)
    facts //= WORD_SLOTS
    lengths = facts >> _FLAGS
    values = np.log1p(np.bincount(back, n, len(slots)))
    values /= max(1e-12, float(np.linalg.norm(values)))
    size, words = len(text), float(n.sum())
    per_word = 1 / words if words else 0.0
    per_char = 1 / size if size else 0.0
    length = float(lengths @ n)
    upper, signed, lone, ends = (float((facts >> i & 1) @ n) for i in range(_FLAGS))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_BYTE_KINDS[raw], minlength=len(_BYTE_SETS) + 1)
    lines = text.split("\n")
    measured = [
        math.log1p(size), math.log1p(words), math.log1p(len(lines)), kinds[1] * per_char, kinds[2] * per_char,
        (kinds[1] + kinds[3] + kinds[5]) * per_char, kinds[4] * per_char, (size - length) * per_char, (len(raw) - size) * per_char,
        length * per_word, len(counts) * per_word, float(n.max(initial=0)) * per_word, upper * per_word, signed * per_word,
        lone * per_word, ends * per_word, len(set(lines)) / len(lines), size / len(lines), float(lengths.max(initial=0)),
        None if stated is None else math.log1p(max(0, stated)),
    ]
    bins = [BINS if v is None else min(BINS - 1, int(BINS * v / top)) for v, top in zip(measured, STATISTICS.values())]
    places = np.array([WORD_SLOTS + i * (BINS + 1) + b for i, b in enumerate(bins)], np.int32)
    return np.concatenate([slots.astype(np.int32), places]), np.concatenate([values, np.full(len(places), 0.5)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # slots x rank

    def raw(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic and the factor sums, of rows that begin at ``starts``; no row is empty."""
        weighted = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(weighted, starts, axis=0)
        squares = np.add.reduceat(weighted**2, starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[slots] * values, starts) + 0.5 * (sums**2 - squares).sum(axis=1), sums


def stack(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(slots) for slots, _ in rows]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), starts


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 12, batch: int = 128,
          rate: float = 0.02, decay: float = 1e-5) -> Machine:
    mean = float(labels.mean()) if len(labels) else 0.5
    random = np.random.default_rng(7)
    model = Machine(math.log((mean + 1e-6) / (1 - mean + 1e-6)), np.zeros(SLOTS), random.normal(0, 0.02, (SLOTS, rank)))
    if not len(labels) or mean in (0.0, 1.0):
        model.factors[:] = 0
        return model
    weight = np.where(labels == 1, 0.5 / mean, 0.5 / (1 - mean))
    moments = [np.zeros(SLOTS), np.zeros(SLOTS), np.zeros((SLOTS, rank)), np.zeros((SLOTS, rank))]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for start in range(0, len(rows), batch):
            pick = order[start : start + batch]
            slots, values, starts = stack([rows[i] for i in pick])
            raw, sums = model.raw(slots, values, starts)
            error = (logistic(raw) - labels[pick]) * weight[pick] / len(pick)
            sizes = np.diff(np.append(starts, len(slots)))
            row = np.repeat(np.arange(len(pick)), sizes)
            touched, back = np.unique(slots, return_inverse=True)
            slope = error[row] * values
            linear = np.bincount(back, slope, len(touched)) + decay * model.linear[touched]
            pull = slope[:, None] * (sums[row] - model.factors[slots] * values[:, None])
            factors = np.stack([np.bincount(back, pull[:, f], len(touched)) for f in range(rank)], axis=1) + decay * model.factors[touched]
            step += 1
            model.bias -= rate * 0.1 * float(error.sum())
            for grad, weights, m, v in ((linear, model.linear, moments[0], moments[1]), (factors, model.factors, moments[2], moments[3])):
                m[touched] = 0.9 * m[touched] + 0.1 * grad
                v[touched] = 0.999 * v[touched] + 0.001 * grad**2
                weights[touched] -= rate * (m[touched] / (1 - 0.9**step)) / (np.sqrt(v[touched] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, length_col: str, sample_rows: int) -> Machine:
    """``labels``: id and label of the rows that may be learned from."""
    rows = labels.groupBy("id").agg(F.avg("label").alias("label")).filter(F.col("label") != 0.5)
    rate = min(1.0, sample_rows / max(1, rows.count()))
    drawn = rows.filter(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("quality sample")), F.lit(1_000_000)) < int(rate * 1_000_000) + 1)
    drawn = drawn.select(F.col("id").alias("label_id"), F.col("label").alias("y"))
    fields = {"y": "double", "slots": "binary", "values": "binary"}

    def block(texts: list, stated: list, ys: list) -> dict[str, list]:
        made = [features(t, n) for t, n in zip(texts, stated)]
        return {"y": ys, "slots": [s.tobytes() for s, _ in made], "values": [v.tobytes() for _, v in made]}

    # the drawn labels are bounded by sample_rows, so they may go to every task and no text is shuffled
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(length_col).cast("long").alias("stated"))
    joined = docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))
    columns = {name: F.col(name) for name in ("text", "stated", "y")}
    found = sorted(map_blocks(joined, columns, fields, block).collect())
    made = [(np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float64)) for r in found]
    return train(made, np.array([float(r[0] > 0.5) for r in found]))


def score_quality(df: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                  length_col: str = "n_chars", sample_rows: int = 6000) -> DataFrame:
    """One row per input row with the columns of ``FIELDS``. ``labels``: ``id, label`` of the rows to learn from."""
    model = fit(df, labels, id_col, text_col, length_col, sample_rows)

    def block(ids: list, texts: list, stated: list, out: list) -> dict[str, list]:
        if not ids:
            return {name: [] for name in FIELDS}
        raw, _ = model.raw(*stack([features(t, n) for t, n in zip(texts, stated)]))
        scores = [round(s, 6) for s in logistic(raw).tolist()]
        return dict(zip(FIELDS, [ids, out, scores, [int(s >= 0.5) for s in scores]]))

    columns = {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col), "stated": F.col(length_col).cast("long"), "held_out": held_out}
    return map_blocks(df, columns, FIELDS, block)
