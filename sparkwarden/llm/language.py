"""Language identification by nearest centroid over TF-IDF n-gram vectors.

A text is lower-cased, everything but letters becomes one gap, and its character 1-, 2- and 3-grams are hashed to a fixed
number of slots by array arithmetic. A vector holds log term frequencies times inverse document frequencies, at unit length.
Each language has several centroids (spherical k-means over all of its training texts). A text gets the
language of the centroid with the highest cosine; it is rejected when even that cosine lies below the cut for its length, or
when it has no letter. Lengths are bins of the number of distinct n-grams, so a word said a thousand times is as short as the
word. The cut of a bin is calibrated on all training texts and on all their pieces: the neighbouring runs of 1, 2, 4, ... words
that a text falls into.

Document frequencies, centroids and cuts come from every training text. Only where k-means starts is found on a sample, bounded
by ``sample_per_language`` (in expectation: texts are drawn by a hash of their id, at a rate that follows from the language's
count); ``ROUNDS`` passes over all texts then move the centroids to the means of their members. Sums are of whole numbers, so
they do not depend on how the table is cut; cuts are exact to half a ``LEVELS``-th.

Defined results: ``und`` with score 0 and rejected for a null text or one without letters. Other texts get a learned language
also when rejected, with the cosine as score; without any training text they get ``und``, score 0, and are not rejected. Ties go to the language first in
alphabetical order. Each input row gives one output row, repeated rows and null ids included; rows with null ids are never
learned from.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import arrow_schema, ddl, filter_blocks, in_tasks, map_blocks, slices

SLOTS = 4096
UNKNOWN = "und"
FIELDS = {"doc_id": "long", "held_out": "boolean", "lang_pred": "string", "score": "double", "rejected": "boolean"}
#: A text is rejected below this share of the cosine that all but a thousandth of the calibration texts of its length reach;
#: the other half is left to texts of a learned language in a style that was not.
REJECT_SHARE = 0.5
#: Bins with fewer calibration texts take the cut of the next shorter bin.
LEAST_CALIBRATION = 50
#: Neighbouring words whose runs are worked out at once, a power of two; longer texts go on with the runs of that length.
_SEGMENT = 1 << 14
#: Products of words with centroids that are held at once.
_CELLS = 1 << 22
#: Up to runs of two to this power of words, products come from those of the halves; those of longer runs from all their n-grams.
_SHORT = 4
#: Passes of k-means over all training texts.
ROUNDS = 2
#: Steps of a cosine in the counts behind the cuts.
LEVELS = 2000
#: Unit vectors are added up in whole multiples of this.
_GRAIN = 2.0**-24
_ROWS = 256
_GAP = 0


@cache
def letter_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter, or 0."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams; None if the text has no letter."""
    points = letter_table()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not points.any():
        return None
    points, at = _gapped(points)
    two = _twos(points)[(points[:-1] != _GAP) | (points[1:] != _GAP)]
    codes = np.concatenate([_ones(points[at]), two, _threes(points)[at - 1]])
    return np.bincount(_slots(codes), minlength=SLOTS)


def _gapped(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points with one gap in front and behind every run of letters, and where the letters stand in them."""
    inside = points != _GAP
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one gap behind every run of letters
    points = np.concatenate([[_GAP], points[keep], [_GAP]]).astype(np.uint32)
    return points, np.flatnonzero(points)


def _ones(points: np.ndarray) -> np.ndarray:
    return points * np.uint32(2654435761)


def _twos(points: np.ndarray) -> np.ndarray:
    return points[:-1] * np.uint32(2246822519) + points[1:] * np.uint32(3266489917) + np.uint32(1)


def _threes(points: np.ndarray) -> np.ndarray:
    return points[:-2] * np.uint32(668265263) + points[1:-1] * np.uint32(374761393) + points[2:] * np.uint32(2869860233) + np.uint32(2)


def _slots(codes: np.ndarray) -> np.ndarray:
    codes ^= codes >> np.uint32(15)
    codes *= np.uint32(2146121005)
    return codes >> np.uint32(20)


def unit_rows(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts.astype(np.float32)) * idf.astype(np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Centroids:
    languages: tuple[str, ...]
    owner: np.ndarray  # centroid -> place in languages
    rows: np.ndarray
    idf: np.ndarray
    least_cosine: float
    cuts: np.ndarray | None = None  # per length bin; without them least_cosine holds for all lengths

    def cut(self, counts: np.ndarray) -> float:
        return self.least_cosine if self.cuts is None else float(self.cuts[length_bin(counts)])


def length_bin(counts: np.ndarray) -> int:
    """Half octaves of the number of distinct n-grams, at least one."""
    return int(2 * np.log2(np.count_nonzero(counts)))


def spherical_clusters(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit length; seeds are spread by taking the row least like those taken before."""
    centre = rows.mean(axis=0)
    seeds = [int(np.argmax(rows @ centre))]
    near = rows @ rows[seeds[0]]
    while len(seeds) < min(k, len(rows)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[seeds[-1]])
    found = rows[seeds].copy()
    for _ in range(rounds):
        member = np.argmax(rows @ found.T, axis=1)
        for c in range(len(found)):
            if (own := rows[member == c]).size:
                found[c] = own.mean(axis=0)
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return found


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows of ``texts`` (text, lang): per slot the texts that hold it, and the texts with letters."""
    fields = {"slot": "int", "n": "long"}
    schema = arrow_schema(fields)

    def run(batches):
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if (counts := gram_counts(text)) is not None:
                    total[:SLOTS] += counts > 0
                    total[SLOTS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS + 1, dtype=np.int32)), pa.array(total)], schema=schema)

    out = np.zeros(SLOTS + 1, np.int64)
    for slot, n in in_tasks(texts.select("text"), run, ddl(fields)).groupBy("slot").agg(F.sum("n")).collect():
        out[slot] = n
    return out[:SLOTS], int(out[SLOTS])


def sample_counts(texts: DataFrame) -> list[tuple[str, np.ndarray]]:
    """Language and n-gram counts of every text with letters."""
    fields = {"lang": "string", "counts": "binary"}

    def block(rows: list, langs: list) -> dict[str, list]:
        kept = [(lang, c.astype("<u4").tobytes()) for lang, text in zip(langs, rows) if (c := gram_counts(text)) is not None]
        return dict(zip(fields, map(list, zip(*kept)))) if kept else {name: [] for name in fields}

    found = map_blocks(texts, {"text": F.col("text"), "lang": F.col("lang")}, fields, block)
    return [(r[0], np.frombuffer(r[1], "<u4")) for r in sorted(found.collect())]


def totals(texts: DataFrame, size: int, add: Callable[[np.ndarray, list, list], None]) -> np.ndarray:
    """``size`` whole numbers: ``add`` counts a slice's texts and languages into those of its task, Spark adds up the tasks."""
    fields = {"place": "int", "n": "long"}
    schema = arrow_schema(fields)

    def run(batches):
        own = np.zeros(size)
        for batch in slices(batches):
            add(own, batch.column(0).to_pylist(), batch.column(1).to_pylist())
        held = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(own[held].astype(np.int64))], schema=schema)

    out = np.zeros(size)
    found = in_tasks(texts.select("text", "lang"), run, ddl(fields)).groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out


def moved(texts: DataFrame, model: Centroids) -> np.ndarray:
    """The mean direction of the training texts that each centroid is the nearest of their language to; one without any stays."""
    place_of = {lang: place for place, lang in enumerate(model.languages)}

    def add(own: np.ndarray, rows: list, langs: list) -> None:
        sums = own.reshape(model.rows.shape)
        for start in range(0, len(rows), _ROWS):
            part = [(place_of[lang], c) for text, lang in zip(rows[start : start + _ROWS], langs[start : start + _ROWS])
                    if lang in place_of and (c := gram_counts(text)) is not None]
            if not part:
                continue
            units = unit_rows(np.array([c for _, c in part]), model.idf)
            cosines = units @ model.rows.T
            cosines[np.array([place for place, _ in part])[:, None] != model.owner] = -np.inf
            member = np.argmax(cosines, axis=1)
            grains = np.rint(units / np.float32(_GRAIN))
            for c in set(member.tolist()):
                sums[c] += grains[member == c].sum(axis=0, dtype=np.float64)

    sums = totals(texts, model.rows.size, add).reshape(model.rows.shape)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(norms > 0, sums / np.maximum(norms, 1), model.rows).astype(np.float32)


def piece_counts(head: str) -> Iterator[np.ndarray]:
    """``gram_counts`` of the runs of 1, 2, 4, ... words, from the start and from the middle, that have a letter.

    The plain form for single runs; what calibration takes from all runs of a text is worked out by ``reached_by_runs``. The n-grams of
    the head are hashed once: those of a run stand side by side, as words have a gap on both sides in the head, too.
    """
    words = head.split()
    points = letter_table()[np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
    letters = np.flatnonzero(points)
    if not len(letters):
        return
    points, at = _gapped(points)
    one, two, three = _slots(_ones(points[at])), _slots(_twos(points)), _slots(_threes(points)[at - 1])
    ends = np.cumsum([len(w) + 1 for w in words])
    size = 1
    while size < len(words):
        for start in {0, len(words) // size // 2 * size}:
            span = (ends[start - 1] if start else 0, ends[min(start + size, len(words)) - 1])
            lo, hi = np.searchsorted(letters, span).tolist()
            if lo < hi:
                held = (one[lo:hi], two[at[lo] - 1 : at[hi - 1] + 1], three[lo:hi])
                yield np.bincount(np.concatenate(held), minlength=SLOTS)
        size *= 2


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in ``words``, slot and count of the n-grams of each word, in this order. Those of a text are those of its words."""
    points = letter_table()[np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
    own = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])[:-1][points != _GAP]
    points, at = _gapped(points)
    two, ends = _slots(_twos(points)), points[at + 1] == _GAP
    slots = np.concatenate([_slots(_ones(points[at])), _slots(_threes(points)[at - 1]), two[at - 1], two[at[ends]]])
    keys, counts = np.unique(np.concatenate([own, own, own, own[ends]]) * SLOTS + slots, return_counts=True)
    return keys // SLOTS, keys % SLOTS, counts


@dataclass
class Runs:
    """Neighbouring runs of words: their n-grams run by run, and what their cosines with the centroids are made of."""

    sizes: np.ndarray  # distinct n-grams of a run
    slots: np.ndarray
    counts: np.ndarray
    dots: np.ndarray  # products with the centroids, by run and centroid
    squares: np.ndarray  # of the length


def runs_of_words(words: list[str], centroids: np.ndarray, idf: np.ndarray) -> Runs:
    place, slots, counts = word_grams(words)
    weights = np.log1p(counts) * idf[slots]
    sizes, dots = np.bincount(place, minlength=len(words)), np.zeros((len(words), len(centroids)))
    if len(place):
        some, starts = np.flatnonzero(sizes), np.flatnonzero(np.diff(place, prepend=-1))
        for c, row in enumerate(centroids):
            dots[some, c] = np.add.reduceat(row.take(slots) * weights, starts)
    return Runs(sizes, slots, counts, dots, np.bincount(place, weights**2, len(words)))


def reached(sizes: np.ndarray, dots: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Length bin and level of the best cosine of each run, as one number; -1 for runs without letters."""
    cosines = dots.max(axis=1) / np.maximum(np.sqrt(squares), 1e-12)
    # The millionth puts what differs by the order of sums only into one level.
    levels = np.minimum(np.clip(cosines, 0.0, 1.0) * LEVELS + 1e-6, LEVELS).astype(np.int64)
    return np.where(sizes > 0, levels + (2 * np.log2(np.maximum(sizes, 1))).astype(np.int64) * (LEVELS + 1), -1)


def merged(runs: Runs, centroids: np.ndarray, idf: np.ndarray) -> tuple[Runs, np.ndarray]:
    """All of ``runs`` as one, and what the runs of 2, 4, ... of them reach. The last one of a size may be shorter; if it is no longer
    than that of the size before, it is the same and not counted again.

    N-grams are sorted by slot and run once; a level then only leaves out the edges between those that become one. Counts add up, and
    so do products and squares but for the n-grams of both halves, which are few in short runs."""
    n = len(runs.sizes)
    levels = (n - 1).bit_length()
    if not levels or not len(runs.slots):
        return Runs(runs.sizes[-1:], runs.slots, runs.counts, runs.dots[-1:], runs.squares[-1:]), np.zeros(0, np.int64)
    order = np.argsort(runs.slots.astype(np.uint16), kind="stable")
    slots, counts, place = runs.slots[order], runs.counts[order], np.repeat(np.arange(n), runs.sizes)[order]
    new = np.concatenate([[True], slots[1:] != slots[:-1]])
    meet = np.full(len(slots) + 1, levels + 1, np.uint8)  # the level at which what stands on both sides of an edge becomes one
    meet[1:-1] = np.where(new[1:], levels + 1, np.frexp(place[1:] ^ place[:-1])[1])
    total, edges = np.concatenate([[0], np.cumsum(counts)]), np.arange(len(slots) + 1)
    logs = np.log1p(np.arange(int(np.bincount(slots, counts).max()) + 1))
    first = np.cumsum([0, *((n - 1 >> level) + 1 for level in range(1, levels + 1))]).tolist()
    sizes, dots, squares = np.zeros(first[-1], np.int64), np.zeros((first[-1], len(centroids))), np.zeros(first[-1])

    short, shared = min(levels, _SHORT), []
    for level in range(1, short + 1):
        here = meet[edges]
        at = np.flatnonzero(here == level)
        start, mid, end = total[edges[at - 1]], total[edges[at]], total[edges[at + 1]]
        one, two, both = logs[mid - start], logs[end - mid], logs[end - start]
        shared.append((first[level - 1] + (place[edges[at]] >> level), slots[edges[at]], both - one - two, both**2 - one**2 - two**2))
        edges = edges[here > level]
    to, slot, linear, square = (np.concatenate(x) for x in zip(*shared))
    weights, ends = idf[slot], first[short]
    sizes[:ends] = -np.bincount(to, minlength=ends)
    squares[:ends] = np.bincount(to, square * weights**2, ends)
    weights *= linear
    for c, row in enumerate(centroids):
        dots[:ends, c] = np.bincount(to, weights * row.take(slot), ends)
    for now, below in ((sizes, runs.sizes), (dots, runs.dots), (squares, runs.squares)):
        for lo, hi in zip(first, first[1 : short + 1]):
            now[lo:hi] += below[::2]
            now[lo : lo + len(below) // 2] += below[1::2]
            below = now[lo:hi]

    column, weight, within = np.cumsum(new) - 1, idf[slots[new]], centroids[:, slots[new]].T
    for level, (lo, hi) in enumerate(zip(first[short:], first[short + 1 :]), short + 1):
        edges = edges[meet[edges] > level]
        at = edges[:-1]
        run = place[at] >> level
        rows = np.zeros((hi - lo, len(within)))
        rows[run, column[at]] = logs[np.diff(total[edges])]
        rows *= weight
        sizes[lo:hi], dots[lo:hi], squares[lo:hi] = np.bincount(run, minlength=hi - lo), rows @ within, np.einsum("ij,ij->i", rows, rows)
    told = np.ones(first[-1], bool)
    told[[end - 1 for level, end in enumerate(first[1:]) if (n - 1 >> level) % 2 == 0]] = False
    whole = Runs(sizes[-1:], slots[edges[:-1]], np.diff(total[edges]), dots[-1:], squares[-1:])
    return whole, reached(sizes, dots, squares)[told]


def reached_by_runs(texts: list[str], centroids: np.ndarray, idf: np.ndarray) -> list[np.ndarray]:
    """What the runs of 1, 2, 4, ... words of every text reach, up to the whole text. Words that come again are worked out once."""
    out: list[np.ndarray] = []
    wholes: dict[int, list[Runs]] = {}
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    segments: list[tuple[int, np.ndarray]] = []

    def work_out() -> None:
        words = runs_of_words(list(known), centroids, idf)
        single, starts = reached(words.sizes, words.dots, words.squares), np.cumsum(words.sizes) - words.sizes
        for i, places in segments:
            sizes = words.sizes[places]
            held = np.repeat(starts[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            runs = Runs(sizes, words.slots[held], words.counts[held], words.dots[places], words.squares[places])
            whole, longer = merged(runs, centroids, idf)
            out.extend((single[places], longer))
            if i in wholes:
                wholes[i].append(whole)
        known.clear()
        segments.clear()

    for i, text in enumerate(texts):
        words = text.split()
        if len(words) > _SEGMENT:
            wholes[i] = []
        for start in range(0, len(words), _SEGMENT):
            part = words[start : start + _SEGMENT]
            segments.append((i, np.fromiter(map(known.__getitem__, part), np.int64, len(part))))
            if len(known) * len(centroids) > _CELLS:
                work_out()
    if segments:
        work_out()
    for parts in wholes.values():
        joined = Runs(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Runs)))
        out.append(merged(joined, centroids, idf)[1])
    return [x[x >= 0] for x in out]


def calibrate(texts: DataFrame, model: Centroids) -> np.ndarray:
    """The cut of every length bin, from the training texts and all their pieces."""
    bins = int(2 * np.log2(SLOTS)) + 1
    centroids = model.rows.astype(np.float64)

    def add(own: np.ndarray, rows: list, langs: list) -> None:
        own += np.bincount(np.concatenate([np.zeros(0, np.int64), *reached_by_runs(rows, centroids, model.idf)]), minlength=len(own))

    cuts, last = np.zeros(bins), 0.0
    for place, levels in enumerate(totals(texts, bins * (LEVELS + 1), add).reshape(bins, LEVELS + 1)):
        if (n := levels.sum()) >= LEAST_CALIBRATION:
            last = REJECT_SHARE * int(np.searchsorted(np.cumsum(levels), 0.001 * (n - 1), side="right")) / LEVELS
        cuts[place] = last
    return cuts


def fit(texts: DataFrame, sample_per_language: int = 400, centroids: int = 6) -> Centroids:
    """``texts``: id (text), text, lang of all training rows; lang is not null."""
    lettered = texts.filter(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in lettered.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    df, n = document_frequencies(texts)
    idf = np.log((1 + n) / (1 + df)) + 1
    draw = F.lit(False)
    for lang, total in counts.items():
        rate = min(1.0, sample_per_language / total)
        draw = F.when(F.col("lang") == lang, F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1_000_000)) < int(rate * 1_000_000) + 1).otherwise(draw)
    by_language: dict[str, list[np.ndarray]] = {}
    for lang, row in sample_counts(lettered.filter(draw)):
        by_language.setdefault(lang, []).append(row)
    languages = tuple(sorted(by_language))
    owner, rows = [], []
    for place, lang in enumerate(languages):
        units = unit_rows(np.array(by_language[lang]), idf)
        found = spherical_clusters(units, centroids)
        owner += [place] * len(found)
        rows.append(found)
    stacked = (np.concatenate(rows) if rows else np.zeros((0, SLOTS))).astype(np.float32)
    model = Centroids(languages, np.array(owner, np.int64), stacked, idf, 0.0)
    if not rows:
        return model
    for _ in range(ROUNDS):
        model = replace(model, rows=moved(texts, model))
    return replace(model, cuts=calibrate(texts, model))


def predict_texts(texts: list[str | None], model: Centroids) -> tuple[list[str], list[float], list[bool]]:
    langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    if not model.languages:
        return langs, scores, [gram_counts(text) is None for text in texts]
    for start in range(0, len(texts), _ROWS):
        part = [(i, c) for i, text in enumerate(texts[start : start + _ROWS], start) if (c := gram_counts(text)) is not None]
        if not part:
            continue
        cosines = unit_rows(np.array([c for _, c in part]), model.idf) @ model.rows.T
        best = np.argmax(cosines, axis=1)
        for (i, counts), c, cosine in zip(part, best.tolist(), cosines[np.arange(len(part)), best].tolist()):
            langs[i] = model.languages[model.owner[c]]
            scores[i] = round(min(1.0, max(0.0, cosine)), 6)
            rejected[i] = cosine < model.cut(counts)
    return langs, scores, rejected


def training_rows(df: DataFrame, learn_from: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    known = df.filter(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return known.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def identify(df: DataFrame, learn_from: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             sample_per_language: int = 400, centroids: int = 6) -> DataFrame:
    """One row per input row with the columns of ``FIELDS``; ``learn_from`` marks the rows whose language may be learned."""
    model = fit(training_rows(df, learn_from, id_col, text_col, lang_col), sample_per_language, centroids)

    def block(ids: list, texts: list, out: list) -> dict[str, list]:
        return dict(zip(FIELDS, [ids, out, *predict_texts(texts, model)]))

    columns = {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col), "held_out": held_out}
    return map_blocks(df, columns, FIELDS, block)


def drop_rejected(df: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  sample_per_language: int = 400, centroids: int = 6) -> DataFrame:
    """The rows of ``df`` whose language is identified, unchanged."""
    model = fit(training_rows(df, learn_from, id_col, text_col, lang_col), sample_per_language, centroids)
    return filter_blocks(df, text_col, lambda texts: [not r for r in predict_texts(texts, model)[2]])
