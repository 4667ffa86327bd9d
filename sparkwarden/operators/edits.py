"""Pairs of names within an edit distance, by comparing blocks of equally long names.

Names of a block travel as one text. Two names are compared only if the signs they hold, each with its number of times, as bits of
one word, differ by no more bits than the edits can change, and then their pairs of signs; distances come from Myers' bit vectors, one step for all pairs left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import share_code

# Missing names and index names of all lengths together that share a number within their lengths; of the first, how many travel to the index.
_ASKED, _HELD, _FEW = 16_384, 65_536, 200_000
# Pairs whose bit vectors are worked out at once, those that may wait for it, and bits of a vector.
_STEP, _WAITING, _BITS = 1 << 14, 1 << 20, 64


def sign_bits(names: np.ndarray) -> np.ndarray:
    """For rows of code points, the bits of their signs, the second, third and fourth of a kind counted apart. An inserted or deleted sign
    changes one bit at most, an exchanged one two."""
    out = np.zeros(len(names), np.uint64)
    for j in range(names.shape[1]):
        before = np.minimum((names[:, :j] == names[:, j : j + 1]).sum(axis=1), 3).astype(np.uint64)
        mixed = (names[:, j].astype(np.uint64) * np.uint64(4) + before) * np.uint64(0x9E3779B97F4A7C15)
        out |= np.uint64(1) << (mixed >> np.uint64(58))
    return out


def pair_bits(names: np.ndarray) -> np.ndarray:
    """The same for two signs in a row, ends included. An inserted or deleted sign changes three bits at most, an exchanged one four."""
    ended = np.pad(names.astype(np.uint64), ((0, 0), (1, 1)))
    return sign_bits((ended[:, :-1] << np.uint64(21)) | ended[:, 1:])


def distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distances of the rows ``i`` of ``a`` and ``j`` of ``b``, both code points."""
    if a.shape[1] > _BITS and b.shape[1] < a.shape[1]:
        a, b, i, j = b, a, j, i
    size, width = a.shape[1], b.shape[1]
    if size > _BITS:
        return np.concatenate([_long_distances(a[i[s : s + _STEP]], b[j[s : s + _STEP]]) for s in range(0, len(i), _STEP)] or [i])
    word = np.uint32 if size < 32 else np.uint64
    signs, codes = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    a, b = codes[: a.size].reshape(a.shape), np.ascontiguousarray(codes[a.size :].reshape(b.shape).T)
    places = np.zeros((len(a), len(signs)), word)
    for k in range(size):
        places[np.arange(len(a)), a[:, k]] |= word(1) << word(k)
    places, one, last = places.ravel(), word(1), word(size - 1)
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), _STEP):
        base, column = i[s : s + _STEP] * len(signs), j[s : s + _STEP]
        up, down = np.full(len(base), ~word(0), word), np.zeros(len(base), word)
        found = np.full(len(base), size, np.int32)
        for k in range(width):
            same = places.take(base + b[k].take(column))
            vertical = same | down
            across = (((same & up) + up) ^ up) | same
            more, less = down | ~(across | up), up & across
            found += ((more >> last) & one).astype(np.int32)
            found -= ((less >> last) & one).astype(np.int32)
            more, less = (more << one) | one, less << one
            up, down = less | ~(vertical | more), more & vertical
        out[s : s + _STEP] = found
    return out


def _long_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.tile(np.arange(b.shape[1] + 1), (len(a), 1)).T
    for x in a.T:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for k, y in enumerate(b.T, 1):
            new[k] = np.minimum(np.minimum(new[k - 1], row[k]) + 1, row[k - 1] + (x != y))
        row = new
    return row[-1]


def both_bits(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sign_bits(names), pair_bits(names)


def near_rows(asked: np.ndarray, held: np.ndarray, limits: np.ndarray, bits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``asked``, row of ``held`` and distance of all pairs within the limit of the first; ``bits`` are those of ``held``."""
    apart = abs(asked.shape[1] - held.shape[1])
    ones, twos = zip(both_bits(asked), bits)
    rows, columns, found, waiting = [], [], [], 0

    def work_out() -> None:
        i, j = np.repeat(np.array(rows, np.int64), [len(c) for c in columns]), np.concatenate([np.zeros(0, np.int64), *columns])
        left = np.bitwise_count(twos[0][i] ^ twos[1][j]) <= 4 * limits[i] - apart
        i, j = i[left], j[left]
        d = distances(asked, held, i, j)
        kept = d <= limits[i]
        found.append((i[kept], j[kept], d[kept]))

    for i in np.flatnonzero(limits >= apart).tolist():
        most = np.uint8(min(_BITS, 2 * int(limits[i]) - apart))  # as small as the counts, which are many
        rows.append(i)
        columns.append(np.flatnonzero(np.bitwise_count(ones[1] ^ ones[0][i]) <= most))
        waiting += len(columns[-1])
        if waiting >= _WAITING:
            work_out()
            rows, columns, waiting = [], [], 0
    work_out()
    return tuple(np.concatenate(x) for x in zip(*found))


def _rows(text: str, width: int) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)


def _names(rows: np.ndarray) -> list[str]:
    return [r.tobytes().decode("utf-32-le", "surrogatepass") for r in rows]


def close_pairs(asked: DataFrame, held: DataFrame, most: int | None, bonus: float = 0.0) -> DataFrame:
    """``registry, _q, _c``: pairs of names of ``asked(registry, s, worst)`` and ``held(registry, s)`` at most ``most`` edits apart.
    Without ``most``, pairs within a third of the longer name, or three edits, whose edits over its length, taken twice and less
    ``bonus`` if both begin with the same three signs, do not exceed ``worst``; null stands for any."""
    length = F.length("s")
    numbered = lambda df, of, size: F.pmod(F.xxhash64("s"), F.lit(df.count() // size + 1)).alias("part")
    held = held.distinct()
    blocks = held.groupBy("registry", length.alias("cl"), numbered(held, "s", _HELD)).agg(F.array_join(F.collect_list("s"), "").alias("cs"))
    # A block is small and much work, so blocks are spread by their number and not by their bytes.
    spark = held.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = blocks.repartition(tasks, "registry", "cl", "part")
    reach = F.lit(most) if most is not None else F.greatest(F.lit(3), F.expr("int(ql * 0.54)"))  # 0.35 of the longer is 0.54 of the shorter
    lists = asked.distinct().groupBy("registry", length.alias("ql"), numbered(asked, "s", _ASKED)).agg(F.collect_list(F.struct("s", "worst")).alias("x"))
    lists = lists.select(
        "registry", "ql", F.array_join("x.s", "").alias("qs"), F.transform("x.worst", lambda w: F.coalesce(w, F.lit(float("inf")))).alias("worst"),
        F.explode(F.sequence(F.greatest(F.lit(1), F.col("ql") - reach), F.col("ql") + reach)).alias("cl"),
    )
    few = asked.count() <= _FEW
    both = blocks.join(F.broadcast(lists) if few else lists, ["registry", "cl"]).select("registry", "ql", "qs", "worst", "cl", "cs")
    schema = pa.schema([("registry", pa.string()), ("_q", pa.string()), ("_c", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None  # a block comes with all lists in a row
        for batch in batches:
            for row in range(batch.num_rows):
                registry, ql, qs, worst, cl, cs = (column[row].as_py() for column in batch.columns)
                if known != (cl, cs):
                    known, b = (cl, cs), _rows(cs, cl)
                    bits = both_bits(b)
                a, worst, longer = _rows(qs, ql), np.array(worst), max(ql, cl)
                limits = np.full(len(a), most)
                if most is None:
                    limits = np.minimum(max(3, longer * 35 // 100), np.floor((worst + bonus) * longer / 2 + 1e-6)).astype(np.int64)
                i, j, d = near_rows(a, b, limits, bits)
                if most is None:
                    head = min(3, ql)
                    alike = (a[i, :head] == b[j, :head]).all(axis=1) if cl >= head else np.zeros(len(i), bool)
                    kept = 2 * d / longer - bonus * alike <= worst[i] + 1e-6
                    i, j = i[kept], j[kept]
                for s in range(0, len(i), 1 << 16):
                    found = [registry] * len(i[s : s + (1 << 16)]), _names(a[i[s : s + (1 << 16)]]), _names(b[j[s : s + (1 << 16)]])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in found], schema=schema)

    share_code(spark)
    return both.mapInArrow(run, "registry string, _q string, _c string")
