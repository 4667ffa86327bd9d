"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Terms are vector dimensions. Candidates stay where they are: every task turns its rows into posting lists (one weight per
row and dimension), each query row scatters its weighted postings into a dense score array, a partition selection keeps the
k best of the block, and the lists of all blocks are merged per query. Queries travel in blocks of at most about
``query_block`` rows, so what a task receives has a fixed size.

Defined results: vectors that are null, or hold null or non-finite components, and rows without id take no part. Vectors of
different length are compared as if the shorter ended in zeros; an empty vector scores 0 everywhere. Repeated query rows are
one query (of vectors that differ under one id, the smallest); every candidate row of another id is ranked by itself, also a
repeated one. Scores beyond a long are clamped. Fewer than k candidates: all of them. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import arrow_schema, ddl, in_tasks

SCALE = 256.0
_FIELDS = {"query_id": "long", "vec_id": "long", "score": "long"}
_ROWS = 4096
_QUERIES = 256
_LONG = (1 << 63) - 1


def scaled(vector: Column) -> Column:
    """256 * x of every component, as double (floored where the matrices are built); null if the vector takes no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < math.inf))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(vector, lambda x: x.cast("double") * SCALE))


def _matrix(rows: list, width: int) -> np.ndarray:
    """Whole numbers floor(256 * x), a row per vector, short ones filled with zeros."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return np.floor(out)


def _scores(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Dense scores of a query block against a candidate block, one term after the other."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(postings).max(initial=0)) * max(1, queries.shape[1])
    if bound >= 2.0**53:
        exact = np.array([[int(x) for x in row] for row in queries.tolist()], dtype=object).reshape(queries.shape)
        lists = np.array([[int(x) for x in row] for row in postings.tolist()], dtype=object).reshape(postings.shape)
        total = np.zeros((len(queries), postings.shape[1]), dtype=object)
        for term in range(queries.shape[1]):
            total += exact[:, term, None] * lists[term]
        return np.array([[max(-_LONG - 1, min(_LONG, x)) for x in row] for row in total], dtype=np.int64).reshape(total.shape)
    total = np.zeros((len(queries), postings.shape[1]))
    for term in range(queries.shape[1]):
        hit = np.flatnonzero(queries[:, term])
        if len(hit) == len(queries):
            total += queries[:, term, None] * postings[term]
        elif len(hit):
            total[hit] += queries[hit, term, None] * postings[term]
    return total.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best rows; ids ascend, so a lower place wins a tie."""
    place = np.flatnonzero(ids != own)
    if len(place) > k:
        cut = np.partition(scores[place], len(place) - k)[len(place) - k]
        above = place[scores[place] > cut]
        place = np.concatenate([above, place[scores[place] == cut][: k - len(above)]])
    return place


def _search(query_ids: list[int], query_rows: list, k: int):
    schema = arrow_schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                ids, rows = (c.to_pylist() for c in batch.slice(start, _ROWS).columns)
                order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
                ids = np.array(ids, dtype=np.int64)[order]
                width = max(max(map(len, rows)), max(map(len, query_rows)))
                postings = np.ascontiguousarray(_matrix([rows[i] for i in order], width).T)
                for q in range(0, len(query_ids), _QUERIES):
                    scores = _scores(_matrix(query_rows[q : q + _QUERIES], width), postings)
                    found = [_best(scores[i], ids, own, k) for i, own in enumerate(query_ids[q : q + _QUERIES])]
                    sizes = [len(f) for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(np.array(query_ids[q : q + _QUERIES], dtype=np.int64), sizes)),
                            pa.array(ids[np.concatenate(found)]),
                            pa.array(np.concatenate([scores[i][f] for i, f in enumerate(found)])),
                        ],
                        schema=schema,
                    )

    return run


def exact_top_k(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 4096
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of highest integer inner product, ties to the smaller id."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col)).alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    queries = rows.filter("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = -(-queries.count() // query_block)
    found = None
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        if not part:
            continue
        hits = in_tasks(rows.select("vec_id", "v"), _search([r[0] for r in part], [r[1] for r in part], k), ddl(_FIELDS))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
