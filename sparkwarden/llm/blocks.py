"""Arrow plumbing shared by the operators: whole rows in bounded blocks, one output row per input row or fewer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import share_code

_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}
BLOCK_BYTES = 8 << 20
#: Bits of the table in ``maybe_among``, whatever the number of ids.
ID_BITS = 1 << 24
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_schema(fields: dict[str, str]) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in fields.items()])


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in workers that can import this package. Batches are bounded in bytes where the session sets no bound itself:
    Spark's own bound is eight times as large, and it is held by JVM and worker for every task at once."""
    share_code(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH_BYTES, None) is None:
        df.sparkSession.conf.set(_BATCH_BYTES, str(BLOCK_BYTES))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice holds about ``block_bytes``; a single larger row stays whole."""
    for batch in batches:
        rows = max(1, batch.num_rows * block_bytes // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_blocks(
    df: DataFrame, columns: dict[str, Column], fields: dict[str, str], block: Callable[..., dict[str, list]], block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``block`` gets one list per entry of ``columns`` and returns one list per entry of ``fields``."""
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, block_bytes):
            out = block(*(column.to_pylist() for column in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return in_tasks(df.select(*(c.alias(name) for name, c in columns.items())), run, ddl(fields))


def filter_blocks(df: DataFrame, text_col: str, keep: Callable[[list], list[bool]], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``df`` for which ``keep`` says so of their text; all columns pass as they are, and nothing is shuffled."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, block_bytes):
            yield batch.filter(pa.array(keep(batch.column(place).to_pylist()), pa.bool_()))

    return in_tasks(df, run, df.schema)


def replace_text(df: DataFrame, text_col: str, new: Callable[[list], list], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with ``text_col`` as ``new`` makes it of a block's texts; rows and other columns pass as they are."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, block_bytes):
            texts = pa.array(new(batch.column(place).to_pylist()), batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), texts)

    return in_tasks(df, run, df.schema)


def share(key: Column, part: int, of: int) -> Column:
    """True for rows whose crc32 of the key, as text, leaves ``part`` modulo ``of``; false for null keys."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % of == part, F.lit(False))


def maybe_among(ids: DataFrame) -> Callable[[Column], Column]:
    """A test that is true for all values of ``ids`` (one long column), null for null, and false for most others: each id sets one
    of ``ID_BITS`` bits. Only the bits, 2 MB, travel. With more ids than bits it lets most values pass, so an exact join must follow."""
    spark = ids.sparkSession
    share_code(spark)
    place = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(ID_BITS))
    words = ids.filter(F.col(ids.columns[0]).isNotNull()).select(place.alias("place"))
    words = words.groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 AS int)))").alias("bits"))
    found = words.toArrow()
    table = np.zeros(ID_BITS // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(table.view(np.uint8))  # little-endian, as bit p is in byte p // 8

    def is_set(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)

    held = F.pandas_udf(is_set, "boolean")
    return lambda value: F.when(value.isNotNull(), held(F.pmod(F.xxhash64(value), F.lit(ID_BITS))))
