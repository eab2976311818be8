"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.operators.skew import salted_join
from pageloom.session import materialize

#: Rows of a table that may be broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 100_000
#: Bytes of an Arrow batch that are worked on at once (one row at least).
SLICE_BYTES = 1 << 24


def tables(spark, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables of a data folder."""
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name, number = base, 0
    while name.lower() in taken:
        number += 1
        name = f"{base}_{number}"
    return name


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def hash_order(doc_id: Column, seed: str) -> Column:
    """A reproducible pseudo-random order of ids."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a row by its id and whole text; equal rows share it. Never null."""
    return F.concat(
        F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.md5(text), F.lit("-"))
    )


def join_to_keys(left: DataFrame, right: DataFrame, on: str, how: str, spread_by: str | Column,
                 rows: int | None = None) -> DataFrame:
    """Join to a table with one row per ``on``; broadcast it only if counted at ``BROADCAST_ROWS`` or fewer.

    A larger one is joined by shuffling, with every key of ``left`` spread over several tasks.
    ``right`` should be written out, as it is counted here unless ``rows`` gives its count.
    """
    if (right.count() if rows is None else rows) <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, [on], how, spread_by)


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def _typed(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` over ``function(batch) -> dict of lists``; column types come from ``schema``.

    Batches are cut to ``SLICE_BYTES``, so that a task's memory does not follow the length of its texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = max(1, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes))
            for start in range(0, whole.num_rows, rows):
                found = function(whole.slice(start, rows))
                yield pa.RecordBatch.from_arrays([_typed(found[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


__all__ = ["BROADCAST_ROWS", "byte_column", "fresh", "hash_order", "join_to_keys", "map_batches", "materialize",
           "remainder", "row_key", "salted_join", "tables"]
