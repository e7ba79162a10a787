"""Shared plumbing of the training-data operators: row keys, shared storage, Arrow batches.

Every operator takes a DataFrame with at least ``doc_id`` and ``text``. Columns are picked by
name, so extra columns never clash; null texts count as empty unless an operator says otherwise.
Two rows with one ``doc_id`` are told apart by a hash of their text, and rows equal in both get
equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import removed, settled, shared_dir, shared_path, ship

__all__ = ["removed", "settled", "shared_dir", "shared_path", "ship"]

#: Columns that operators add for themselves start with this.
OWN = "__tess_"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.col(text), F.octet_length(F.coalesce(F.col(text), F.lit(""))))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


_HELD: list[dict] = []


def alone(store: dict | None) -> None:
    """Empties what other operators hold in this worker (models, remembered pieces), so that only one has any at a time."""
    for s in _HELD:
        if s is not store:
            s.clear()
    if store is not None and not any(s is store for s in _HELD):
        _HELD.append(store)


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``most`` bytes; a longer single text is a slice of its own."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def with_columns(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in more]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *more.values()], [*names, *more])


def ddl(df: DataFrame, *without: str) -> str:
    """The schema of a DataFrame's columns as DDL, for functions over Arrow batches that pass them through."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
