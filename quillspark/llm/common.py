"""Shared plumbing of the training-data operators: column picking, Arrow maps, shared tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.shared import discard, lookup, shared_dir, written  # noqa: F401


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select columns by exact name under new names, whatever other columns are called.

    ``pick(df, id="doc_id")`` returns one column ``id``. An exact match wins over one that
    differs in case only; of equal names the first wins. Missing columns raise ``ValueError``.
    """
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    out = []
    for new, old in wanted.items():
        if old in names:
            at = names.index(old)
        else:
            at = next((i for i, n in enumerate(names) if n.lower() == old.lower()), None)
            if at is None:
                raise ValueError(f"no column {old!r} among {names}")
        out.append(F.col(f"c{at}").alias(new))
    return flat.select(*out)


def whole_text(col: Column) -> Column:
    """The text itself, and the empty text for null."""
    return F.coalesce(col.cast("string"), F.lit(""))


def row_key(id_col: Column, text_col: Column) -> tuple[Column, Column]:
    """Two non-null longs that identify a row by content; equal rows share the key.

    Both depend on nothing but the values, so a recomputed task gives the same key.
    """
    as_id = F.coalesce(id_col.cast("string"), F.lit("\x00null"))
    return F.xxhash64(as_id, text_col), F.xxhash64(text_col, F.lit("#"), as_id)


def text_key(text_col: Column) -> tuple[Column, Column]:
    """Two non-null longs that identify a text."""
    return F.xxhash64(text_col), F.xxhash64(F.lit("~"), text_col, F.lit("#"))


def lean() -> None:
    """What a worker has freed goes back to the system; Arrow's own pool, and the C library, would keep what the largest batch took."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, schema, start: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """``mapInArrow`` whose state is made by ``start()`` once per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        step = start()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
        lean()

    return df.mapInArrow(run, schema)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def portions(texts: list, rows: int, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Slices of at most ``rows`` texts and about ``size`` bytes: memory holds one slice's working data, or one long text's."""
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo >= rows or total + len(t) > size):
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class BoundedCache(dict):
    """A dict that is emptied when it has ``limit`` entries: values never depend on it."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def room(self) -> None:
        if len(self) >= self.limit:
            self.clear()
