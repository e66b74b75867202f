"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20


def need(df: DataFrame, *names: str) -> None:
    """Fail early, and by name, when an input column is missing."""
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise ValueError(f"missing columns {lost}; the table has {df.columns}")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Without this the optimizer may copy the expression into a lambda and repeat it per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no slice holds much more than ``BATCH_BYTES`` of text."""
    for b in batches:
        if not b.num_rows:
            continue
        size = max(1, b.column(b.schema.get_field_index(text)).nbytes)
        step = max(1, int(b.num_rows * BATCH_BYTES / size))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
