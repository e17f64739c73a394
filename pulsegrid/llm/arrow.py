"""Small helpers for the Arrow functions that run inside Spark tasks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def column_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def parted(batches: Iterator[pa.RecordBatch], column: int | str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of batches in smaller ones of about so many bytes of text, or of one row.

    What a task makes of a batch, as Python strings and arrays, is a few times as large as the batch.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            held = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, held + most_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def pieces(values: list[str], most_chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of a batch of about so many characters; a longer text is a slice of its own.

    It bounds the arrays that vectorised code makes, not what it covers.
    """
    start, held = 0, 0
    for at, value in enumerate(values):
        if held and held + len(value) > most_chars:
            yield slice(start, at)
            start, held = at, 0
        held += len(value)
    if start < len(values):
        yield slice(start, len(values))
