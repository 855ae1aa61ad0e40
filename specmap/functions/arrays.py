"""Arrow record batches to NumPy matrices and back: one profile per row, one array per batch."""
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """A list column, all rows of one length, as a 2-D array; null elements become NaN (False for booleans)."""
    values = column.flatten()
    if values.null_count:
        values = values.fill_null(False if pa.types.is_boolean(values.type) else float("nan"))
    flat = values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    rows = len(column)
    if rows and (len(flat) % rows or column.null_count):
        raise ValueError("profiles of different lengths in one table")
    out = flat.reshape(rows, len(flat) // rows if rows else 0)
    width = out.shape[1]
    if rows and not np.array_equal(column.value_lengths().to_numpy(zero_copy_only=False), np.full(rows, width)):
        raise ValueError("profiles of different lengths in one table")
    return out


def lists(mat: np.ndarray) -> pa.Array:
    """The rows of a 2-D array as a list column."""
    rows, width = mat.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int64) * width, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(mat).ravel()))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """A narrow Arrow stage: `fn` turns each non-empty batch into named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch))

    return df.mapInArrow(run, schema)
