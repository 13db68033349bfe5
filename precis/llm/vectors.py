"""Integer vectors from arrays of floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import stored


def lattice(column: pa.Array, scale: int, most: int, dims: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, their lengths, their components ``floor(scale * x)`` one
    after the other).  Kept are arrays without a null, NaN or infinite
    component, of ``dims`` components where that is given.  Components stop at
    ``-most`` and ``most``."""
    n = len(column)
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + n + 1]).astype(np.int64) \
        if n else np.zeros(0, np.int64)
    there = np.asarray(column.is_valid()) if n else np.zeros(0, bool)
    # flatten() leaves out the values of null lists
    sizes[~there] = 0
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(n), sizes)
    bad = np.zeros(n, bool)
    bad[owner[~np.isfinite(values)]] = True
    keep = there & ~bad
    if dims is not None:
        keep &= sizes == dims
    kept = values[keep[owner]]
    return np.flatnonzero(keep), sizes[keep], np.floor(np.clip(scale * kept, -most, most)).astype(np.int64)


def integer_vectors(df: DataFrame, columns: str, vec_col: str, scale: int, most: int, dims: int | None = None,
                    name: str = "vectors") -> DataFrame:
    """``columns`` (a schema of longs, each named like its column in ``df``)
    and ``v`` (array<int>) of the rows that :func:`lattice` keeps, written
    once: every later pass reads small integers instead of floats."""
    names = [x.split()[0] for x in columns.split(", ")]
    rows = df.select(*names, F.col(vec_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, values = lattice(batch.column(len(names)), scale, most, dims)
            off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(off), pa.array(values.astype(np.int32)))],
                names=[*names, "v"])

    return stored(rows.mapInArrow(run, f"{columns}, v array<int>"), name)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of equal length ``dims`` as an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
