"""Arrow list columns as integer matrices, for the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Components have to be smaller, so that sums of products stay within 64 bits.
LIMIT = 1 << 27


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components of all lists one after another (null: NaN), and each list's length (null: -1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64())
    return values.to_numpy(zero_copy_only=False), lengths


def scaled(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of every component x of the lists that have no null and no
    infinite one and are not null themselves: the numbers of these lists, their lengths,
    and their components one after another."""
    values, lengths = flat(column)
    sizes = np.maximum(lengths, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(owner[~np.isfinite(values)], minlength=len(sizes)) > 0
    good = np.flatnonzero((lengths >= 0) & ~odd)
    out = np.floor(scale * values[~odd[owner]])
    if len(out) and np.abs(out).max() >= LIMIT:
        raise ValueError(f"a scaled component reaches {LIMIT}")
    return good, lengths[good], out.astype(np.int64)


def matrix(column: pa.Array, dim: int, dtype=np.int64) -> np.ndarray:
    """Lists without nulls as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) == len(lengths) * dim:
        return values.reshape(len(lengths), dim).astype(dtype)
    out = np.zeros((len(lengths), dim), dtype=dtype)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    out[owner, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.reshape(-1), kind))
