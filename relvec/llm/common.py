"""Columns, text bytes and rolling hashes that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BASE = np.uint64(0x5851F42D4C957F2D)  # odd, so that powers have inverses modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
OTHER_BASE = np.uint64(0xD1342543DE82EF95)  # for a second, independent hash
OTHER_INVERSE = np.uint64(pow(int(OTHER_BASE), -1, 1 << 64))
KEPT_POWERS = 1 << 19
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no other. Extra columns may differ from them in case only, which `select` can't resolve."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def row_key(*names: str) -> F.Column:
    """64 bits that identify a row by content; used to break ties the same way in every run."""
    return F.xxhash64(*[F.col(n) for n in names])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and the n + 1 places between them. A null is an empty text."""
    whole = column.fill_null("").cast(pa.large_binary())
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `most` bytes of text, or one row; this bounds a task's memory."""
    for batch in batches:
        sizes = np.diff(utf8(batch.column(column))[1]) if batch.num_rows else np.zeros(0, np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def _kept_powers(base: int) -> np.ndarray:
    out = _powers(np.uint64(base), KEPT_POWERS)
    out.flags.writeable = False
    return out


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, not to be written to. Those of short texts are made once in a process."""
    return _kept_powers(int(base))[:n] if n <= KEPT_POWERS else _powers(base, n)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def prefix_hashes(data: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Polynomial hash of every prefix: h[i] = sum of (byte j + 1) * base**j for j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of bytes start..end, equal for equal bytes at any place. inverse: powers of the inverse of the prefixes' base."""
    h = (prefix[end] - prefix[start]) * inverse[start]
    return mix(h ^ ((end - start).astype(np.uint64) * _ODD))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(32)


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes for which `inside`, never across rows."""
    is_in = inside[data]
    begins = is_in.copy()
    begins[1:] &= ~is_in[:-1]
    ends = is_in.copy()
    ends[:-1] &= ~is_in[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = is_in[edges]
    ends[edges - 1] = is_in[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def per_row(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of `counts` values each, as a column."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
