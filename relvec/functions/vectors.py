"""Int8 vectors: quantizing, slicing, normalizing and prefix dot products.

A vector is `array<tinyint>`. Every dot product of int8 prefixes is a whole number, so results do not depend on batch
size, partitioning or engine.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relvec.schema import INT8_SCALE, VECTOR_TYPE

PAIRS = ("qq", "uu", "cc", "qc", "uc", "qu")
_SUMS_TYPE = "struct<" + ",".join(f"{p}:array<bigint>" for p in PAIRS) + ">"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quantize(vector: str | Column, scale: float = 1.0) -> Column:
    """Float vector to int8: scale, round half to even, clip."""

    def one(x: Column) -> Column:
        x = F.rint(x.cast("double") * F.lit(float(scale)))
        return F.greatest(F.lit(-128.0), F.least(F.lit(127.0), x)).cast("tinyint")

    return F.transform(_col(vector), one)


def hashed(text: str | Column, dim: int) -> Column:
    """Stand-in for a model's vector: signed bytes of the SHA-256 of the text and a block number, 32 components a block."""
    blocks = [F.unhex(F.sha2(F.concat(_col(text), F.lit(f":{b}")), 256)) for b in range(-(-dim // 32))]
    digits = F.hex(F.concat(*blocks) if len(blocks) > 1 else blocks[0])

    def one(i: Column) -> Column:
        return (F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int") - 128).cast("tinyint")

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)


def wrap_int8(vector: str | Column) -> Column:
    """Whole-number vector to int8 with two's-complement wrap-around."""

    def one(x: Column) -> Column:
        low = F.pmod(x.cast("bigint"), F.lit(256))
        return F.when(low > 127, low - 256).otherwise(low).cast("tinyint")

    return F.transform(_col(vector), one)


def prefix(vector: str | Column, dim: int) -> Column:
    return F.slice(_col(vector), 1, dim)


def checked_prefix(vector: str | Column, dim: int) -> Column:
    """Leading components; a vector with fewer fails the job. A NULL vector stays NULL."""
    vector = _col(vector)
    failure = F.raise_error(F.concat(F.lit(f"prefix length {dim} exceeds a vector of "), F.size(vector).cast("string")))
    return F.when(vector.isNull() | (F.size(vector) >= dim), prefix(vector, dim)).otherwise(failure.cast(VECTOR_TYPE))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0).cast("tinyint"), dim)


def zero_when(cold: Column, vector: Column, dim: int) -> Column:
    return F.when(cold, zeros(dim)).otherwise(vector)


def scaled(vector: str | Column, by: float = INT8_SCALE) -> Column:
    return F.transform(_col(vector), lambda x: x.cast("double") / F.lit(by))


def l2_norm(vector: str | Column) -> Column:
    squares = F.aggregate(
        _col(vector), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def l2_normalized(vector: str | Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    vector = _col(vector)
    norm = l2_norm(vector)
    safe = F.when(norm == 0, 1.0).otherwise(norm)
    return F.transform(vector, lambda x: x.cast("double") / safe)


def named_columns(vector: str | Column, role: str, dim: int) -> list[Column]:
    """One column per component. Wide plans are slow: ask for it only at a boundary that needs flat columns."""
    vector = _col(vector)
    return [F.get(vector, F.lit(i)).alias(f"{role}_emb_{i:04d}") for i in range(dim)]


def feature_names(dim: int) -> list[str]:
    return [f"{role}_emb_{i:04d}" for role in ("query", "user", "candidate") for i in range(dim)]


@F.arrow_udf(T.BinaryType())
def packed(vector: pa.Array) -> pa.Array:
    """Int8 vectors as one byte string each. Tables that are read again and again are smaller and faster to scan so."""
    if vector.flatten().null_count:
        raise ValueError("a vector holds a NULL component")
    values = vector.values.buffers()[1]
    if vector.values.offset:
        values = values.slice(vector.values.offset)
    validity, offsets = vector.buffers()[:2]
    return pa.Array.from_buffers(pa.binary(), len(vector), [validity, offsets, values], offset=vector.offset)


def _offsets(column: pa.Array) -> np.ndarray:
    """Starts and ends of the values of a list or binary column."""
    if pa.types.is_list(column.type):
        return column.offsets.to_numpy()
    size = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=size)[column.offset : column.offset + len(column) + 1]


def dense_rows(column: pa.Array, dim: int, dtype: type = np.float32) -> np.ndarray:
    """Leading `dim` components of an Arrow column of lists or packed vectors as a matrix.

    A NULL vector is a zero row; vectors of different lengths, or shorter than `dim`, are an error.
    """
    out = np.zeros((len(column), dim), dtype=dtype)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    rows = int(known.sum())
    if rows:
        offsets = _offsets(column)
        if pa.types.is_list(column.type):
            flat = column.flatten().to_numpy(zero_copy_only=False)
        else:  # a NULL takes no bytes
            flat = np.frombuffer(column.buffers()[2], dtype=np.int8)[offsets[0] : offsets[-1]]
        length = flat.size // rows
        sizes = np.diff(offsets)[known]
        if length < dim or (sizes != length).any():
            raise ValueError(f"expected vectors of one length, at least {dim}")
        out[known] = flat.reshape(rows, length)[:, :dim]
    return out


def prefix_sums(q: Column, u: Column, c: Column, dims: Sequence[int]) -> Column:
    """Six dot products per prefix length, shared by all cosines.

    Arrow hands each batch to numpy; one pass over the components serves every prefix length.
    """
    dims = list(dims)
    longest = dims[-1]
    # float32 holds every whole number up to 2**24, i.e. segments of up to 1024 int8 products.
    segments = []
    for start, stop in zip([0] + dims[:-1], dims):
        segments.append([(a, min(a + 1024, stop)) for a in range(start, stop, 1024)])

    @F.arrow_udf(_SUMS_TYPE)
    def sums(qa: pa.Array, ua: pa.Array, ca: pa.Array) -> pa.Array:
        n = len(qa)
        m = {"q": dense_rows(qa, longest), "u": dense_rows(ua, longest), "c": dense_rows(ca, longest)}
        offsets = pa.array(np.arange(0, (n + 1) * len(dims), len(dims), dtype=np.int32))
        fields = []
        for left, right in PAIRS:
            per_dim = np.zeros((n, len(dims)), dtype=np.int64)
            for i, pieces in enumerate(segments):
                for a, b in pieces:
                    per_dim[:, i] += np.einsum("ij,ij->i", m[left][:, a:b], m[right][:, a:b]).astype(np.int64)
            fields.append(pa.ListArray.from_arrays(offsets, pa.array(per_dim.cumsum(axis=1).ravel())))
        return pa.StructArray.from_arrays(fields, names=list(PAIRS))

    return sums(q, u, c)


def prefix_sums_builtin(q: Column, u: Column, c: Column, dims: Sequence[int]) -> Column:
    """The same sums with higher-order functions only: no Python worker, best for short vectors."""
    sides = {"q": q, "u": u, "c": c}

    def dot(a: Column, b: Column, dim: int) -> Column:
        products = F.zip_with(prefix(a, dim), prefix(b, dim), lambda x, y: x.cast("bigint") * y.cast("bigint"))
        return F.coalesce(F.aggregate(products, F.lit(0).cast("bigint"), lambda acc, x: acc + x), F.lit(0))

    return F.struct(
        *[F.array(*[dot(sides[a], sides[b], d) for d in dims]).alias(a + b) for a, b in PAIRS]
    )


def cosine(dot: Column, left: Column, right: Column) -> Column:
    """Cosine from a dot product and two squared norms; 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot, F.sqrt(left) * F.sqrt(right)), F.lit(0.0))


def cosine_columns(sums: str | Column, dims: Sequence[int], cold: Column, name: str = "") -> list[Column]:
    """Four cosines per prefix length: query-candidate, user-candidate, query-user, (query+user)-candidate.

    The last one is the cosine between the candidate and the sum of the two unit vectors. Because
    |q+u|^2 = [q != 0] + [u != 0] + 2 cos(q, u), it follows from the other three. Cold rows have no user side.
    """
    sums = _col(sums)
    out = []
    for i, dim in enumerate(dims):
        qq, uu, cc, qc, uc, qu = (F.get(sums[p], F.lit(i)).cast("double") for p in PAIRS)
        qc_cos, uc_cos, qu_cos = cosine(qc, qq, cc), cosine(uc, uu, cc), cosine(qu, qq, uu)
        length2 = (qq > 0).cast("double") + (uu > 0).cast("double") + F.lit(2.0) * qu_cos
        both = F.coalesce(
            F.try_divide(qc_cos + uc_cos, F.when(length2 > 1e-12, F.sqrt(length2))), F.lit(0.0)
        )
        out += [
            qc_cos.alias(f"{name}qc_cosine_{dim}"),
            F.when(cold, 0.0).otherwise(uc_cos).alias(f"{name}uc_cosine_{dim}"),
            F.when(cold, 0.0).otherwise(qu_cos).alias(f"{name}qu_cosine_{dim}"),
            F.when(cold, qc_cos).otherwise(both).alias(f"{name}quc_cosine_{dim}"),
        ]
    return out


@F.arrow_udf(VECTOR_TYPE)
def bytes_to_vector(raw: pa.Array) -> pa.Array:
    """Bytes read as signed int8, one list per row."""
    rows = [None if b is None else np.frombuffer(b, dtype=np.int8) for b in raw.to_pylist()]
    return pa.array(rows, type=pa.list_(pa.int8()))
