"""Whitening of vectors: exact cross-products from bit planes, eigenvectors of their covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackwise.llm.common import mapped, without

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
SLICE_WORDS = 128  # rows of a slice are packed into so many 64-bit words
LARGEST = 2.0**40  # whole numbers beyond it count as it; keeps every sum within 38 digits
ADDED = ["n", "deviation", "whitened"]
_LEAST_SHARE = 1e-12


def usable(vector: str, dim: int | None = None) -> Column:
    """True where the vector is not null, has entries (``dim`` of them, if given), and all are finite numbers."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim if dim is not None else F.size(vector) > 0) & fine, F.lit(False))


def whole_numbers(vectors: pa.Array, dim: int) -> np.ndarray:
    """Each entry c as floor(1024 c) + 100000, one row per vector."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def bit_planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """``[i, b]``: bit b of dimension i over all rows, packed into 64-bit words (rows past the last are 0)."""
    rows, dim = shifted.shape
    columns = np.ascontiguousarray(shifted.T)
    packed = np.zeros((dim, bits, -(-rows // 64) * 8), np.uint8)
    for b in range(bits):
        packed[:, b, :-(-rows // 8)] = np.packbits((columns >> b & 1).astype(bool), axis=1, bitorder="little")
    return packed.view(np.uint64)


def plane_products(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of every dimension and cross-products of every pair (upper half), as exact Python integers.

    The product of two dimensions is the sum over pairs of their planes of 2 to the power of both places,
    times the number of rows that have both bits.
    """
    dim, bits, words = planes.shape
    exact = np.int64 if 2 * bits + (words * 64).bit_length() < 63 else object
    weights = np.array([1 << b for b in range(bits)], dtype=exact)
    sums = np.bitwise_count(planes).sum(axis=2, dtype=np.int64).astype(exact) @ weights
    products = np.zeros((dim, dim), dtype=exact)
    for i in range(dim):
        for a in range(bits):
            if planes[i, a].any():
                both = np.bitwise_count(planes[i:] & planes[i, a]).sum(axis=2, dtype=np.int64)
                products[i, i:] += (both.astype(exact) @ weights) * weights[a]
    return sums.astype(object), products.astype(object)


@dataclass(frozen=True)
class Whitening:
    """Of ``n`` fitted vectors: the sums of their whole numbers, and the components by falling variance."""

    dim: int
    n: int
    sums: list[int]
    axes: np.ndarray
    variances: list[float]
    total_variance: float

    @property
    def explained(self) -> list[float]:
        return [v / self.total_variance for v in self.variances]


def _task_sums(vector: str, dim: int, low: list[int], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        base = np.array(low, np.int64)
        for batch in batches:
            shifted = whole_numbers(batch.column(vector), dim) - base
            for at in range(0, len(shifted), 64 * SLICE_WORDS):
                more, pairs = plane_products(bit_planes(shifted[at:at + 64 * SLICE_WORDS], bits))
                sums, products = sums + more, products + pairs
        i, j = np.triu_indices(dim)
        values = [str(v) for v in [*sums, *products[i, j]]]
        ids = [pa.array([*range(dim), *i.tolist()], pa.int32()), pa.array([-1] * dim + j.tolist(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(values)], ["i", "j", "v"])

    return run


def fit_whitening(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The components of all usable vectors of the commonest length (ties: the longer); None without any variance.

    Two passes: the range of every dimension, then sums and cross-products from bit planes, folded per
    task and summed exactly. What reaches the driver is one number per pair of dimensions. The
    covariance is centred in whole numbers, so nothing cancels, and only then turned into doubles.
    """
    lists = vectors.select(F.col(f"`{vector}`").alias("vector"))
    sizes = lists.where(usable("vector")).groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if first is None:
        return None
    dim, n = first["dim"], first["n"]
    lists = lists.where(usable("vector", dim))
    number = F.greatest(F.least(F.floor(F.greatest(F.least(F.col("c").cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))), F.lit(int(LARGEST))), F.lit(-int(LARGEST)))
    ranges = lists.select(F.posexplode("vector").alias("i", "c")).groupBy("i").agg(F.min(number + OFFSET).alias("low"), F.max(number + OFFSET).alias("high")).collect()
    low, high = ([r[c] for r in sorted(ranges, key=lambda r: r["i"])] for c in ("low", "high"))
    bits = max(1, max(h - lo for h, lo in zip(high, low, strict=True)).bit_length())
    parts = lists.mapInArrow(_task_sums("vector", dim, low, bits), "i int, j int, v string")
    folded = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    value = {(r["i"], r["j"]): int(r["v"]) for r in folded}
    shifted = [value[i, -1] for i in range(dim)]
    covariance = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            covariance[i, j] = covariance[j, i] = (n * value[i, j] - shifted[i] * shifted[j]) / (n * n)
    total = sum(n * value[i, i] - shifted[i] ** 2 for i in range(dim)) / (n * n)
    if not total:
        return None
    variances, axes = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-variances, kind="stable")[:components] if variances[k] > _LEAST_SHARE * total]
    axes = axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(len(order))])
    return Whitening(dim, n, [s + n * lo for s, lo in zip(shifted, low, strict=True)], axes, variances[order].tolist(), total)


def whiten(vectors: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """Usable vectors of the model's length, with ``n``, ``deviation`` and ``whitened`` added.

    ``deviation`` is the exact squared distance of n times the vector's whole numbers from their sums, null
    where it exceeds a long. ``whitened`` holds one number per component; components without variance
    are left out. Vectors that are null, empty, of another length than the model's, or hold null or
    non-finite entries are dropped; equal vectors, repeated rows and ties stay, each on its own.
    Entries whose 1024-fold exceeds 2^40 count as that. An empty table, or one whose vectors are all
    equal (``model`` None), gives no rows. Columns named as the added ones are replaced, all others kept.
    """
    kept = without(vectors, [c for c in ADDED if c.lower() != vector.lower()])
    fields = [T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    result = T.StructType([*kept.schema.fields, *fields])
    if model is None:
        return kept.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    place = [f.name for f in kept.schema.fields].index(vector)
    n, dim, sums = model.n, model.dim, model.sums
    to_unit = model.axes / np.sqrt(np.array(model.variances))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(batch.column(place), dim)
            furthest = max(n * max(abs(int(x.max())), abs(int(x.min()))), max(abs(s) for s in sums)) * 2
            kind = np.int64 if furthest < 2**62 else object
            apart = x.astype(kind) * n - np.array(sums, dtype=kind)
            most = max(int(apart.max()), -int(apart.min()))
            squared = (apart if dim * most * most < 2**63 else apart.astype(object)) ** 2
            deviation = [v if v < 2**63 else None for v in squared.sum(axis=1).tolist()]
            white = (apart.astype(np.float64) / n) @ to_unit
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1])
            added = [pa.array([n] * len(x), pa.int64()), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(white.ravel()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], result.names)

    return mapped(kept.where(usable(f"`{vector}`", dim)), run, result)


def identity_error(white: DataFrame, components: int, whitened: str = "whitened") -> float:
    """Largest entry of the covariance of the ``whitened`` columns less the identity, from all rows in one aggregate."""
    of = [F.col(whitened)[k] for k in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = white.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{k}") for k, c in enumerate(of)], *[F.sum(of[i] * of[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    n = found["n"]
    return max((abs(found[f"p{i}_{j}"] / n - found[f"s{i}"] * found[f"s{j}"] / n**2 - (i == j)) for i, j in pairs), default=0.0) if n else 0.0
