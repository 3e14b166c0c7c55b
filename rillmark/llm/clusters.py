"""Centroid clustering (operator 11): nearest centroids by float32 screening, settled exactly.

Components become whole numbers, and every result is that of arithmetic on whole numbers.  A
single-precision matrix product first estimates |x - c|^2 - |x|^2 of a block of vectors and all
centroids.  Its error is bounded for any order of summation and whether or not products are
fused into sums (``bounds``), so each estimate is an interval that certainly holds the true
value.  Only centroids whose interval reaches below the lowest upper end can be nearest; where
more than one is left, their distances are computed in whole numbers, and the smallest number
wins a tie.  Rows or centroids with components beyond ``WIDE`` are screened in double precision
and settled in whole numbers of any length.

Vectors are converted once and kept durably, ``BLOCK`` to a row.  A round is one pass over
these: every task adds its vectors up by centroid, the sums are added up in a tree, and the
driver gets one note of (centroids x components) numbers, whatever the size of the table.

Rows count only with a vector of exactly ``components`` values, none null or not finite; the
others have no row in the result.  Repeated rows are vectors of their own.  A null id keeps its
row and comes after all others when first centroids are chosen; equal ids are chosen by their
vectors.  With fewer vectors than centroids there are as many centroids as vectors.  A distance
or an inertia beyond 64 bits is null.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, kernel
from .common import bounded_batches, durable

#: Vectors of a block, and of a row of the table that is kept.
BLOCK = 4096
#: Magnitude of a component up to which 64-bit numbers hold all distances and sums of a block.
WIDE = 1 << 26
#: The largest relative error of rounding to single precision.
UNIT = 2.0**-24
_LONG = (1 << 63) - 1


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, as 64-bit numbers or, where some are large, as
    Python's.  ``scale`` is a power of two, so the product is exact unless it overflows."""
    if not vectors.size or np.abs(vectors).max() < WIDE / scale:
        return np.floor(vectors * scale).astype(np.int64)
    exact = [math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale for x in vectors.ravel().tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def _double(x: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles, infinite where they are too large for one."""
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([float(v) if abs(v) < 1 << 1023 else math.inf if v > 0 else -math.inf for v in x.ravel().tolist()]).reshape(x.shape)


def bounds(x: np.ndarray, c: np.ndarray, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """A lower and an upper bound of |x - c|^2 - |x|^2 for all rows and centroids, from a matrix
    product in ``kind``.

    n products of two rounded numbers, added in any order, err by at most g * sum(|x_i c_i|) with
    g = (n + 2) u / (1 - (n + 2) u), and that sum is at most |x| |c|.  Whole numbers have no
    underflow.  What isn't a number bounds nothing."""
    unit = UNIT if kind is np.float32 else 2.0**-53
    with np.errstate(over="ignore", invalid="ignore"):
        dots = (_double(x).astype(kind) @ _double(c).astype(kind).T).astype(np.float64)
        c2 = _double((c * c).sum(axis=1))
        # norms rounded up; the double-precision steps here err by far less than 2**-44 of their terms
        x_norm, c_norm = np.sqrt(_double((x * x).sum(axis=1))) * (1 + 2.0**-44), np.sqrt(c2) * (1 + 2.0**-44)
        g = (x.shape[1] + 2) * unit / (1 - (x.shape[1] + 2) * unit)
        reach = 2 * g * (1 + 2.0**-20) * np.outer(x_norm, c_norm) + 2.0**-44 * (c2 + 2 * np.abs(dots))
        lower, upper = c2 - 2 * dots - reach, c2 - 2 * dots + reach
    none = ~(np.isfinite(lower) & np.isfinite(upper))
    lower[none], upper[none] = -np.inf, np.inf
    return lower, upper


def screen(x: np.ndarray, c: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to which rows; the nearest ones always are among them.
    Rows and centroids beyond ``WIDE`` are looked at in double precision."""
    lower, upper = np.empty((2, len(x), len(c)))
    narrow = np.zeros(len(c), bool) if x.dtype == object else ~large
    for at, kind in ((narrow, np.float32), (~narrow, np.float64)):
        if at.any():
            some = c[at].astype(np.int64) if kind is np.float32 else c[at]
            lower[:, at], upper[:, at] = bounds(x, some, kind)
    return lower <= upper.min(axis=1)[:, None]


def _exact(x: np.ndarray, c: np.ndarray, large: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the centroid of its ``number``."""
    long = np.full(len(x), x.dtype == object) | large[number]
    out = np.zeros(len(x), object if long.any() else np.int64)
    if not long.all():
        at = np.flatnonzero(~long)
        out[at] = ((x[at].astype(np.int64) - c[number[at]].astype(np.int64)) ** 2).sum(axis=1)
    for at in np.array_split(np.flatnonzero(long), long.sum() // 256 + 1):
        if len(at):
            out[at] = ((x[at].astype(object) - c[number[at]].astype(object)) ** 2).sum(axis=1)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smallest where several are; squared distance)."""
    large = (np.abs(c) >= WIDE).any(axis=1).astype(bool)
    may = screen(x, c, large)
    label = may.argmax(axis=1)
    row, number = np.nonzero(may & (may.sum(axis=1) > 1)[:, None])
    if len(row):
        exact = _exact(x[row], c, large, number)
        if exact.dtype == object:
            order = np.array(sorted(range(len(row)), key=lambda i: (row[i], exact[i], number[i])), np.int64)
        else:
            order = np.lexsort((number, exact, row))
        first = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))]
        label[row[first]] = number[first]
    return label, _exact(x, c, large, label)


def _encode(numbers: list[int]) -> bytes:
    return ",".join(map(str, numbers)).encode()


def _decode(data: bytes) -> list[int]:
    return list(map(int, data.split(b","))) if data else []


def _added(notes: list[bytes]) -> bytes:
    """Notes added number by number; they are whole numbers of any length."""
    return _encode([sum(x) for x in zip(*map(_decode, notes), strict=True)])


def _rows(data: bytes, components: int) -> np.ndarray:
    """A kept block: its width and its numbers, or the numbers in decimal where some are large."""
    if data[0] == 0:
        return np.array(_decode(data[1:]), object).reshape(-1, components)
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, components).astype(np.int64)


def _kept(x: np.ndarray) -> bytes:
    if x.dtype == object:
        return b"\0" + _encode(x.ravel().tolist())
    width = 2 if np.abs(x).max() < 1 << 15 else 4
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def pack(vectors: DataFrame, components: int, scale: int) -> DataFrame:
    """(ids, data): blocks of vectors as whole numbers; large ones in blocks of their own."""
    kind = dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, components)
            large = (np.abs(flat) >= WIDE / scale).any(axis=1)
            for at in (np.flatnonzero(~large), np.flatnonzero(large)):
                for k in range(0, len(at), BLOCK):
                    some = at[k : k + BLOCK]
                    ids = pa.array([batch.column(0).take(pa.array(some)).to_pylist()], pa.list_(batch.schema.field(0).type))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([_kept(whole(flat[some], scale))], pa.binary())], names=["ids", "data"])

    return durable(bounded_batches(vectors).mapInArrow(kernel.lean(run), f"ids array<{kind}>, data binary"))


def _starts(vectors: DataFrame, centroids: int, salt: str, scale: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; a bounded number of rows."""
    hashed = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(hashed.asc_nulls_last(), "vector").limit(centroids).select("vector").collect()
    return whole(np.array([r["vector"] for r in rows], np.float64), scale)


def _pass(packed: DataFrame, c: np.ndarray, inertia: bool) -> list[int]:
    """One pass over all blocks: of each centroid how many vectors and, of their components or
    else of their distances, the sums.  All centroids' counts come first."""
    k, width = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, 1 if inertia else width), object)
        for batch in batches:
            for data in batch.column(0):
                x = _rows(data.as_py(), width)
                label, apart = nearest(x, c)
                count += np.bincount(label, minlength=k)
                order = np.argsort(label, kind="stable")
                head = np.flatnonzero(np.diff(label[order], prepend=-1))
                added = np.add.reduceat((apart[:, None] if inertia else x)[order], head, axis=0)
                sums[label[order][head]] += added.astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([_encode([*count.tolist(), *sums.ravel().tolist()])], pa.binary())], names=["survey"])

    told, _ = blocks.fold(packed.select("data").mapInArrow(kernel.lean(run), "survey binary"), _added)
    return _decode(told or b"")


def _centroids(c: np.ndarray, told: list[int]) -> np.ndarray:
    """The means of the vectors of each centroid, rounded down; those without any stay."""
    k, width = c.shape
    count, sums = told[:k], told[k:]
    out = [[s // count[j] for s in sums[j * width : (j + 1) * width]] if count[j] else c[j].tolist() for j in range(k)]
    large = any(abs(x) >= WIDE for row in out for x in row)
    return np.array(out, object if large else np.int64).reshape(k, width)


def _long(x: int) -> int | None:
    return x if x <= _LONG else None


def cluster(
    vectors: DataFrame, centroids: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that
    counts, after ``rounds`` rounds and a last assignment.  ``scale`` is a power of two."""
    kind = dict(vectors.dtypes)[id_col]
    taken = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = taken.where((F.size("vector") == components) & finite).withColumn("vector", F.col("vector").cast("array<double>"))
    schema = f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    c = _starts(taken, centroids, salt, scale)
    if not len(c):
        return vectors.sparkSession.createDataFrame([], schema)
    packed = pack(taken, components, scale)
    for _ in range(rounds):
        c = _centroids(c, _pass(packed, c, inertia=False))
    own = _pass(packed, c, inertia=True)[len(c) :]
    inertia, total = [_long(x) for x in own], _long(sum(own))
    digest = [hashlib.sha256(_encode(row)).hexdigest() for row in c.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1), strict=True):
                label, apart = nearest(_rows(data.as_py(), components), c)
                at = pa.array(label, pa.int32())
                columns = [ids.values, at, pa.array([_long(x) for x in apart.tolist()], pa.int64()), pa.array(inertia, pa.int64()).take(at), pa.array([total] * len(label), pa.int64()), pa.array(digest).take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return packed.mapInArrow(kernel.lean(run), schema)
