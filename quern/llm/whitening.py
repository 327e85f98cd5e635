"""Whitening of embeddings: blockwise TSQR to a triangle, one-sided Jacobi rotations, projection.

Three passes over the vectors. The first adds up n and the sum of each dimension. The second centres rows and
folds them, a block at a time, into one triangle R a task (QR of the triangle so far above the block), and tasks' triangles
are folded by groups until one is left. On the driver, plane rotations make R's columns orthogonal: their norms over sqrt(n)
are the standard deviations, and the same rotations, accumulated, the components. As R isn't squared, small deviations keep
their digits. The third pass projects the rows and adds up what tells the covariance of the result.

R, the components and the sums grow with the square of the vectors' length, not with their number; nothing else
is broadcast or sent to the driver. No row is shuffled.

Entries become whole numbers x, so sums and the deviation are exact; rows are centred as (x - m) - (S/n - m) with the whole number m
below the mean, which loses no digits to a large offset.

Defined cases: vectors that are null, empty, or hold null or non-finite entries are left out, and so are those of another length
than most; components without spread (a deviation below the rounding of the largest) aren't given, so equal vectors, or
one alone, give no rows; repeated rows and null ids are rows of their own; a deviation beyond 64 bits is null; entries stop at 2**45, which
keeps their sums exact. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.codes import kept_vectors
from quern.llm.common import discard, persist

#: Rows of a block, and triangles that one task folds into one.
BLOCK, FAN_IN = 1024, 64
LARGEST = 1 << 45


@dataclass
class Whitening:
    """n rows of the fit with sums of the whole numbers; components (a column each) by falling deviation, and the sum of all variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    trace: float
    scale: float
    shift: int


def whole(column: pa.Array, dim: int, scale: float, shift: int) -> np.ndarray:
    """floor(scale * entry) + shift of a list column, as longs."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(scale * c), -LARGEST, LARGEST).astype(np.int64) + shift


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    below, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])
    return (x - below) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sum)^2 for each row, exact; null beyond 64 bits."""
    y = x - np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    if float(((np.abs(y).astype(np.float64) + 1) ** 2).sum(1).max(initial=0)) * n * n < 2**62:
        return ((n * y - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    exact = (sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist())
    return [e if e < 1 << 63 else None for e in exact]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield batch.slice(start, BLOCK)


def column_sums(kept: DataFrame, dim: int, scale: float, shift: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension. Tasks send theirs in two halves, as neither then leaves 64 bits."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in blocks(batches):
            x = whole(batch.column("embedding"), dim, scale, shift)
            n, high, low = n + len(x), high + (x >> 24).sum(0), low + (x & 0xFFFFFF).sum(0)
        yield pa.record_batch([pa.array(np.arange(-1, dim, dtype=np.int32)), pa.array([0, *high.tolist()]), pa.array([n, *low.tolist()])], names=["at", "high", "low"])

    big = "decimal(38,0)"
    found = kept.select("embedding").mapInArrow(added, "at int, high long, low long").groupBy("at").agg(F.sum(F.col("high").cast(big)).alias("high"), F.sum(F.col("low").cast(big)).alias("low"))
    sums = [0] * (dim + 1)
    for r in found.toLocalIterator():  # one row a dimension
        sums[r["at"]] = (int(r["high"]) << 24) + int(r["low"])
    return sums[-1], sums[:-1]


def fold(triangle: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if triangle is None else np.vstack([triangle, block]), mode="r")


def packed(triangle: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if triangle is not None:
        yield pa.record_batch([pa.array([triangle.tobytes()], pa.binary())], names=["r"])


def triangle(kept: DataFrame, dim: int, n: int, sums: list[int], scale: float, shift: int) -> np.ndarray:
    """R of the centred rows' QR: of each task, then of groups of FAN_IN tasks until one is left."""

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in blocks(batches):
            r = fold(r, centred(whole(batch.column("embedding"), dim, scale, shift), n, sums))
        yield from packed(r)

    def of_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for x in batch.column(0):
                r = fold(r, np.frombuffer(x.as_py()).reshape(-1, dim))
        yield from packed(r)

    made = persist(kept.select("embedding").mapInArrow(of_rows, "r binary"), "triangles")
    while (count := made.count()) > 1:
        last, made = made, persist(made.repartition(-(-count // FAN_IN)).mapInArrow(of_triangles, "r binary"), "triangles")
        discard(last)
    r = np.frombuffer(made.first()["r"]).reshape(-1, dim)
    discard(made)
    return r


def jacobi(r: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, norms) by falling norm: rotations of pairs of columns until all are orthogonal.

    In each step of a sweep all columns are paired (a round robin), so the rotations of a step are independent.
    """
    d = r.shape[1]
    even = d + d % 2
    a, v = np.zeros((len(r), even)), np.eye(even)
    a[:, :d] = r
    seats = np.arange(even)
    for _ in range(sweeps):
        turned = False
        for _ in range(even - 1):
            p, q = seats[: even // 2], seats[even // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            skew = np.abs(xy) > tolerance * np.sqrt(xx * yy)
            if skew.any():
                turned = True
                p, q, xx, yy, xy = p[skew], q[skew], xx[skew], yy[skew], xy[skew]
                z = (yy - xx) / (2 * xy)
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    norms = np.sqrt((a * a).sum(0))[:d]
    order = np.argsort(-norms, kind="stable")
    return v[:d, :d][:, order], norms[order]


def fit(kept: DataFrame, dim: int, scale: float = 64.0, shift: int = 1_000_000) -> Whitening:
    n, sums = column_sums(kept, dim, scale, shift)
    components, norms = jacobi(triangle(kept, dim, n, sums, scale, shift))
    spread = norms > dim * np.finfo(float).eps * norms[:1]
    return Whitening(n, sums, components[:, spread], norms[spread] / np.sqrt(n), float((norms**2).sum() / n), scale, shift)


def identity_error(kept: DataFrame, model: Whitening, k: int) -> float:
    """The largest absolute entry of the first k whitened columns' covariance less the identity, from the rows themselves."""
    shared = kept.sparkSession.sparkContext.broadcast(model)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dim, gram = len(m.sums), np.zeros((k, k))
        for batch in blocks(batches):
            w = centred(whole(batch.column("embedding"), dim, m.scale, m.shift), m.n, m.sums) @ m.components[:, :k] / m.deviations[:k]
            gram += w.T @ w
        yield pa.record_batch([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(gram.ravel())], names=["at", "total"])

    found = kept.select("embedding").mapInArrow(added, "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
    wrong = F.abs(F.col("total") / model.n - F.when(F.col("at") % (k + 1) == 0, 1.0).otherwise(0.0))
    return found.agg(F.max(wrong)).first()[0]


def project(kept: DataFrame, model: Whitening, k: int) -> DataFrame:
    """(vec_id, deviation (long), whitened (array of double, one a component)) of rows of the fit's length."""
    shared, kind = kept.sparkSession.sparkContext.broadcast(model), kept.schema["vec_id"].dataType.simpleString()

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in blocks(batches):
            x = whole(batch.column("embedding"), len(m.sums), m.scale, m.shift)
            w = centred(x, m.n, m.sums) @ m.components[:, :k] / m.deviations[:k]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.record_batch([batch.column("vec_id"), pa.array(deviations(x, m.n, m.sums), pa.int64()), listed], names=["vec_id", "deviation", "whitened"])

    return kept.select("vec_id", "embedding").mapInArrow(projected, f"vec_id {kind}, deviation long, whitened array<double>")


def whitened_components(vectors: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained (share of all variance), identity_error: a row for each vector and component."""
    kept, dim = kept_vectors(vectors)
    model = fit(kept, dim) if dim else None
    k = min(components, len(model.deviations)) if dim else 0
    if not k:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*map(F.lit, (model.deviations[:k] ** 2 / model.trace).tolist()))
    found = project(kept, model, k).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error(kept, model, k)).alias("identity_error"))
