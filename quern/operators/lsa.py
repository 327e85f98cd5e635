"""Vectors of texts by latent semantic analysis, fitted on the corpus: a randomised SVD of its TF-IDF matrix by block products.

Terms are hashed to a fixed number of columns. The matrix, a row of unit length for each text, is never formed: a task makes rows
of its texts from their columns. A pass multiplies each block of rows with a thin matrix Q and the result with the block again, and
adds the products up by blocks of columns, first over groups of tasks, then over all; on the driver lie Q and the sum (columns x
rank), which don't grow with the corpus. After a few passes Q spans the leading directions; a last pass adds up the small
Gram matrix of the rows times Q, whose eigenvectors turn Q into right singular vectors and whose eigenvalues are the squares of the
singular values. A text's vector is its row times those, of unit length.

Texts are tokenized once and their distinct columns stored with counts, which all passes and ``fit_encode``'s vectors read. Columns that
more than DENSE_SHARE of the texts have, which hold most entries, are multiplied as a dense matrix. Every text is fitted to and gets a vector.

Defined cases: a text without tokens has the zero vector; a null text is an empty one; repeated rows count as often as they occur; an
empty corpus has no singular values, and zero vectors for any text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute in tasks
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import tokenize
from quern.sources.shared import stored

#: Columns that terms are hashed to, length of vectors, further directions that a pass holds, and passes.
COLUMNS, RANK, SPARE, PASSES = 1 << 15, 64, 16, 4
#: Entries of a block of rows; columns of a block of a sum; tasks whose sums are added first.
ENTRIES, SUM_COLUMNS, GROUPS = 1 << 17, 512, 32
#: Columns of the dense part at most, the share of the texts that must have one, and cells of a block's dense part; other entries that are added at once.
DENSE_COLUMNS, DENSE_SHARE, CELLS, STEP = 1 << 13, 1 / 1000, 1 << 22, 1 << 10


@dataclass
class Lsa:
    """idf of each column; directions (columns x rank), of unit length and orthogonal; their singular values, falling; the columns that many texts have."""

    idf: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    often: np.ndarray


@dataclass
class Rows:
    """Rows of the matrix: the columns that many texts have as a dense part, the other entries in the order of their rows."""

    dense: np.ndarray
    row: np.ndarray
    column: np.ndarray
    weight: np.ndarray

    def times(self, q: np.ndarray, q_often: np.ndarray) -> np.ndarray:
        """The rows times ``q``, of whose rows ``q_often`` has those of the dense part."""
        y = self.dense @ q_often
        _add(self.row, self.column, self.weight, q, y)
        return y

    def add_transposed(self, y: np.ndarray, into: np.ndarray, into_often: np.ndarray) -> None:
        """Add the transposed rows times ``y``, those of the dense part to ``into_often``."""
        into_often += self.dense.T @ y
        order = np.argsort(self.column, kind="stable")
        _add(self.column[order], self.row[order], self.weight[order], y, into)


def _add(to: np.ndarray, at: np.ndarray, weight: np.ndarray, x: np.ndarray, into: np.ndarray) -> None:
    """Add ``weight`` times the rows ``at`` of ``x`` to the rows ``to``, which are in order, some STEP at a time, as small arrays stay in the cache."""
    for i in range(0, len(to), STEP):
        some = to[i : i + STEP]
        first = np.flatnonzero(np.diff(some, prepend=-1))
        into[some[first]] += np.add.reduceat(weight[i : i + STEP, None] * x[at[i : i + STEP]], first)


@dataclass
class Weights:
    """What weighs a column: its idf; the columns that so many texts have that their part is dense, and each column's place among them (-1: none)."""

    idf: np.ndarray
    often: np.ndarray
    place: np.ndarray


def weights(idf: np.ndarray, df: np.ndarray, n: int) -> Weights:
    many = np.argsort(-df, kind="stable")[:DENSE_COLUMNS]
    often = np.sort(many[df[many] > n * DENSE_SHARE])
    place = np.full(len(idf), -1)
    place[often] = np.arange(len(often))
    return Weights(idf, often, place)


def columns_of(docs: DataFrame, columns: int) -> DataFrame:
    """id, columns: the column of each token of (id, text)."""
    return docs.select("id", _hashed(columns).alias("columns"))


def _hashed(columns: int) -> Column:
    return F.transform(tokenize(F.coalesce("text", F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(columns)).cast("int"))


def entries_of(docs: DataFrame, columns: int) -> DataFrame:
    """``docs`` (text, and others) with column and tf, the distinct columns of each text's tokens and how often it has them, in place of the text."""
    names = [c for c in docs.columns if c not in ("text", "columns", "column", "tf", "embedding")]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("columns")
            lengths = pa.compute.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            token = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            key, tf = np.unique(np.repeat(np.arange(batch.num_rows), lengths) * columns + token, return_counts=True)
            row, column = np.divmod(key, columns)
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            listed = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (column, tf)]
            yield pa.record_batch([*(batch.column(c) for c in names), *listed], names=[*names, "column", "tf"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema), "column array<int>, tf array<int>"])
    return docs.select(*names, _hashed(columns).alias("columns")).mapInArrow(counted, schema)


def blocks(batches: Iterator[pa.RecordBatch], by: Weights) -> Iterator[tuple[pa.RecordBatch, Rows]]:
    """Blocks of some ENTRIES entries and CELLS cells of the dense part (one text at least) and their rows of the matrix: (1 + log tf) * idf, of unit length."""
    most = max(1, CELLS // max(1, len(by.often)))
    buffer = np.zeros((most if len(by.often) else 0, len(by.often)))  # one for all blocks, as new ones cost more than the products
    for batch in batches:
        ends = np.cumsum(pa.compute.list_value_length(batch.column("column")).to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, min(start + most, int(np.searchsorted(ends, done + ENTRIES, side="right"))))
            some = batch.slice(start, stop - start)
            column, tf = (some.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("column", "tf"))
            row = np.repeat(np.arange(some.num_rows), np.diff(ends[start:stop], prepend=done))
            weight = (1 + np.log(tf)) * by.idf[column]
            norms = np.sqrt(np.bincount(row, weight**2, some.num_rows))
            weight = weight / np.where(norms > 0, norms, 1)[row]
            place = by.place[column]
            often = place >= 0
            cells = (row[often], place[often])
            dense = buffer[: some.num_rows] if len(by.often) else np.zeros((some.num_rows, 0))
            dense[cells] = weight[often]
            yield some, Rows(dense, row[~often], column[~often], weight[~often])
            dense[cells] = 0
            start, done = stop, int(ends[stop - 1])


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices that tasks give as blocks of columns: block, part (task), sum (bytes)."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = None, None
        for batch in batches:
            key = batch.select(["block", "part"]).slice(0, 1) if batch.num_rows else key
            for x in batch.column("sum"):
                y = np.frombuffer(x.as_buffer())
                total = y.copy() if total is None else total + y
        yield pa.record_batch([*key.columns, pa.array([total.tobytes()], pa.binary())], names=["block", "part", "sum"])

    schema = "block int, part int, sum binary"
    some = parts.withColumn("part", F.col("part") % GROUPS).groupBy("block", "part").applyInArrow(added, schema)
    out = np.zeros(shape)
    for r in some.groupBy("block").applyInArrow(added, schema).toLocalIterator():  # columns x rank in all
        out[r["block"] * SUM_COLUMNS : (r["block"] + 1) * SUM_COLUMNS] = np.frombuffer(r["sum"]).reshape(-1, shape[1])
    return out


def fit(docs: DataFrame, rank: int = RANK, columns: int = COLUMNS, passes: int = PASSES, seed: int = 1) -> Lsa:
    """Fit to all texts of (id, text)."""
    return _fit(stored(entries_of(docs.select("text"), columns), "entries"), rank, columns, passes, seed)


def fit_encode(docs: DataFrame, rank: int = RANK, columns: int = COLUMNS, passes: int = PASSES, seed: int = 1) -> DataFrame:
    """``docs`` (id, text, and others) with embedding in place of the text, fitted to these texts, which are tokenized once for both."""
    rows = stored(entries_of(docs, columns), "entries")
    return _encode(rows, _fit(rows, rank, columns, passes, seed))


def _fit(rows: DataFrame, rank: int, columns: int, passes: int, seed: int) -> Lsa:
    """Fit to the rows of ``entries_of``."""
    spark, n = rows.sparkSession, rows.count()

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(columns, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("column").flatten().to_numpy(zero_copy_only=False), minlength=columns)
        yield pa.record_batch([pa.array(np.flatnonzero(df).astype(np.int32)), pa.array(df[df > 0])], names=["at", "total"])

    df = np.zeros(columns)
    counted = rows.select("column").mapInArrow(having, "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).toArrow()  # one row a column
    df[counted["at"].to_numpy()] = counted["total"].to_numpy()
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)
    by, rows = weights(idf, df, n), rows.select("column", "tf")
    rank_and_spare = min(rank + SPARE, columns)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, rank_and_spare)) * (df > 0)[:, None])[0]

    def products(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        by, q = shared.value
        total, q_often = np.zeros(q.shape), q[by.often]
        often = np.zeros(q_often.shape)
        for _, some in blocks(batches, by):
            some.add_transposed(some.times(q, q_often), total, often)
        total[by.often] = often
        for b in range(0, len(total), SUM_COLUMNS):
            if total[b : b + SUM_COLUMNS].any():
                yield pa.record_batch([pa.array([b // SUM_COLUMNS], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total[b : b + SUM_COLUMNS].tobytes()], pa.binary())], names=["block", "part", "sum"])

    for _ in range(passes):
        shared = spark.sparkContext.broadcast((by, q))
        parts = rows.mapInArrow(lambda batches, shared=shared: products(batches, shared), "block int, part int, sum binary")
        q = np.linalg.qr(_summed(parts, q.shape))[0]
        shared.unpersist()
    shared = spark.sparkContext.broadcast((by, q))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, q = shared.value
        total, q_often = np.zeros((q.shape[1],) * 2), q[by.often]
        for _, some in blocks(batches, by):
            y = some.times(q, q_often)
            total += y.T @ y
        yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "total"])

    small = rows.mapInArrow(gram, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    g = np.zeros(q.shape[1] ** 2)
    g[small["at"].to_numpy()] = small["total"].to_numpy()
    e, w = np.linalg.eigh(g.reshape(q.shape[1], -1))
    e, w = e[::-1][:rank], w[:, ::-1][:, :rank]
    some = e > max(e[:1].max(initial=0) * 1e-12, 1e-12)
    directions = q @ w[:, some]
    signs = np.sign(directions[np.argmax(np.abs(directions), axis=0), np.arange(directions.shape[1])])  # of either sign the one whose largest entry is positive
    return Lsa(idf, directions * signs, np.sqrt(e[some]), by.often)


def encode(docs: DataFrame, model: Lsa) -> DataFrame:
    """``docs`` (id, text, and others) with embedding: unit vectors of as many components as the model has."""
    named = docs.withColumn("_text", F.col("text")) if "text" in docs.columns else docs
    names = [c for c in docs.columns if c not in ("columns", "embedding")]
    return _encode(entries_of(named, len(model.idf)), model).select(*(F.col("_text").alias(c) if c == "text" else F.col(f"`{c}`") for c in names), "embedding")


def _encode(rows: DataFrame, model: Lsa) -> DataFrame:
    """The rows of ``entries_of`` with embedding in place of column and tf."""
    place = np.full(len(model.idf), -1)
    place[model.often] = np.arange(len(model.often))
    shared = rows.sparkSession.sparkContext.broadcast((Weights(model.idf, model.often, place), model.directions))
    names = [c for c in rows.columns if c not in ("column", "tf")]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, directions = shared.value
        k, often = directions.shape[1], directions[by.often]
        for batch, some in blocks(batches, by):
            y = some.times(directions, often)
            norms = np.linalg.norm(y, axis=1, keepdims=True)
            x = (y / np.where(norms > 0, norms, 1)).astype(np.float32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(x.ravel()))
            yield pa.record_batch([*(batch.column(c) for c in names), listed], names=[*names, "embedding"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema), "embedding array<float>"])
    return rows.mapInArrow(vectors, schema)
