"""An inverted-file index of unit vectors: k-means cells, vectors stored by cell, searches of the nearest cells.

Cells are fitted by Lloyd's rounds in which tasks add up their vectors by cell; a bounded number of vectors, picked by a hash of
the id, takes part (``fit_rows``), and every vector is indexed. The centres (cells x length) are all that the driver
and a broadcast hold. Vectors lie in a folder for each cell, a large cell in several files, so a search reads only the folders
of the cells that some query probes (partition filters) and multiplies each block with those queries alone.

With all cells probed the result is that of ``dense_search``; ``recall`` measures what fewer find.

Defined cases: null vectors are left out; an empty table has no cells and no hits; equal vectors share a cell, however
many they are; fewer vectors than cells leave cells empty, which are never probed for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.operators.retrieval import BLOCK_PRODUCTS, MIN_SCORE, best_rows, dense_search, keep_best, query_blocks, top_k
from quern.sources.shared import stored

#: Vectors that the cells are fitted to, about, at most; rounds of the fit; vectors of a cell in a file, about.
FIT_ROWS, ROUNDS, FILE_ROWS = 1 << 20, 6, 1 << 18
#: Components are added up as whole numbers of this unit, so that sums don't depend on their order.
UNIT = 1 << 20


@dataclass
class CellIndex:
    """vectors (id, embedding, cell, and others), stored by cell; the cells' centres; how many vectors each cell has."""

    vectors: DataFrame
    centres: np.ndarray
    sizes: np.ndarray


def matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x.reshape(len(column), -1)


def nearest_cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell of each row: the largest product with a centre, of equal ones the first."""
    step = max(1, BLOCK_PRODUCTS // len(centres))
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T, axis=1) for i in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)


def fit_cells(vectors: DataFrame, cells: int, rounds: int = ROUNDS, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Centres as unit vectors. The first are vectors of the least hashes of ids; a cell without vectors keeps its centre."""
    rows = vectors.where("embedding is not null").select("id", "embedding")
    n = rows.count()
    if not n:
        return np.empty((0, 0))
    key = F.xxhash64("id")
    start = rows.orderBy(key, "id").limit(cells).select("embedding").toArrow()
    centres = matrix(start.column(0).combine_chunks())
    fitted = rows if n <= fit_rows else rows.where(F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(centres)

        def added(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            counts, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
            for batch in batches:
                x = matrix(batch.column("embedding"))
                cell = nearest_cells(x, centres)
                counts += np.bincount(cell, minlength=len(centres))
                np.add.at(sums, cell, np.rint(x * UNIT).astype(np.int64))
            used, places = np.flatnonzero(counts), np.arange(sums.shape[1] + 1)
            yield pa.record_batch([pa.array(np.repeat(used, len(places)).astype(np.int32)), pa.array(np.tile(places, len(used)).astype(np.int32)), pa.array(np.column_stack([counts, sums])[used].ravel())], names=["cell", "place", "total"])

        found = fitted.select("embedding").mapInArrow(added, "cell int, place int, total long").groupBy("cell", "place").agg(F.sum("total").alias("total")).toArrow()  # cells x (length + 1)
        totals = np.zeros((len(centres), centres.shape[1] + 1))
        totals[found["cell"].to_numpy(), found["place"].to_numpy()] = found["total"].to_numpy()
        norms = np.linalg.norm(totals[:, 1:], axis=1, keepdims=True)
        centres = np.where(norms > 0, totals[:, 1:] / np.where(norms > 0, norms, 1), centres)
        shared.unpersist()
    return centres


def build_cells(vectors: DataFrame, cells: int | None = None, path: str | None = None, rounds: int = ROUNDS, fit_rows: int = FIT_ROWS) -> CellIndex:
    """Index every vector of (id, embedding, and others). Without ``cells``: twice the root of the number of vectors, 65,536 at most."""
    rows, spark = vectors.where("embedding is not null"), vectors.sparkSession
    cells = cells or min(1 << 16, max(1, int(2 * rows.count() ** 0.5)))
    centres = fit_cells(rows, cells, rounds, fit_rows)
    shared = spark.sparkContext.broadcast(centres)
    schema = rows.schema

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = nearest_cells(matrix(batch.column("embedding")), shared.value)
            yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    named = rows.mapInArrow(placed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", cell int")
    counts = named.groupBy("cell").count().toArrow()  # one row a cell
    sizes = np.zeros(len(centres), np.int64)
    sizes[counts["cell"].to_numpy()] = counts["count"].to_numpy()
    files = -(-sizes // FILE_ROWS)
    # large cells are dealt to several tasks, each of which writes a file
    large = spark.createDataFrame([(int(c), int(files[c])) for c in np.flatnonzero(files > 1)], "cell int, files int")
    dealt = named.join(F.broadcast(large), "cell", "left").withColumn("_file", F.coalesce(F.pmod(F.xxhash64("id"), F.col("files")), F.lit(0)))  # a row a cell
    written = dealt.repartition("cell", "_file").select(*schema.names, "cell")
    return CellIndex(stored(written, "cells", "cell", path=path), centres, sizes)


def cell_search(index: CellIndex, queries: DataFrame, k: int = 7, probes: int | None = 8, min_score: float = MIN_SCORE) -> DataFrame:
    """query_id, id, score, rank: top k of the ``probes`` cells nearest to each query (None: all cells); the score filter follows the cut."""
    spark, vectors = queries.sparkSession, index.vectors
    kind, query_kind = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"query_id {query_kind}, id {kind}, points long")
    filled = np.flatnonzero(index.sizes)
    for ids, q in query_blocks(queries) if len(filled) else ():
        near = q @ index.centres[filled].T
        n = len(filled) if probes is None else min(probes, len(filled))
        chosen = filled[np.argsort(-near, axis=1, kind="stable")[:, :n]]
        asks = {int(c): np.flatnonzero((chosen == c).any(axis=1)) for c in np.unique(chosen)}
        shared = spark.sparkContext.broadcast((q, asks))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, asks = shared.value
            held: pa.RecordBatch | None = None
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                order = np.argsort(cell, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else ():
                    asking = asks[int(cell[some[0]])]
                    for start in range(0, len(some), step := max(k, BLOCK_PRODUCTS // len(asking))):
                        rows = batch.take(pa.array(some[start : start + step]))
                        held = keep_best(held, best_rows(rows, q[asking], k, asking), k)
            if held is not None:
                yield held

        read = vectors.where(F.col("cell").isin(list(asks))).select("id", "embedding", "cell")  # partition filters
        names = spark.createDataFrame(list(enumerate(ids)), f"at int, query_id {query_kind}")
        hits = read.mapInArrow(best, f"at int, id {kind}, points long").join(F.broadcast(names), "at")  # the block's queries
        found = found.unionByName(hits.select("query_id", "id", "points"))
    scored = found.select("query_id", "id", (F.col("points") / 10_000).alias("score"))
    return top_k(scored, "score", k).where(F.col("score") > min_score).select("query_id", "id", "score", "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, n_exact, n_found: how many of each query's exact hits were found; hits as good as the last exact one count too."""
    least = exact.groupBy("query_id").agg(F.count("*").alias("n_exact"), F.min("score").alias("least"))
    good = found.join(least, "query_id").where("score >= least").groupBy("query_id").agg(F.count("*").alias("n"))
    return least.join(good, "query_id", "left").select("query_id", "n_exact", F.least("n_exact", F.coalesce("n", F.lit(0))).alias("n_found"))


def probes_for(index: CellIndex, k: int = 7, target: float = 0.9, sample: int = 256, margin: float = 0.03) -> int:
    """How many cells to probe so that ``target`` of the exact top k are found, measured on ``sample`` vectors as queries.

    The sample (the least hashes of ids) is searched exactly; the rank of a hit's cell among those nearest to its query tells
    from how many probes on it is found. ``margin`` is added to the target for what a sample can't tell.
    """
    asked = index.vectors.orderBy(F.xxhash64("id", F.lit("probe")), "id").limit(sample).select(F.col("id").alias("query_id"), "embedding")
    exact = dense_search(index.vectors, asked, k)
    cells = exact.join(index.vectors.select("id", "cell"), "id").select("query_id", "cell")
    ids, q = [], []
    for some, block in query_blocks(asked):
        ids, q = ids + some, [*q, block]
    if not ids:
        return 1
    filled = np.flatnonzero(index.sizes)
    order = filled[np.argsort(-(np.concatenate(q) @ index.centres[filled].T), axis=1, kind="stable")]
    rank = {i: {int(c): r for r, c in enumerate(cells)} for i, cells in zip(ids, order, strict=True)}
    needed = np.sort([rank[r["query_id"]][r["cell"]] + 1 for r in cells.collect()])  # sample x k rows
    return int(needed[min(len(needed) - 1, int(np.ceil(len(needed) * min(1.0, target + margin))) - 1)]) if len(needed) else 1
