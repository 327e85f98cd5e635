"""Vector codes by product quantisation: Lloyd's rounds filtered through kd-trees.

Vectors of integers are cut into equal parts. Every block of rows builds a kd-tree over each of its parts once:
a node knows the box, the count and the sum of its points, and lies with them in the shared folder. A round
takes the codebooks down the trees, level by level: of a node's candidate entries the one nearest the box's
middle is kept, and one that is farther from all of the box is eliminated. Where one entry is left, the whole
subtree is assigned through its count and sum; in leaves, points are compared with what candidates are left.
All is whole numbers, so results don't depend on blocks or order.

Nothing is shuffled but counts and sums by (part, entry), added up in a task before; the codebooks (parts x
entries, of the length of a part) are all that the driver holds. Equal vectors share a box without extent,
where one entry is left at once, however many they are.

Defined cases: vectors that are null, empty, or hold null or non-finite components are left out, and so are those of another
length than most (of equally frequent lengths the larger counts); a length that the parts don't divide gives the first
parts a component more; fewer vectors than entries give fewer entries. A null vec_id comes last among
the first entries, equal ids by their vectors; repeated rows are rows of their own. Components beyond what keeps a sum of
squared distances in 64 bits (some 2**27 for 64 components) stop there. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import join_hot, persist

#: Rows of a block, and points of a leaf at most.
BLOCK, LEAF = 4096, 16
#: Pairs of points and candidates that are compared at once.
PAIRS = 1 << 18


def finite(vector: Column) -> Column:
    """Whether a vector has components and all are finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def kept_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose vector is finite and of the most frequent length, and that length (0 without rows)."""
    rows = vectors.where(finite(F.col("embedding")))
    most = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = most["n"] if most else 0
    return rows.where(F.size("embedding") == dim), dim


def integers(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * component) of a list column, as longs; within what keeps distances in 64 bits."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    limit = int(2**30.5 / dim**0.5)
    return np.clip(np.floor(x * scale), -limit, limit).astype(np.int64)


# --- trees ---------------------------------------------------------------------------------------


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end among n points in the order of the tree."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def depth(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, low, high, sums) of a kd-tree over points: nodes from the root down, level by level.

    A node is split in halves across the side of its box that is longest.
    """
    n, order = len(points), np.arange(len(points))
    levels = depth(n)
    for level in range(levels):
        at, p = bounds(n, level), points[order]
        node = np.repeat(np.arange(len(at) - 1), np.diff(at))
        low, high = np.minimum.reduceat(p, at[:-1]), np.maximum.reduceat(p, at[:-1])
        side = np.argmax(high - low, axis=1)
        value = np.take_along_axis(p, side[node][:, None], 1)[:, 0] - low[node, side[node]]
        order = order[np.argsort(node * (int(value.max()) + 1) + value, kind="stable")]
    p, at = points[order], bounds(n, levels)[:-1]
    tree = [(np.minimum.reduceat(p, at), np.maximum.reduceat(p, at), np.add.reduceat(p, at))]
    for _ in range(levels):
        low, high, sums = tree[-1]
        tree.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2]))
    low, high, sums = (np.concatenate(x) for x in zip(*reversed(tree), strict=True))
    return order, low, high, sums


def nearest_of(owner: np.ndarray, entry: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each owner, its nearest entry): owners in ascending runs, entries ascending in them; ties to the lower."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    least = np.minimum.reduceat(d2, first)
    run = np.repeat(np.arange(len(first)), np.diff(first, append=len(owner)))
    return first, np.minimum.reduceat(np.where(d2 == least[run], entry, np.iinfo(np.int64).max), first)


def filtered(tree: tuple[np.ndarray, ...], points: np.ndarray, book: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the points nearest to each entry; ``points`` in the order of the tree, whose codes go into ``codes``."""
    low, high, node_sums = tree
    n, k = len(points), len(book)
    counts, sums = np.zeros(k, np.int64), np.zeros_like(book)
    node, entry = np.zeros(k, np.int64), np.arange(k)  # pairs of a node of the level and a candidate
    levels, base = depth(n), 0
    for level in range(levels + 1):
        at, lo, hi = bounds(n, level), low[base:], high[base:]
        z = book[entry]
        first, best = nearest_of(node, entry, ((2 * z - lo[node] - hi[node]) ** 2).sum(1))
        size = np.diff(first, append=len(node))
        star = np.repeat(best, size)
        to, b = z - book[star], book[star]
        # least of |p - z|^2 - |p - star|^2 in the box, which is linear in p
        least = (to * (z + b) - 2 * to * np.where(to > 0, hi[node], lo[node])).sum(1)
        stays = (least < 0) | ((least == 0) & (entry <= star))
        node, entry = node[stays], entry[stays]
        left = np.bincount(node, minlength=len(at) - 1)
        one = left[node] == 1
        np.add.at(counts, entry[one], np.diff(at)[node[one]])
        np.add.at(sums, entry[one], node_sums[base + node[one]])
        if codes is not None:
            for i, e in zip(node[one], entry[one], strict=True):
                codes[at[i] : at[i + 1]] = e
        node, entry = node[~one], entry[~one]
        if not len(node) or level == levels:
            break
        base += 1 << level
        # both children take the candidates of their parent
        node = np.concatenate([2 * node, 2 * node + 1])
        entry = np.concatenate([entry, entry])
        order = np.argsort(node, kind="stable")
        node, entry = node[order], entry[order]
    if len(node):
        compare(points, book, node, entry, bounds(n, levels), counts, sums, codes)
    return counts, sums


def compare(points: np.ndarray, book: np.ndarray, leaf: np.ndarray, entry: np.ndarray, at: np.ndarray, counts: np.ndarray, sums: np.ndarray, codes: np.ndarray | None) -> None:
    """Each point of the leaves against the candidates left there."""
    first = np.flatnonzero(np.diff(leaf, prepend=-1))
    some, n_entries = leaf[first], np.diff(first, append=len(leaf))
    n_points = np.diff(at)[some]
    cuts = np.searchsorted(np.cumsum(n_entries * n_points), np.arange(PAIRS, int((n_entries * n_points).sum()) + PAIRS, PAIRS)) + 1
    start = 0
    for stop in np.minimum(cuts, len(some)):
        if stop <= start:
            continue
        rows = np.repeat(np.arange(start, stop), n_points[start:stop])  # the leaf of each point
        point = np.arange(len(rows)) - np.repeat(np.cumsum(n_points[start:stop]) - n_points[start:stop], n_points[start:stop]) + at[some[rows]]
        width = n_entries[rows]
        pair = np.repeat(np.arange(len(rows)), width)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(width) - width, width) + first[rows][pair]
        p = points[point]
        _, best = nearest_of(pair, entry[place], ((p[pair] - book[entry[place]]) ** 2).sum(1))
        np.add.at(counts, best, 1)
        np.add.at(sums, best, p)
        if codes is not None:
            codes[point] = best
        start = stop


# --- Spark ---------------------------------------------------------------------------------------


def edges(dim: int, parts: int) -> list[int]:
    return [0, *np.cumsum([dim // parts + (i < dim % parts) for i in range(parts)]).tolist()]


def forest(rows: DataFrame, dim: int, parts: int, scale: float) -> DataFrame:
    """Blocks of rows with their trees, stored: vec_id and label (arrays), and per part the points, order, boxes and sums as bytes."""
    cut = edges(dim, parts)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_blocks(batches):
            x = integers(batch.column("embedding"), dim, scale)
            trees = [build(x[:, a:b]) for a, b in zip(cut, cut[1:], strict=False)]
            points = [x[order, a:b].astype(np.int32).tobytes() for (order, *_), a, b in zip(trees, cut, cut[1:], strict=False)]
            listed = lambda xs: pa.array([xs], pa.list_(pa.binary()))
            packed = [points, [t[0].astype(np.uint16).tobytes() for t in trees], *([t[i].astype(np.int32 if i < 3 else np.int64).tobytes() for t in trees] for i in (1, 2, 3))]
            columns = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in ("vec_id", "label")]
            yield pa.record_batch([*columns, *map(listed, packed)], names=["vec_id", "label", "points", "order", "low", "high", "sums"])

    schema = f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, " + ", ".join(f"{c} array<binary>" for c in ("points", "order", "low", "high", "sums"))
    return persist(rows.select("vec_id", "label", "embedding").mapInArrow(blocks, schema), "trees")


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of BLOCK rows, the last of a task smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, BLOCK - sum(b.num_rows for b in held))
            held.append(some)
            batch = batch.slice(some.num_rows)
            if sum(b.num_rows for b in held) == BLOCK:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def trees_of(row: dict, widths: list[int]) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]]:
    """Of each part of a block: (low, high, sums), the points in the tree's order, and that order."""
    for i, width in enumerate(widths):
        load = lambda c, kind, i=i, width=width: np.frombuffer(row[c][i], kind).astype(np.int64).reshape(-1, width)
        order = np.frombuffer(row["order"][i], np.uint16).astype(np.int64)
        points = np.zeros((len(order), 0), np.int64) if not width else load("points", np.int32)
        if width:
            yield (load("low", np.int32), load("high", np.int32), load("sums", np.int64)), points, order
        else:
            nodes = np.zeros(((2 << depth(len(order))) - 1, 0), np.int64)
            yield (nodes, nodes, nodes), points, order


def rounds_of(trees: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Lloyd's rounds: an entry becomes the floor of its parts' mean, and stays where it has none."""
    widths = [b.shape[1] for b in books]
    for _ in range(rounds):
        shared = trees.sparkSession.sparkContext.broadcast(books)

        def added(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = shared.value
            totals = [[np.zeros(len(b), np.int64), np.zeros_like(b)] for b in books]
            for batch in batches:
                for at in range(batch.num_rows):
                    for part, (tree, points, _) in enumerate(trees_of(batch.slice(at, 1).to_pylist()[0], widths)):
                        counts, sums = filtered(tree, points, books[part])
                        totals[part][0] += counts
                        totals[part][1] += sums
            for part, (counts, sums) in enumerate(totals):
                used = np.flatnonzero(counts)
                places = np.arange(sums.shape[1] + 1)  # the first holds counts
                yield pa.record_batch(
                    [pa.array(np.repeat(np.int32(part), len(used) * len(places))), pa.array(np.repeat(used, len(places)).astype(np.int32)), pa.array(np.tile(places, len(used)).astype(np.int32)), pa.array(np.column_stack([counts, sums])[used].ravel())],
                    names=["part", "entry", "place", "total"],
                )

        found = trees.select("points", "order", "low", "high", "sums").mapInArrow(added, "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
        totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for r in found.toLocalIterator():  # parts x entries x (length + 1) rows
            totals[r["part"]][r["entry"], r["place"]] = r["total"]
        books = [np.where(t[:, :1] > 0, t[:, 1:] // np.maximum(t[:, :1], 1), b) for t, b in zip(totals, books, strict=True)]
        shared.unpersist()
    return books


def quantize(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes (array of int), error (long)) and the codebooks, an array of entries for each part.

    The first entries are the parts of the ``entries`` smallest ids.
    """
    if not 0 < entries <= 256:
        raise ValueError("from 1 to 256 entries")
    kept, dim = kept_vectors(vectors)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long"
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema), []
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow()
    start, cut = integers(first.column(0).combine_chunks(), dim, scale), edges(dim, parts)
    trees = forest(kept, dim, parts, scale)
    books = rounds_of(trees, [start[:, a:b] for a, b in zip(cut, cut[1:], strict=False)], rounds)
    shared, widths = trees.sparkSession.sparkContext.broadcast(books), [b.shape[1] for b in books]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                some = batch.slice(at, 1)
                row = some.select(["points", "order", "low", "high", "sums"]).to_pylist()[0]
                ids, labels = some.column("vec_id").flatten(), some.column("label").flatten()
                codes, error = np.zeros((len(ids), len(books)), np.int32), np.zeros(len(ids), np.int64)
                for part, (tree, points, order) in enumerate(trees_of(row, widths)):
                    found = np.zeros(len(ids), np.int64)
                    filtered(tree, points, books[part], found)
                    codes[order, part] = found
                    error[order] += ((points - books[part][found]) ** 2).sum(1)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(books)), pa.array(codes.ravel()))
                yield pa.record_batch([ids, labels, listed, pa.array(error)], names=["vec_id", "label", "codes", "error"])

    return trees.mapInArrow(coded, schema), books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors of rows of equal labels added up (nulls together); null beyond 64 bits.

    The sums are formed before they are shuffled, and joined without a shuffle of hot labels.
    """
    coded = persist(coded.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))}), "codes")
    sums = coded.groupBy(F.col("_none").alias("_n"), F.col("_label").alias("_l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("_rows"))
    return join_hot(coded, sums, {"_none": "_n", "_label": "_l"}, "_rows").drop("_none", "_label", "_n", "_l", "_rows")


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
