"""Benchmark decontamination by suffix arrays over shards of the training documents.

A shard is a bounded run of documents of one task. Its words become ids of the benchmark's
vocabulary; a suffix whose first words leave that vocabulary can't match and isn't sorted. Every
suffix of every benchmark item is binary-searched in each shard's suffix array, word by word, equal ones
once; that gives the verbatim matches and their places, of which ``longest_matches`` returns the maximal ones;
the documents' words inside matched windows are marked. No row leaves its task but a document's own result, so nothing is shuffled.

The benchmark is the stated query set. It is broadcast in blocks of ``block_bytes`` at most; a
larger benchmark takes more passes over the documents, whose marks are written after ``PASSES`` of them,
so a stage holds that many blocks. Words become ids piece by piece, so a long text costs some 40 bytes a word.

Defined cases: null, empty or wordless texts have no words and are clean; a null item matches
nothing; repeated items count once per row, a null item_id as the empty text; documents of any
length are whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import discard, free_names, persist, slices, texts, to_bytes, word_pieces

#: Lower-cases A-Z, keeps 0-9, a-z and every byte from 0x80 up, turns the rest into spaces.
TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: What stands between words.
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Passes over the documents, a block of the benchmark each, between two writes of the marks.
PASSES = 8
MATCH = "doc_id long, item_id string, doc_start long, item_start long, length long"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


@dataclass
class Queries:
    """The distinct windows of a block of benchmark items: the first words of their suffixes, as arrays.

    Window j begins at starts[j] in tokens; it stands in the items item[first[j] : first[j + 1]] at those offsets.
    """

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    tokens: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    starts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    widths: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    item: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    offset: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], window: int) -> Queries:
        q, flat, sizes = cls(window), [], []
        for name, text in items:
            ids = [q.vocabulary.setdefault(w, len(q.vocabulary) + 1) for w in words_of(text)]
            flat += ids
            sizes.append(len(ids))
            q.names.append(name)
        if not flat:
            return q
        q.tokens, n = np.array(flat, np.int32), np.array(sizes, np.int64)
        width, begin = np.minimum(n, window), np.cumsum(n) - n
        windows = np.where(n > 0, n - width + 1, 0)
        item = np.repeat(np.arange(len(n)), windows)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts, widths = begin[item] + offset, width[item]
        k = np.arange(window)
        words = np.where(k < widths[:, None], q.tokens[np.minimum(starts[:, None] + k, len(flat) - 1)], -1)
        _, one, same = np.unique(words, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(same.ravel(), kind="stable")
        q.starts, q.widths, q.item, q.offset = starts[one], widths[one], item[order], offset[order]
        q.first = np.concatenate([[0], np.cumsum(np.bincount(same.ravel()))])
        return q

    def places(self, window: int) -> list[tuple[int, int]]:
        """The items that hold a window, and where."""
        own = slice(self.first[window], self.first[window + 1])
        return list(zip(self.item[own].tolist(), self.offset[own].tolist(), strict=True))


class Shard:
    """A suffix array of the words of some documents, up to ``depth`` words a suffix."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, queries: Queries):
        self.ids, self.ends, n = ids, ends, len(ids)
        low, self.depth = (int(queries.widths.min()), int(queries.widths.max())) if len(queries.widths) else (1, 0)
        known = np.concatenate([[0], np.cumsum(ids == 0, dtype=np.int32)])
        at = np.flatnonzero(known[low:] == known[: n - low + 1]) if n >= low else np.empty(0, np.int64)
        room = ends[np.searchsorted(ends, at, side="right")] if len(at) else at
        inside = at + low <= room
        at, self.room = at[inside], room[inside] - at[inside]
        keys = [self.word(at, self.room, k) for k in range(self.depth)]
        order = np.lexsort(keys[::-1]) if keys and len(at) else np.arange(len(at))
        self.suffixes, self.room = at[order], self.room[order]

    def word(self, at: np.ndarray, room: np.ndarray, k: int) -> np.ndarray:
        """The k-th word of suffixes; past their document's end -1, which sorts first."""
        return np.where(k < room, self.ids[np.minimum(at + k, len(self.ids) - 1)], -1)

    def search(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each query's window, by binary search per word."""
        lo, hi = np.zeros(len(queries.starts), np.int64), np.full(len(queries.starts), len(self.suffixes), np.int64)
        for k in range(self.depth):
            todo = np.flatnonzero((k < queries.widths) & (lo < hi))
            if not len(todo):
                break
            want = queries.tokens[queries.starts[todo] + k]
            for side in ("left", "right"):
                a, b = lo[todo].copy(), hi[todo].copy()
                while (open_ := a < b).any():
                    mid = (a + b) // 2
                    at = np.minimum(mid, len(self.suffixes) - 1)
                    got = self.word(self.suffixes[at], self.room[at], k)
                    up = open_ & (got < want if side == "left" else got <= want)
                    a, b = np.where(up, mid + 1, a), np.where(open_ & ~up, mid, b)
                if side == "left":
                    left = a
                else:
                    lo[todo], hi[todo] = left, a
        return lo, hi


def shard_matches(shard: list[bytes], queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the documents (in words), and arrays of matches: query, place, document."""
    get, parts, ends, n = queries.vocabulary.get, [np.empty(0, np.int32)], [], 0
    for text in shard:
        for piece in word_pieces(text, between=BETWEEN):
            parts.append(np.array([get(w, 0) for w in words_of(piece)], np.int32))
            n += len(parts[-1])
        ends.append(n)
    ids, ends_of = np.concatenate(parts), np.array(ends, np.int64)
    if not len(ids) or not len(queries.starts):
        return ends_of, *(np.empty(0, np.int64),) * 3
    array = Shard(ids, ends_of, queries)
    lo, hi = array.search(queries)
    query = np.repeat(np.arange(len(lo)), hi - lo)
    place = array.suffixes[np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(len(query))] if len(query) else np.empty(0, np.int64)
    return ends_of, query, place, np.searchsorted(ends_of, place, side="right")


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size, fetched one partition at a time."""
    block, held = [], 0
    for item, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        block.append((item, to_bytes(text)))
        held += len(block[-1][1])
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def several_blocks(benchmark: DataFrame, block_bytes: int) -> bool:
    return len(list(itertools.islice(blocks(benchmark, block_bytes), 2))) > 1


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """Every maximal verbatim match of at least a window: document, item, places and length in words."""
    out = docs.sparkSession.createDataFrame([], MATCH)
    for block in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Queries.of(block, window))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            for batch in slices(batches, "text"):
                ends, query, place, doc = shard_matches(texts(batch.column("text")), q)
                begin, names = np.concatenate([[0], ends[:-1]]), batch.column("doc_id").to_pylist()
                runs: dict[tuple, list] = defaultdict(list)
                for j, p, d in zip(query.tolist(), place.tolist(), doc.tolist(), strict=True):
                    for item, offset in q.places(j):
                        runs[d, item, p - offset].append((p, offset, int(q.widths[j])))
                rows = []
                for (d, item, _), found in runs.items():
                    found.sort()
                    first, last = found[0], found[0]
                    for x in [*found[1:], None]:
                        if x is None or x[0] != last[0] + 1:
                            rows.append((names[d], q.names[item], first[0] - int(begin[d]), first[1], last[0] + last[2] - first[0]))
                            first = x
                        last = x
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "doc_start", "item_start", "length"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(find, MATCH))
    return out


def _marker(shared, carry: list[str]):
    """Batches of documents to batches with n_words, n_hit, hit words and items of one block."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in slices(batches, "text"):
            ends, query, place, doc = shard_matches(texts(batch.column("text")), q)
            total = int(ends[-1])
            edge = np.zeros(total + 1, np.int32)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + q.widths[query], -1)
            hit = np.cumsum(edge[:-1], dtype=np.int32) > 0
            summed = np.concatenate([[0], np.cumsum(hit)])
            begin = np.concatenate([[0], ends[:-1]])
            items: dict[int, set] = defaultdict(set)
            for d, j in np.unique(np.stack([doc, query], 1), axis=0).tolist():
                items[d].update(i for i, _ in q.places(j))
            spans = [[] for _ in range(len(ends))]
            for d in items:
                on = np.flatnonzero(np.diff(np.concatenate([[False], hit[begin[d] : ends[d]], [False]]).astype(np.int8)))
                spans[d] = on.tolist()
            found = [sorted(q.names[i] for i in items[d]) if d in items else [] for d in range(len(ends))]
            extra = {
                "n_words": pa.array(ends - begin, pa.int64()),
                "n_hit": pa.array(summed[ends] - summed[begin], pa.int64()),
                "items": pa.array(found, pa.list_(pa.string())),
                "spans": pa.array(spans, pa.list_(pa.int64())),
            }
            yield pa.record_batch([*(batch.column(c) for c in carry), *extra.values()], names=[*carry, *extra])

    return mark


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    spark = docs.sparkSession
    if several_blocks(benchmark, block_bytes):
        return _merged(docs, benchmark, window, block_bytes)
    shared = spark.sparkContext.broadcast(Queries.of(next(blocks(benchmark, block_bytes), []), window))
    marked = docs.select("doc_id", "text").mapInArrow(_marker(shared, ["doc_id"]), "doc_id long, n_words long, n_hit long, items array<string>, spans array<long>")
    joined = F.array_join(F.array_sort("items"), ",")
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def marks_of(docs: DataFrame) -> list[str]:
    """Columns of the marks that rows carry from one block's pass to the next: items, hit spans, words."""
    return free_names(docs, "items", "spans", "words")


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """``docs`` with its ``marks_of`` where the benchmark takes several blocks: each block's pass adds its marks to a row."""
    spark, marks = docs.sparkSession, marks_of(docs)
    rows = docs.withColumns(dict(zip(marks, (F.array().cast("array<string>"), F.array().cast("array<long>"), F.lit(0).cast("long")), strict=True)))
    written, held = [], []
    for block in blocks(benchmark, block_bytes):
        if len(held) == PASSES:
            rows = persist(rows, "marked")
            discard(*written)
            for used in held:
                used.destroy()
            written, held = [rows], []
        shared = spark.sparkContext.broadcast(Queries.of(block, window))
        held.append(shared)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                for new in _marker(shared, [])([batch]):
                    items, spans = ([a + b for a, b in zip(batch.column(m).to_pylist(), new.column(c).to_pylist(), strict=True)] for m, c in zip(marks, ("items", "spans"), strict=False))
                    kept = [c for c in batch.schema.names if c not in marks]
                    yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64())), new.column("n_words")], names=[*kept, *marks])

        rows = rows.mapInArrow(add, rows.schema)
    return rows


def covered(spans: list[int]) -> int:
    """Words inside any of the spans, given as starts and ends in turn."""
    n = reach = 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        n += max(0, b - max(a, reach))
        reach = max(reach, b)
    return n


def _merged(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """The result of decontaminate where the benchmark takes several blocks."""
    items, spans, words = marks_of(docs.select("doc_id", "text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array([covered(x) for x in batch.column(spans).to_pylist()], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column(words), hit, batch.column(items)], names=["doc_id", "n_words", "n_hit", "items"])

    rows = _marked(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"doc_id {kind}, n_words long, n_hit long, items array<string>")
    joined = F.array_join(F.array_sort("items"), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` less the contaminated rows; rows never leave their task.

    A document is contaminated if ``share`` times its hit words reach its words.
    """
    if several_blocks(benchmark, block_bytes):
        kept, (_, spans, words) = docs.columns, marks_of(docs)

        def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit, n = np.array([covered(x) for x in batch.column(spans).to_pylist()], np.int64), batch.column(words).to_numpy()
                yield batch.select(kept).filter(pa.array((hit == 0) | (share * hit < n)))

        return _marked(docs, benchmark, window, block_bytes).mapInArrow(unmarked, docs.schema)
    items = next(blocks(benchmark, block_bytes), [])
    shared = docs.sparkSession.sparkContext.broadcast(Queries.of(items, window))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for marks in _marker(shared, [])([batch]):
                hit, n = (marks.column(c).to_numpy() for c in ("n_hit", "n_words"))
                yield batch.filter(pa.array((hit == 0) | (share * hit < n)))

    return docs.mapInArrow(clean, docs.schema)
