"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed byte trigrams (log counts, weighted by rarity) and soft bins of a few ratios
(repeated words, capitals, symbols and so on) as further terms. A truncated SVD of labelled rows
gives the latent space. The labelled vectors are broadcast; every document's cosine with every one
of them is computed exactly, in blocks, and its nearest ones vote, weighted by similarity.

The classifier is fitted on at most ``per_label`` labelled ids of each label, picked by a hash of
the id; that bounds what is broadcast, whatever the number of documents. Of the texts of a repeated id
the one with the least digest is learned from. Only the text is scored.

Defined cases: a null text counts as empty and is scored like any other; a text as unlike all
labelled ones, or a table without labels, scores the share of label 1 (0.5 without labels); null
labels are not learned from; of contradictory labels of an id the smaller one counts; repeated rows
return repeated; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from quern.llm.common import bucket_of, slices, texts, word_pieces

TERM_BITS = 11
TERMS = 1 << TERM_BITS
BINS = 6
STYLE_WEIGHT = 1.5
FIT_SCHEMA = "label int, terms array<float>"
#: Rows of a block of cosine products, and bytes of a block of texts.
BLOCK_ROWS, BLOCK_BYTES = 256, 2 << 20
#: Bytes of a long text that are counted at once.
PIECE_BYTES = 1 << 20

_ALNUM = bytes(c for c in range(128) if chr(c).isalnum())
_CAPITALS = bytes(range(0x41, 0x5B))
_SPACE = b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))
_PLAIN, _NOT_DIGITS = _ALNUM + _SPACE + _HIGH + b".,", bytes(set(range(256)) - set(b"0123456789"))
_NEWLINE = re.compile(rb"\n")


def distinct(parts: list[np.ndarray]) -> int:
    return len(np.unique(np.concatenate(parts))) if parts else 0


def hashes(items: list[bytes]) -> np.ndarray:
    """64-bit hashes of the distinct items: what is held of a long text's words and lines."""
    return np.fromiter(map(hash, set(items)), np.int64)


def style(text: bytes, piece: int = PIECE_BYTES) -> list[float]:
    """Ratios from 0 to 1 that describe how a text is written rather than what it says; sums over its pieces."""
    n, m, k, repeats, marks, last, vocabulary, rows = max(1, len(text)), 0, 0, 0, 0, None, [], []
    without, capitals, symbols, digits = 0, 0, 0, 0
    for part in word_pieces(text, piece):
        words = part.split()
        k += len(words)
        repeats += sum(a == b for a, b in zip([last, *words], words, strict=False))
        marks += sum(not (w[-1:].isalnum() or w[-1] in b".,;:?" or w[-1] >= 128) for w in words)
        last = words[-1] if words else last
        vocabulary.append(hashes(words))
        capitals += len(part) - len(part.translate(None, _CAPITALS))
        symbols += len(part.translate(None, _PLAIN))
        digits += len(part.translate(None, _NOT_DIGITS))
        without += len(part.translate(None, _SPACE))
    for part in word_pieces(text, piece, _NEWLINE):
        lines = [x for x in part.split(b"\n") if x.strip()]
        m += len(lines)
        rows.append(hashes(lines))
    k = max(1, k)
    return [
        repeats / k,
        distinct(vocabulary) / k,
        capitals / n,
        min(1.0, 4 * (symbols / n)),
        marks / k,
        min(1.0, 8 * digits / n),
        min(1.0, without / k / 16),
        1 - distinct(rows) / max(1, m),
        min(1.0, (text.count(b".") + text.count(b"?")) / k * 4),
        min(1.0, np.log10(1 + k) / 4),
        min(1.0, m / k * 4),
    ]


def _codes(data: np.ndarray) -> np.ndarray:
    """The terms of the trigrams of bytes, one for each but the last two."""
    data = data.astype(np.uint32)
    return (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - TERM_BITS)


def trigrams(block: list[bytes], piece: int = PIECE_BYTES) -> np.ndarray:
    """Counts of the hashed trigrams that begin in each text, closed by two line ends; a long text alone in its block goes in pieces."""
    n = len(block)
    if n == 1:
        data, counts = np.frombuffer(block[0] + b"\n\n", np.uint8), np.zeros(TERMS, np.int64)
        for at in range(0, len(data) - 2, piece):
            counts += np.bincount(_codes(data[at : at + piece + 2]), minlength=TERMS)
        return counts[None]
    data = np.frombuffer(b"".join(t + b"\n\n" for t in block), np.uint8)
    sizes = np.array([len(t) for t in block], np.int64)
    row = np.repeat(np.arange(n, dtype=np.int64), sizes + 2)
    own = np.ones(len(data), bool)  # a trigram that begins after a text's end would reach into the next text
    own[np.cumsum(sizes + 2) - 1] = own[np.cumsum(sizes + 2) - 2] = False
    return np.bincount((row[:-2] * TERMS + _codes(data))[own[:-2]], minlength=n * TERMS).reshape(n, TERMS)


def features(block: list[bytes]) -> np.ndarray:
    """Log counts of the hashed trigrams, then the style bins; one row per text."""
    n = len(block)
    counts = trigrams(block)
    ratios = np.array([style(t) for t in block], np.float32)
    bins = np.clip(1 - np.abs(ratios[:, :, None] * (BINS - 1) - np.arange(BINS)), 0, 1).reshape(n, -1)
    return np.concatenate([np.log1p(counts).astype(np.float32), bins.astype(np.float32)], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """Term weights, the projection to the latent space, and the labelled vectors."""

    rarity: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    prior: float

    @classmethod
    def fit(cls, terms: np.ndarray, labels: np.ndarray, dimensions: int, neighbours: int) -> Model:
        n = max(1, len(terms))
        rarity = np.log((1 + n) / (1 + (terms[:, :TERMS] > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        model = cls(rarity, np.zeros((terms.shape[1], 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float32), neighbours, float(labels.mean()) if len(labels) else 0.5)
        if len(terms):
            x, rng = model.weighted(terms), np.random.default_rng(0)
            q = x @ rng.standard_normal((x.shape[1], min(dimensions + 16, n)), np.float32)
            for _ in range(3):  # a randomised SVD: power iterations, then a small exact one
                q, _ = np.linalg.qr(x @ (x.T @ q))
            _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
            model.projection = np.ascontiguousarray(v[:dimensions].T)
            model.vectors = _unit(x @ model.projection)
        return model

    def weighted(self, terms: np.ndarray) -> np.ndarray:
        return np.concatenate([_unit(terms[:, :TERMS] * self.rarity), STYLE_WEIGHT * _unit(terms[:, TERMS:])], axis=1)

    def score(self, block: list[bytes]) -> np.ndarray:
        """Exact cosines with all labelled vectors; the nearest ones' labels, weighted by similarity."""
        if not len(self.vectors):
            return np.full(len(block), self.prior)
        cosines = _unit(self.weighted(features(block)) @ self.projection) @ self.vectors.T
        k = min(self.neighbours, len(self.vectors))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** 8
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.clip(np.where(total > 1e-12, votes / np.maximum(total, 1e-12), self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, holdout: int = 5, per_label: int = 1500, dimensions: int = 64, neighbours: int = 15) -> Model:
    """Learn from labelled rows whose crc32(id) mod ``holdout`` is not 0, ``per_label`` of each label at most."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    learned = known.where(bucket_of(F.col("doc_id"), holdout) != 0)
    # the least hashes of a label: about 1.5 * per_label rows lie below its bound, and only they are ranked
    hashed = learned.withColumn("hash", F.md5(F.col("doc_id").cast("string")))
    share = {r["label"]: (1.5 * per_label + 64) / r["count"] for r in learned.groupBy("label").count().collect()}  # two rows
    place = F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / (1 << 32)
    least = hashed.where(F.when(F.col("label") == 1, place < share.get(1, 1.0)).otherwise(place < share.get(0, 1.0)))
    rank = F.row_number().over(W.partitionBy("label").orderBy("hash", "doc_id"))
    sample = least.withColumn("rank", rank).where(F.col("rank") <= per_label).select(F.col("doc_id").alias("id"), "label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id"))  # 2 * per_label ids
    # one row of each sampled id, so what is fetched is bounded too
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text")).select("label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            terms = features(texts(batch.column("text")))
            yield pa.record_batch([batch.column("label"), pa.array(list(terms), pa.list_(pa.float32()))], names=["label", "terms"])

    got = rows.mapInArrow(extract, FIT_SCHEMA).toArrow()
    terms = np.array(got.column("terms").combine_chunks().flatten().to_numpy(), np.float32).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, TERMS + BINS * len(style(b""))), np.float32)
    y = got.column("label").to_numpy().astype(np.int64) if got.num_rows else np.zeros(0, np.int64)
    order = np.lexsort((terms.sum(axis=1), y))  # for reruns that agree
    return Model.fit(terms[order], y[order], dimensions, neighbours)


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BLOCK_BYTES):
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def quality_scores(docs: DataFrame, labels: DataFrame, holdout: int = 5, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, holdout, **options))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            s = shared.value.score(texts(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket_of(F.col("doc_id"), holdout) == 0).alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame, holdout: int = 5, threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` without the rows that score below the threshold; rows never leave their task."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, holdout, **options))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(shared.value.score(texts(batch.column("text"))) >= threshold))

    return docs.mapInArrow(good, docs.schema)
