"""Language ID with bit-sliced Bloom filters of byte n-grams.

A filter slot is a bitmask with a bit per language (as many 64-bit slices as languages need), so
one lookup - the and of an n-gram's slots - gives all languages that contain it. A language's hits
over a text's n-grams are corrected for the filter's false positives, known from how many of its
bits are set, and the largest corrected share decides.

The filters hold every n-gram of the training documents learned from: at most ``per_language`` ids of
each language, picked by a hash of the id; of the texts of a repeated id and language the one with
the least digest. Tasks set the bits of their documents and the bits are or-ed by slot, so what is
fetched and broadcast is the filter: ``FILTER_BYTES`` at most. Only the text is used in a prediction. Long
texts are taken in pieces.

Defined cases: a null text or one without any letter is ``und`` with score 0; a text without known
n-grams gets the first learned language with score 0; ties go to the language first in order; without
any learned language all are ``und``; repeated rows return repeated; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window as W, functions as F

from quern.llm.common import bucket_of, slices, texts

GRAM = 4
#: Odd multipliers, one for each slot of an n-gram.
PROBES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
FILTER_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
LETTER = regex.compile(r"\p{L}")


def pieces_of(block: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(numbers, pieces) of texts: about BLOCK_BYTES at a time, cut so that each n-gram lies in one piece."""
    numbers, held, size = [], [], 0
    for i, t in enumerate(block):
        row = b" " + t.lower() + b" "
        for at in range(0, max(1, len(row) - GRAM + 1), BLOCK_BYTES):
            numbers.append(i)
            held.append(row[at : at + BLOCK_BYTES + GRAM - 1])
            size += len(held[-1])
            if size >= BLOCK_BYTES:
                yield numbers, held
                numbers, held, size = [], [], 0
    if held:
        yield numbers, held


def grams_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The byte n-grams of pieces as integers, white space as blanks, and how many each piece has."""
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
    data[(data >= 9) & (data <= 13)] = 32
    n = max(0, len(data) - GRAM + 1)
    code = data[:n] << np.uint32(24) | data[1 : n + 1] << np.uint32(16) | data[2 : n + 2] << np.uint32(8) | data[3 : n + 3]
    sizes = np.array([len(p) for p in pieces], np.int64)
    across = (np.cumsum(sizes)[:-1, None] - np.arange(1, GRAM)).ravel()  # n-grams across the end of a piece
    inside = np.ones(n, bool)
    inside[across[(across >= 0) & (across < n)]] = False
    return code[inside], np.maximum(sizes - GRAM + 1, 0)


def slots_of(code: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint32(33 - bits.bit_length())
    return [((code ^ (code >> np.uint32(15))) * np.uint32(m)) >> shift for m in PROBES]


@dataclass
class Filters:
    """The bit-sliced filter: ``slots[i, s]`` is slice s of slot i."""

    languages: list[str]
    slots: np.ndarray

    def __post_init__(self):
        filled = [((self.slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        self.rates = np.array(filled) ** len(PROBES)

    def masks(self, code: np.ndarray) -> np.ndarray:
        """Bitmasks of the languages that contain n-grams."""
        first, *rest = slots_of(code, len(self.slots))
        out = self.slots[first]
        for at in rest:
            out &= self.slots[at]
        return out

    def predict(self, block: list[bytes]) -> tuple[list[str], np.ndarray]:
        hits, grams = np.zeros((len(block), len(self.languages))), np.zeros(len(block))
        for numbers, pieces in pieces_of(block):
            code, sizes = grams_of(pieces)
            masks, ends = self.masks(code), np.cumsum(sizes)
            np.add.at(grams, numbers, sizes)
            for i in range(len(self.languages)):
                summed = np.concatenate([[0], np.cumsum((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))])
                np.add.at(hits[:, i], numbers, summed[ends] - summed[ends - sizes])
        true = np.maximum(0, hits - grams[:, None] * self.rates) / (1 - np.minimum(self.rates, 0.999))
        share = np.minimum(1, true / np.maximum(1, grams)[:, None])
        best, score = share.argmax(axis=1), share.max(axis=1)
        return [self.languages[i] for i in best], score


def sample(docs: DataFrame, holdout: int, held: int, per_language: int) -> DataFrame:
    """(lang, text): the documents learned from."""
    known = docs.where(F.col("lang").isNotNull() & (bucket_of(F.col("doc_id"), holdout) != held)).select(F.col("doc_id").alias("id"), F.col("lang").alias("l"))
    hashed = known.withColumn("hash", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    # the least hashes of a language: about 1.5 * per_language ids lie below its bound, and only they are ranked
    bounds = known.groupBy(F.col("l").alias("name")).agg(((1.5 * per_language + 64) / F.greatest(F.lit(1), F.approx_count_distinct("id"))).alias("share"))
    place = F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / (1 << 32)
    least = hashed.join(F.broadcast(bounds), F.col("l") == F.col("name")).where(place < F.col("share")).select("id", "l", "hash").distinct()  # bounds: a row a language
    rank = F.row_number().over(W.partitionBy("l").orderBy("hash", "id"))
    chosen = least.withColumn("rank", rank).where(F.col("rank") <= per_language).select("id", "l")
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("l")))  # per_language ids a language
    return rows.groupBy("id", "lang").agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text")).select("lang", "text")


def learn(docs: DataFrame, holdout: int = 3, held: int = 1, per_language: int = 300) -> Filters:
    """Filters from documents with a language whose crc32(id) mod ``holdout`` is not ``held``."""
    known = docs.where(F.col("lang").isNotNull() & (bucket_of(F.col("doc_id"), holdout) != held))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # a row a language
    number, n_slices = {x: i for i, x in enumerate(languages)}, max(1, (len(languages) + 63) // 64)
    bits = 1 << max(6, (FILTER_BYTES // 8 // n_slices).bit_length() - 1)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK_BYTES):
            of = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for numbers, pieces in pieces_of(texts(batch.column("text"))):
                code, sizes = grams_of(pieces)
                lang = np.repeat(of[numbers], sizes)
                at = np.concatenate([(lang * bits + x.astype(np.int64)) for x in slots_of(code, bits)])
                at = np.unique(at)
                lang, at = at // bits, at % bits
                mask = np.left_shift(np.uint64(1), (lang % 64).astype(np.uint64))
                yield pa.record_batch([pa.array(at * n_slices + lang // 64), pa.array(mask.view(np.int64))], names=["slot", "mask"])

    got = sample(docs, holdout, held, per_language).mapInArrow(marked, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # a row a slot of the filter at most
    slots = np.zeros(bits * n_slices, np.uint64)
    if got.num_rows:
        slots[got.column("slot").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return Filters(languages, slots.reshape(bits, n_slices))


def identify(docs: DataFrame, holdout: int = 3, held: int = 1, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, holdout, held, **options))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in slices(batches, "text", BLOCK_BYTES):
            names, score = (filters.predict(texts(batch.column("text")))) if filters.languages else (["und"] * batch.num_rows, np.zeros(batch.num_rows))
            letters = [bool(t and LETTER.search(t)) for t in batch.column("text").to_pylist()]
            names = [x if ok else "und" for x, ok in zip(names, letters, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket_of(F.col("doc_id"), holdout) == held).alias("held_out"), "text")
    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")
