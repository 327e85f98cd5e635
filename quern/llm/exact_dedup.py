"""Exact dedup by a log-structured merge index of digests.

Each task keeps a memtable (digest -> ids) and flushes it as a run sorted by digest, with a filter,
whenever it holds ``memtable_rows`` ids; so memory is bounded and a hot text leaves one entry per run
instead of one row per copy. A run's filter is the sorted 64-bit words of its digests. The filters are cut
into ranges of some ``RANGE_BYTES`` over all runs, so a task reads its range of every filter, however many
runs there are, and names the words that two runs hold. A bounded Bloom filter of these words tells the
entries to merge; the others are final at once. Compaction brings a digest's entries of all runs together
in a shuffle, whose sort merges the runs, and folds them into the identifier that stays (the smallest by
default, the largest on request) and the number of copies. The decisions go back by run and digest, so no
group of copies meets in one task.
Digests that occur more than once are hits; a bounded Bloom filter of them picks the documents whose
bytes are compared, and digests that turn out to hold several texts are regrouped by the text itself.

Defined cases: a null text counts as empty; a null id never stays unless all ids of its group are
null; of repeated rows with the same id and text exactly one is kept; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import HOT_ROWS, bloom, bloom_admits, discard, free_names, in_bloom, persist, slices, texts

#: An entry of a run, or (digest null) the run's filter. slot: the place of best among ids.
RUN = "run long, digest binary, sha binary, ids array<long>, best long, slot int, n long, filter binary"
MERGED = "run long, digest binary, keep_id long, here boolean, group_size long"
#: Bytes of all runs' filters in one range, which one task reads.
RANGE_BYTES = 16 << 20


def _hashes(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of digests, spread over all bits for digests that are shorter."""
    x = np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests), np.uint64)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def run_filter(digests: list[bytes]) -> np.ndarray:
    """The filter of a run: the words of its digests, sorted as unsigned numbers, each once."""
    return np.unique(_hashes(digests).view(np.uint64))


def flush_runs(docs: DataFrame, keep: str, digest_bytes: int, memtable_rows: int) -> DataFrame:
    """Sorted digest runs of ``docs``, one entry per digest and run, and a filter per run."""
    pick = max if keep == "largest" else min

    def run_rows(run: int, table: dict[bytes, tuple[bytes, list]]) -> pa.RecordBatch:
        digests = sorted(table)
        ids = [table[d][1] for d in digests]
        best = [pick((i for i in x if i is not None), default=None) for x in ids]
        slot = [x.index(b) for x, b in zip(ids, best, strict=True)]
        data = [[run] * (len(digests) + 1), [*digests, None], [*(table[d][0] for d in digests), None], [*ids, None], [*best, None], [*slot, None], [*map(len, ids), None], [*[None] * len(digests), run_filter(digests).tobytes()]]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(x, t) for x, t in zip(data, kinds, strict=True)], names=[x.split()[0] for x in RUN.split(", ")])

    def memtable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, tuple[bytes, list]] = {}
        held, run = 0, TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                sha = hashlib.sha256(t).digest()
                # a shortened digest holds several sha in one entry list; the sha is its first text's
                table.setdefault(sha[:digest_bytes], (sha, []))[1].append(i)
                held += 1
                if held >= memtable_rows:
                    yield run_rows(run, table)
                    table, held, run = {}, 0, run + 1
        if table:
            yield run_rows(run, table)

    return docs.select("doc_id", "text").mapInArrow(memtable, RUN)


def shared_words(filters: DataFrame, ranges: int) -> DataFrame:
    """The words that the filters of two runs or more hold, found range by range."""
    inner = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("filter"):
                words = np.frombuffer(data.as_buffer(), np.uint64)
                parts = [x.tobytes() for x in np.split(words, np.searchsorted(words, inner))]
                yield pa.record_batch([pa.array(range(ranges), pa.int32()), pa.array(parts, pa.binary())], names=["range", "words"])

    def shared(cells: pa.Table) -> pa.Table:
        words = np.sort(np.frombuffer(b"".join(cells.column("words").to_pylist()), np.uint64))
        twice = np.unique(words[1:][words[1:] == words[:-1]])
        return pa.table({"word": pa.array(twice.view(np.int64))})

    cells = filters.select("filter").mapInArrow(cut, "range int, words binary").where("octet_length(words) > 0")
    return cells.groupBy("range").applyInArrow(shared, "word long")


def shared_entries(runs: DataFrame) -> DataFrame:
    """The entries of ``runs``, with maybe: whether another run may hold the digest too."""
    spark = runs.sparkSession
    filters = runs.where("filter is not null")
    size = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    words = persist(shared_words(filters, 1 + size // RANGE_BYTES), "words")
    held = spark.sparkContext.broadcast(bloom(words, "word"))
    discard(words)
    kept = [x.split()[0] for x in RUN.split(", ")[:-1]]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = bloom_admits(held.value, _hashes(batch.column("digest").to_pylist()))
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(maybe)], names=[*kept, "maybe"])

    return runs.where("filter is null").select(*kept).mapInArrow(probed, RUN.removesuffix(", filter binary") + ", maybe boolean")


def compact(entries: DataFrame, keep: str) -> DataFrame:
    """Decisions by run and digest: the id that stays, whether this run holds it, the copies over all runs."""
    sign = 1 if keep == "largest" else -1

    def fold(digest: bytes, group: list[tuple]) -> tuple:
        """The decisions of a digest, from the (run, best, n) of its entries."""
        known = [(sign * b, r) for r, b, _ in group if b is not None]
        best, run = max(known) if known else (None, max(r for r, _, _ in group))
        total = sum(n for _, _, n in group)
        return [digest] * len(group), [r for r, _, _ in group], [None if best is None else sign * best] * len(group), [r == run for r, _, _ in group], [total] * len(group)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group, out = None, [], [[] for _ in range(5)]

        def flush() -> pa.RecordBatch:
            digest, run, keep_id, here, size = out
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64())
            made = pa.record_batch([pa.array(x, t) for x, t in zip((run, digest, keep_id, here, size), kinds, strict=True)], names=[x.split()[0] for x in MERGED.split(", ")])
            for x in out:
                x.clear()
            return made

        for batch in batches:
            for digest, *entry in zip(*(batch.column(c).to_pylist() for c in ("digest", "run", "best", "n")), strict=True):
                if digest != last and group:
                    for x, y in zip(out, fold(last, group), strict=True):
                        x += y
                    group = []
                last = digest
                group.append(entry)
            if len(out[0]) >= 10_000:
                yield flush()
        if group:
            for x, y in zip(out, fold(last, group), strict=True):
                x += y
        yield flush()

    # all entries of a digest meet in one task; the sort there merges what the runs hold of it
    met = entries.select("digest", "run", "best", "n").repartition(F.substring("digest", 1, 4)).sortWithinPartitions("digest", "run")
    return met.mapInArrow(merged, MERGED)


def local_texts(docs: DataFrame, hits: DataFrame, digest_bytes: int) -> DataFrame:
    """(digest, text) of the hits' documents, each text once per task and batch."""
    probe = in_bloom(docs.sparkSession, bloom(hits.select(F.xxhash64("digest").alias("h")), "h"))
    with_digest = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bytes))
    return with_digest.where(probe(F.xxhash64("digest"))).select("digest", "text").distinct()


def exact_dedup(docs: DataFrame, keep: str = "smallest", digest_bytes: int = 32, memtable_rows: int = 200_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``."""
    runs = persist(flush_runs(docs, keep, digest_bytes, memtable_rows), "runs")
    entries = persist(shared_entries(runs), "entries")
    discard(runs)
    alone = F.col("maybe") == F.lit(False)
    index = persist(compact(entries.where("maybe"), keep), "index")
    hits = index.where("group_size > 1").select("digest").unionByName(entries.where(alone & (F.col("n") > 1)).select("digest"))
    several = persist(local_texts(docs, hits, digest_bytes).groupBy("digest").count().where("count > 1").select("digest"), "several")
    columns = ("digest", "sha", "ids", "slot", "keep_id", "here", "group_size")
    final = entries.where(alone).withColumns({"keep_id": F.col("best"), "here": F.lit(True), "group_size": F.col("n")}).select(*columns)
    decided = index.withColumnsRenamed({"run": "r", "digest": "d"})
    met = entries.where("maybe").join(decided, (F.col("run") == F.col("r")) & (F.col("digest") == F.col("d"))).select(*columns)
    out = final.unionByName(met).select("digest", "sha", "keep_id", "group_size", "here", "slot", F.posexplode("ids").alias("at", "doc_id"))
    out = out.select("digest", "doc_id", "keep_id", "group_size", (F.col("here") & (F.col("at") == F.col("slot"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    if several.isEmpty():
        return out.drop("digest")
    return out.join(several, "digest", "left_anti").drop("digest").unionByName(by_text(docs, several, keep, digest_bytes))


def by_text(docs: DataFrame, digests: DataFrame, keep: str, digest_bytes: int) -> DataFrame:
    """The result for documents whose digest stands for several texts: grouped by the text itself."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bytes)).join(digests, "digest", "left_semi")
    pick = F.max if keep == "largest" else F.min
    groups = rows.groupBy("text").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    same = rows.groupBy("text", "doc_id").agg(F.count("*").alias("copies"))
    each = same.join(groups, "text").select("doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "smallest", memtable_rows: int = 200_000) -> DataFrame:
    """``docs`` with one row of each group of equal texts; only rows that may have copies are shuffled.

    Groups of more than 1 / HOT_ROWS of all copies, so HOT_ROWS at most, are broadcast: their other copies go where they lie.
    """
    found = persist(exact_dedup(docs, keep, 32, memtable_rows).where("group_size > 1").select("keep_id", "text_sha256", "group_size").distinct(), "copies")
    probe = in_bloom(docs.sparkSession, bloom(found.select(F.xxhash64("text_sha256").alias("h")), "h"))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    maybe = probe(F.xxhash64(sha))
    name, keep_id, size = free_names(docs, "sha", "keep", "size")
    named = found.select(F.col("text_sha256").alias(name), F.col("keep_id").alias(keep_id), F.col("group_size").alias(size))
    hot = F.col(size) > (found.agg(F.sum("group_size")).first()[0] or 0) / HOT_ROWS
    rows = docs.where(maybe).withColumn(name, sha)
    stays = F.col("doc_id").eqNullSafe(F.col(keep_id))
    of_hot = rows.join(F.broadcast(named.where(hot)), name).where(stays)
    # a row that only the filter took for a copy has a text of its own, so it stays as it is
    rest = rows.join(F.broadcast(named.where(hot).select(name)), name, "left_anti").join(named.where(~hot), name, "left").where(F.col(size).isNull() | stays)
    kept = of_hot.select(*docs.columns, name).unionByName(rest.select(*docs.columns, name)).dropDuplicates([name, "doc_id"])
    return docs.where(~maybe).unionByName(kept.select(*docs.columns))
