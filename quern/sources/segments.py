"""A sparse index that grows by segments: batches of new, changed and deleted texts, without rewriting what is there.

A segment is written once: the postings of its texts, the ids that it takes out of earlier segments (changed or deleted
texts), and by how much it changes each term's number of texts, the number of texts and their length. The sums of these
changes over all segments are the statistics of what is alive, so a search weighs terms exactly as an index of the final
table would. A search reads the postings of its terms from all segments and leaves out those that a later segment took out.

The list of segments is a versioned table of the collection: a lost job leaves the last list, and a reader keeps the one it began with.
``compact`` merges neighbouring segments into one, which drops the dead postings and what cancels out; ``vacuum`` deletes folders
that no list names any more. One writer at a time.

A batch costs in proportion to itself and to the postings that it takes out, which are found by id among the earlier segments.

Defined cases: a batch names an id once (of repeated ones any stays); a null id is left out; a null text is an empty one; deleting an id
that isn't there changes nothing; an index without texts has no hits.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from quern.functions.text import tokenize
from quern.operators.retrieval import Bm25Index, term_weights
from quern.sources.store import Store

TABLES = {
    "postings": "seq long, term string, id {id}, tf long, dl int",
    "texts": "seq long, id {id}, dl int",
    "dead": "seq long, id {id}",
    "terms": "term string, df long",
    "stats": "n long, length long",
}


class SegmentedIndex:
    """The segments in ``store``'s folder; ``id_type`` is the type of the texts' ids."""

    def __init__(self, store: Store, name: str = "segments", id_type: str = "long"):
        self.store, self.spark, self.name, self.id_type = store, store.spark, name, id_type

    # --- what is there ---

    def segments(self) -> list[tuple[int, int, str]]:
        """(first, last, folder) of each segment in order: the batches that it holds."""
        if not self.store.versions(f"{self.name}-list"):
            return []
        return sorted(map(tuple, self.store.read(f"{self.name}-list").collect()))

    def _read(self, table: str, segments: list[tuple[int, int, str]]) -> DataFrame:
        schema = TABLES[table].format(id=self.id_type)
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.store.folder}/{self.name}/{folder}/{table}" for *_, folder in segments))

    def _alive(self, table: str, segments: list[tuple[int, int, str]]) -> DataFrame:
        """Rows of texts that no later segment takes out."""
        dead = self._read("dead", segments).groupBy(F.col("id").alias("_id")).agg(F.max("seq").alias("_until"))
        rows = self._read(table, segments)
        return rows.join(dead, (F.col("id") == F.col("_id")) & (F.col("seq") < F.col("_until")), "left_anti")

    # --- batches ---

    def add(self, texts: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Write a batch: texts (id, text), new or in place of older ones, and ids to delete (id)."""
        old = self.segments()
        seq = old[-1][1] + 1 if old else 1
        empty = self.spark.createDataFrame([], f"id {self.id_type}, text string")
        texts = empty if texts is None else texts.select("id", "text").where("id is not null").dropDuplicates(["id"])
        gone = texts.select("id") if deleted is None else texts.select("id").unionByName(deleted.select("id").where("id is not null")).distinct()
        folder = f"{self.store.folder}/{self.name}/{(name := uuid.uuid4().hex)}"
        tokens = texts.select("id", tokenize(F.coalesce("text", F.lit(""))).alias("tokens")).withColumn("dl", F.size("tokens")).persist(StorageLevel.MEMORY_AND_DISK)
        # texts are tokenized once; each table is written once and the next ones are made from it
        tokens.select(F.lit(seq).cast("long").alias("seq"), "id", "dl").write.parquet(f"{folder}/texts")
        counted = tokens.select("id", "dl", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
        self._write_postings(counted.select(F.lit(seq).cast("long").alias("seq"), "term", "id", "tf", "dl"), folder)
        tokens.unpersist()
        taken = self._alive("texts", old).join(gone, "id", "left_semi")
        taken.select(F.lit(seq).cast("long").alias("seq"), "id").write.parquet(f"{folder}/dead")
        new, out = (seq, seq, name), self.spark.read.schema(TABLES["dead"].format(id=self.id_type)).parquet(f"{folder}/dead")
        lost = self._alive("postings", old).join(out.select("id"), "id", "left_semi")
        sign = lambda df, n: df.groupBy("term").agg((n * F.count("*")).alias("df"))
        self._write_terms(sign(self._read("postings", [new]), 1).unionByName(sign(lost, -1)), folder)
        stats = self._read("texts", [new]).select(F.lit(1).alias("n"), "dl").unionByName(self._alive("texts", old).join(out.select("id"), "id", "left_semi").select(F.lit(-1).alias("n"), (-F.col("dl")).alias("dl")))
        self._write_stats(stats, folder)
        self._list([*old, new])

    def _write_postings(self, rows: DataFrame, folder: str) -> None:
        """Where their texts lie, so a common term spans all files and no posting is shuffled; each in the order of the terms, so a search reads few row groups of it."""
        rows.sortWithinPartitions("term", "id").write.parquet(f"{folder}/postings")

    def _write_terms(self, changes: DataFrame, folder: str) -> None:
        changes.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").write.parquet(f"{folder}/terms")

    def _write_stats(self, changes: DataFrame, folder: str) -> None:
        changes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("length")).write.parquet(f"{folder}/stats")

    def _list(self, segments: list[tuple[int, int, str]]) -> None:
        self.store.write(f"{self.name}-list", self.spark.createDataFrame(segments, "first long, last long, folder string").coalesce(1))

    # --- search ---

    def index(self) -> Bm25Index:
        """What is alive, for ``bm25_search`` and all that is built on it."""
        segments = self.segments()
        stats = self._read("stats", segments).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("length").alias("length")).select("n", F.when(F.col("n") > 0, F.col("length") / F.col("n")).alias("avgdl"))
        counts = self._read("terms", segments).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return Bm25Index(self._alive("postings", segments).drop("seq"), term_weights(counts, stats), stats)

    # --- maintenance ---

    def compact(self, first: int = 0, count: int | None = None) -> None:
        """Merge ``count`` neighbouring segments from the ``first`` on (all, without numbers) into one."""
        old = self.segments()
        some = old[first : None if count is None else first + count]
        if len(some) < 2:
            return
        name = uuid.uuid4().hex
        folder = f"{self.store.folder}/{self.name}/{name}"
        self._write_postings(self._alive("postings", some), folder)
        self._alive("texts", some).write.parquet(f"{folder}/texts")
        # what it takes out of still earlier segments; nothing precedes the first
        dead = self._read("dead", some).groupBy("id").agg(F.max("seq").alias("seq")).select("seq", "id")
        dead = dead.join(self._read("texts", old[:first]).select("id"), "id", "left_semi").select("seq", "id") if first else dead.limit(0)
        dead.write.parquet(f"{folder}/dead")
        self._write_terms(self._read("terms", some), folder)
        self._write_stats(self._read("stats", some).select("n", F.col("length").alias("dl")), folder)
        self._list([*old[:first], (some[0][0], some[-1][1], name), *old[first + len(some) :]])

    def sizes(self) -> list[int]:
        """The texts of each segment, dead ones included."""
        counted = {(r["first"], r["last"]): r["n"] for r in self._sizes().collect()}  # a row a segment
        return [counted.get(s[:2], 0) for s in self.segments()]

    def _sizes(self) -> DataFrame:
        listed = self.spark.createDataFrame(self.segments(), "first long, last long, folder string")
        texts = self._read("texts", self.segments()).groupBy("seq").count()
        return texts.join(F.broadcast(listed), F.col("seq").between(F.col("first"), F.col("last"))).groupBy("first", "last").agg(F.sum("count").alias("n"))

    def tidy(self, ratio: int = 4) -> bool:
        """Merge the last segments while an earlier one is less than ``ratio`` times as large as all after it; whether any were merged.

        So sizes fall by that ratio, there are as many segments as the logarithm of the index, and a text is rewritten as often.
        """
        sizes = self.sizes()
        start, tail = len(sizes) - 1, sum(sizes[-1:])
        while start > 0 and sizes[start - 1] < ratio * tail:
            start -= 1
            tail += sizes[start]
        if start < 0 or start >= len(sizes) - 1:
            return False
        self.compact(start, len(sizes) - start)
        return True

    def vacuum(self) -> int:
        """Delete segments that neither the list nor the one before it names; how many."""
        versions = self.store.versions(f"{self.name}-list")
        named = {r["folder"] for v in versions for r in self.spark.read.parquet(f"{self.store.folder}/{self.name}-list/v{v}").select("folder").collect()}
        fs, path = self.store._fs(), self.store._path(self.name)
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        unused = [p for p in found if p.getName() not in named]
        for p in unused:
            fs.delete(p, True)
        return len(unused)
