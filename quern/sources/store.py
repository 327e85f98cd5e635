"""Tables of a collection in one folder: chunks, vectors, the sparse index and cached answers.

A table's versions are folders, and the newest one whose job has ended (``_SUCCESS``) counts, so a
reader never meets half a table, a lost job leaves the last version, and an update may read the
table that it replaces. The folder may be on any file system that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators import retrieval as R


class Store:
    """A collection's tables in ``folder``; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """The finished versions of a table, oldest first."""
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return []
        found = (s.getPath() for s in fs.listStatus(path))
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and fs.exists(self._path(name, p.getName(), "_SUCCESS")))

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace a table, which ``rows`` may read. The version before stays until the next write."""
        old = self.versions(name)
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/v{old[-1] + 1 if old else 1}")
        for v in old[:-1]:
            self._fs().delete(self._path(name, f"v{v}"), True)

    def read(self, name: str) -> DataFrame:
        found = self.versions(name)
        if not found:
            raise FileNotFoundError(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}/v{found[-1]}")

    def upsert(self, name: str, rows: DataFrame, key: str = "id", version: str = "version") -> None:
        """Add rows; of equal keys the row of the largest version stays."""
        self.write(name, R.upsert(self.read(name), rows, key, version) if self.versions(name) else R.upsert(rows.limit(0), rows, key, version))

    def count(self, name: str) -> int:
        """The number of rows; 0 of a table that isn't there."""
        return self.read(name).count() if self.versions(name) else 0

    def is_populated(self, name: str) -> bool:
        return bool(self.versions(name)) and not self.read(name).isEmpty()

    def reset(self, *names: str) -> None:
        """Delete tables, or the collection where none are named."""
        for path in [self._path(n) for n in names] or [self._path()]:
            self._fs().delete(path, True)

    def write_index(self, index: R.Bm25Index) -> None:
        """Postings lie in the order of their terms, so that a search reads few row groups; a common term spans several files."""
        self.write("bm25-postings", index.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id"))
        for part in ("terms", "stats"):
            self.write(f"bm25-{part}", getattr(index, part))

    def read_index(self) -> R.Bm25Index:
        return R.Bm25Index(*(self.read(f"bm25-{part}") for part in ("postings", "terms", "stats")))


def build(store: Store, lines: DataFrame, literal: DataFrame | None = None, rebuild: bool = False) -> bool:
    """Fill a collection from lines (doc, line_no, kind, body) unless it is filled; whether it was built.

    ``literal`` rows (id, text and other columns of chunks) complete the chunks where ids are missing.
    Chunks, their vectors and the sparse index are written one after the other, each from the one before.
    """
    from quern.operators import corpus

    if store.is_populated("chunks") and not rebuild:
        return False
    chunks = corpus.enrich(corpus.build_chunks(lines))
    store.write("chunks", R.complete(chunks, literal) if literal is not None else chunks)
    kept = store.read("chunks")
    store.write("vectors", corpus.encode(kept.select("id", "text", "section")).drop("text"))
    store.write_index(R.bm25_index(kept))
    return True


def searcher(store: Store, k: int = 8, rerank: bool = True):
    """A search over a built collection: (query_id, text) to hits (query_id, id, rank, text, source, section)."""
    from quern.operators import corpus

    def search(queries: DataFrame) -> DataFrame:
        chunks, asked = store.read("chunks"), corpus.encode(queries.select("query_id", "text"))
        if rerank:
            hits = R.hybrid_rerank_search(store.read_index(), store.read("vectors"), asked, chunks, k)
        else:
            hits = R.hybrid_search(store.read_index(), store.read("vectors"), asked, k)
        return hits.select("query_id", "id", "rank").join(chunks.select("id", "text", "source", "section"), "id")

    return search
