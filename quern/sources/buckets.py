"""A keyed table in hash buckets whose upserts rewrite only the buckets they touch.

A bucket's rows lie in one folder, and a version of the table is a list of folders. An upsert reads the buckets
of its keys, writes their merged rows beside them and then a new list, in which all other buckets keep their folders. So a batch
costs what its buckets hold, readers of an older list go on undisturbed, and a job that is lost before its list is
written changes nothing. ``vacuum`` deletes folders that neither the list nor the one before it names. One writer at a time.

Of rows of one key that of the largest version stays, and of equal versions one of the new rows before an old one. Defined cases: a null key
is a key; a batch without rows makes no version; ``rows`` of a table that isn't there raises.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from quern.sources.store import Store

BUCKET = "_bucket"


class BucketedTable:
    """``buckets`` is fixed when the first rows are written; ``key`` and ``version`` are columns of the table."""

    def __init__(self, store: Store, name: str, key: str = "id", version: str = "version", buckets: int = 64):
        self.store, self.spark, self.name, self.key, self.version, self._new = store, store.spark, name, key, version, buckets

    def _list(self) -> dict[int, str]:
        """The folder of each bucket that has rows, a row a bucket."""
        if not self.store.versions(f"{self.name}-list"):
            return {}
        return {r["bucket"]: r["folder"] for r in self.store.read(f"{self.name}-list").collect()}

    @property
    def buckets(self) -> int:
        """The number of buckets, kept with the list."""
        if not self.store.versions(f"{self.name}-list"):
            return self._new
        return self.store.read(f"{self.name}-list").first()["buckets"]

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _paths(self, folders: dict[int, str]) -> list[str]:
        return [f"{self.store.folder}/{self.name}/{folder}/{BUCKET}={bucket}" for bucket, folder in sorted(folders.items())]

    def rows(self, keys: list | None = None) -> DataFrame:
        """The table; with ``keys``, the buckets that may hold them."""
        listed = self._list()
        if not listed:
            raise FileNotFoundError(f"{self.store.folder}/{self.name}")
        if keys is not None:
            kind = self.spark.read.parquet(*self._paths(listed)[:1]).schema[self.key].dataType
            asked = self.spark.createDataFrame([(k,) for k in keys], f"`{self.key}` {kind.simpleString()}")
            wanted = {r[0] for r in asked.select(self._bucket(self.buckets)).distinct().collect()}  # as many as there are buckets
            some = {b: f for b, f in listed.items() if b in wanted}
            return self.spark.read.parquet(*self._paths(some)) if some else self.spark.read.parquet(*self._paths(listed)).limit(0)
        return self.spark.read.parquet(*self._paths(listed))

    def upsert(self, rows: DataFrame) -> list[int]:
        """Add rows, or replace those of their keys; the buckets that were rewritten."""
        listed, n = self._list(), self.buckets
        new = rows.withColumn(BUCKET, self._bucket(n))
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # as many as there are buckets
        if not touched:
            return []
        both = new.withColumn("_old", F.lit(0))
        old = {b: listed[b] for b in touched if b in listed}
        if old:
            both = both.unionByName(self.spark.read.parquet(*self._paths(old)).withColumn(BUCKET, self._bucket(n)).withColumn("_old", F.lit(1)), allowMissingColumns=True)
        # rows of a key meet map-side first, so a key that comes many times in a batch isn't gathered
        values = [c for c in both.columns if c not in ("_old", BUCKET, self.key)]
        latest = both.groupBy(BUCKET, self.key).agg(F.max_by(F.struct(*values), F.struct(self.version, -F.col("_old"))).alias("_row"))
        folder = uuid.uuid4().hex
        latest.select(self.key, *(F.col(f"_row.{c}").alias(c) for c in values), BUCKET).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.store.folder}/{self.name}/{folder}")
        now = listed | dict.fromkeys(touched, folder)
        self.store.write(f"{self.name}-list", self.spark.createDataFrame([(b, f, n) for b, f in now.items()], "bucket int, folder string, buckets int").coalesce(1))
        return touched

    def vacuum(self) -> int:
        """Delete folders of buckets that neither the list nor the one before it names; how many."""
        lists = [f"{self.store.folder}/{self.name}-list/v{v}" for v in self.store.versions(f"{self.name}-list")]
        named = {(r["folder"], r["bucket"]) for path in lists for r in self.spark.read.parquet(path).collect()}
        fs, base = self.store._fs(), self.store._path(self.name)
        gone = 0
        for folder in fs.listStatus(base) if fs.exists(base) else ():
            parts = [s.getPath() for s in fs.listStatus(folder.getPath()) if s.getPath().getName().startswith(BUCKET)]
            unused = [p for p in parts if (folder.getPath().getName(), int(p.getName().split("=")[1])) not in named]
            for path in [folder.getPath()] if parts and len(unused) == len(parts) else unused:
                fs.delete(path, True)
            gone += len(unused)
        return gone
