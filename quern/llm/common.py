"""Helpers that the training-data operators share: shared tables, Bloom filters, connected components.

Every intermediate table is Parquet in the folder that the session names in
``spark.checkpoint.dir``; executors and the driver see the same files, so a lost executor costs
a re-read and nothing else.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text bytes that an operator works on at once in a Python worker.
CHUNK_BYTES = 4 << 20
#: Upper bound on the bits of a Bloom filter (8 MiB); more keys only raise its false positives.
MAX_FILTER_BITS = 1 << 26
FILTER_PROBES = 4


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Where it is unset, a session on this machine alone gets a temporary one; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Lists of the paths that the scopes open in this context have made, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES.get():
        scope.append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


class scratch:  # noqa: N801
    """A scope whose tables in the shared folder are deleted at its end, but for those that ``keep`` names.

    For a caller that has written all it wants by then; tables that others have made stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], set()

    def __enter__(self) -> scratch:
        self.token = _SCOPES.set((*_SCOPES.get(), self.made))
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._quern_path)
        return df

    def __exit__(self, *_) -> None:
        _SCOPES.reset(self.token)
        delete(self.spark, *(p for p in self.made if p not in self.kept))


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it: cuts lineage, survives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete persisted tables that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._quern_path)


#: Rows of a table that ``join_hot`` broadcasts, at most.
HOT_ROWS = 2_000


def join_hot(rows: DataFrame, table: DataFrame, keys: dict[str, str], n: str) -> DataFrame:
    """``rows`` inner-joined to ``table`` (one row a key, ``n``: about how many rows meet it), which isn't shuffled for hot keys.

    ``keys`` names rows' columns and the table's, which differ. Hot keys stand for more than 1 / HOT_ROWS of all
    rows each, so there are HOT_ROWS at most, and these are broadcast; the others are joined by key.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    same = [F.col(a) == F.col(b) for a, b in keys.items()]
    hot = F.col(n) > total / HOT_ROWS
    known = F.broadcast(table.where(hot))
    found = rows.join(known, same)
    rest = rows.join(F.broadcast(table.where(hot).select(*keys.values())), same, "left_anti")
    return found.unionByName(rest.join(table.where(~hot), same))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has."""
    prefix, taken = "_quern_", {c.lower() for c in df.columns}
    while any(prefix + n in taken for n in names):
        prefix = f"_{prefix}"
    return [prefix + n for n in names]


def bucket_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def to_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes in each piece (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


_BLANK = re.compile(rb"[\t-\r ]")


def word_pieces(text: bytes, limit: int = 1 << 20, between: re.Pattern = _BLANK) -> Iterator[bytes]:
    """A text cut behind white space (or what ``between`` matches) into pieces of about ``limit`` bytes (one word at least)."""
    at = 0
    while at < len(text):
        blank = between.search(text, at + limit) if at + limit < len(text) else None
        end = blank.end() if blank else len(text)
        yield text[at:end]
        at = end


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


# --- Bloom filters -------------------------------------------------------------------------------


def _positions(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    x = h.astype(np.int64).view(np.uint64)
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    for i in range(FILTER_PROBES):
        yield (a + np.uint64(i) * b) & np.uint64(bits - 1)


def bloom(hashes: DataFrame, column: str) -> np.ndarray:
    """Bloom filter of a long column of hashes, as uint64 words.

    The words are or-ed by an aggregation, so only the filter reaches the driver:
    MAX_FILTER_BITS at most, whatever the number of keys. Users must treat a hit as "perhaps".
    """
    n = hashes.count()
    bits = 1 << max(10, min(MAX_FILTER_BITS.bit_length() - 1, int(16 * max(n, 1)).bit_length()))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            p = np.unique(np.concatenate([*_positions(h, bits)])) if len(h) else np.empty(0, np.uint64)
            word, first = np.unique(p >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first) if len(p) else p
            yield pa.record_batch([word.astype(np.int64), value.view(np.int64)], names=["word", "value"])

    words = np.zeros(bits >> 6, np.uint64)
    got = hashes.select(column).mapInArrow(positions, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    words[got["word"].to_numpy(np.int64)] = got["value"].to_numpy(np.int64).view(np.uint64)
    return words


def bloom_admits(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter doesn't rule out."""
    out = np.ones(len(h), bool)
    for p in _positions(h, len(words) << 6):
        out &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def in_bloom(spark: SparkSession, words: np.ndarray):
    """A Pandas UDF of a long column: False where the key is surely not in the filter."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        return pd.Series(bloom_admits(shared.value, h.to_numpy(np.int64)))

    return probe


# --- connected components ------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: longs): root is the smallest node it reaches.

    Alternating large-star and small-star rounds: each round is two aggregations and two joins
    over at most the edges, written to the shared folder, and only a count and a checksum reach
    the driver. The rounds grow with the logarithm of the longest chain.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    clean = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = persist(clean(edges.select("a", "b")), "edges"), None
    while True:
        near = both(edges)
        low = persist(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "low")
        large = near.join(low, near.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = persist(clean(large), "large")
        discard(edges, low)
        low = persist(larger.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "low")
        joined = larger.join(low, larger.a == low.u)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = persist(clean(small), "small")
        discard(larger, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = now
