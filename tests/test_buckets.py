"""Upserts by buckets: rows of the latest version, and untouched files as they were."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval as R
from quern.sources.buckets import BucketedTable
from quern.sources.store import Store

rng = random.Random(6)
ROWS = "id long, text string, version int"


def test_upserts_equal_the_union(spark, tmp_path):
    table, every = BucketedTable(Store(spark, str(tmp_path)), "chunks", buckets=7), None
    with pytest.raises(FileNotFoundError):
        table.rows()
    for n in range(3):
        batch = spark.createDataFrame([(i, f"v{n} of {i}", 10 * n + (i or 0) % 3) for i in [*rng.sample(range(60), 20), None, None][: 22 if n else 21]], ROWS)
        every = batch if every is None else every.unionByName(batch)
        table.upsert(batch)
        want = R.upsert(every.limit(0), every)
        assert sorted(map(repr, table.rows().select("id", "text", "version").collect())) == sorted(map(repr, want.select("id", "text", "version").collect()))
    assert table.upsert(every.limit(0)) == []
    assert BucketedTable(table.store, "chunks", buckets=99).buckets == 7


def test_untouched_files_stay(spark, tmp_path):
    table = BucketedTable(Store(spark, str(tmp_path)), "chunks", buckets=8)
    table.upsert(spark.range(200).select("id", F.lit("old").alias("text"), F.lit(1).alias("version")))
    before, reader = {*table.rows().inputFiles()}, table.rows()
    touched = table.upsert(spark.createDataFrame([(5, "new", 2), (6, "older", 0)], ROWS))
    after = {*table.rows().inputFiles()}
    of = lambda paths: {p for p in paths if int(p.split("_bucket=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 2 and of(before) == of(after) and not (after - of(after)) & before
    got = {r.id: r.text for r in table.rows().collect()}
    assert got[5] == "new" and got[6] == "old" and len(got) == 200
    assert reader.where("text = 'new'").count() == 0 and reader.count() == 200  # it keeps its version
    assert table.vacuum() == 0  # the list before is still named
    table.upsert(spark.createDataFrame([(5, "newest", 3)], ROWS))
    assert table.vacuum() > 0 and table.rows().count() == 200
    few = table.rows([5])
    assert len(few.inputFiles()) == 1 and few.where("id = 5").first().text == "newest"


def test_a_lost_job_and_a_repeated_key(spark, tmp_path, monkeypatch):
    table = BucketedTable(Store(spark, str(tmp_path)), "chunks", buckets=4)
    table.upsert(spark.range(10).select("id", F.lit("a").alias("text"), F.lit(1).alias("version")))
    monkeypatch.setattr(table.store, "write", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.upsert(spark.createDataFrame([(1, "b", 2)], ROWS))
    monkeypatch.undo()
    assert table.rows().where("text = 'b'").count() == 0
    table.upsert(spark.range(5000).select(F.lit(3).cast("long").alias("id"), F.col("id").cast("string").alias("text"), F.col("id").cast("int").alias("version")))
    assert table.rows().where("id = 3").first().text == "4999" and table.rows().count() == 10
