"""A sparse index in segments against an index of the final table."""

import random

from pyspark.sql import functions as F

from quern.operators import retrieval as R
from quern.sources.segments import SegmentedIndex
from quern.sources.store import Store

rng = random.Random(2)


def text():
    return " ".join(rng.choices([f"w{i}" for i in range(30)], weights=[30 - i for i in range(30)], k=rng.randint(0, 20)))


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def same(spark, index, final):
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["w0 w29", "w3 w3 w7", "w28", "none"])], "query_id long, text string")
    want = R.bm25_index(frame(spark, sorted(final.items())))
    got = index.index()
    terms = lambda x: sorted((r.term, r.df, round(r.idf, 9)) for r in x.terms.collect())
    assert terms(got) == terms(want)
    assert [(r.n, round(r.avgdl, 9)) for r in got.stats.collect()] == [(r.n, round(r.avgdl, 9)) for r in want.stats.collect()]
    rows = lambda x: sorted(map(tuple, R.bm25_search(x, asked, 8).collect()))
    assert rows(got) == rows(want)
    want.release()


def test_batches_equal_the_final_table(spark, tmp_path):
    index, final = SegmentedIndex(Store(spark, str(tmp_path))), {}
    assert index.index().postings.count() == 0 and R.bm25_search(index.index(), frame(spark, [(1, "w1")]).withColumnRenamed("id", "query_id")).count() == 0
    for n in range(5):
        new = {i: text() for i in rng.sample(range(60), 25)}
        gone = rng.sample(range(80), 10) if n else []
        gone = [i for i in gone if i not in new]
        rows = [*new.items(), (None, "w1"), *list(new.items())[:1]]
        deleted = spark.createDataFrame([(i,) for i in [*gone, None]], "id long")
        index.add(frame(spark, rows), deleted if n else None)
        final = {i: t for i, t in (final | new).items() if i not in gone}
    assert [s[:2] for s in index.segments()] == [(i, i) for i in range(1, 6)]
    index.compact(1, 3)  # a middle run: what it takes out of the first stays known
    assert [s[:2] for s in index.segments()] == [(1, 1), (2, 4), (5, 5)]
    same(spark, index, final)
    back = {i: text() for i in range(70, 75)}
    index.add(frame(spark, list(back.items())))
    index.compact()
    assert len(index.segments()) == 1
    same(spark, index, final | back)
    assert index.index().postings.count() == index._read("postings", index.segments()).count()
    assert index._read("dead", index.segments()).count() == 0 and index._read("terms", index.segments()).where("df <= 0").count() == 0
    assert index.vacuum() > 0 and index.vacuum() == 0
    index.add(deleted=spark.createDataFrame([(i,) for i in range(80)], "id long"))
    assert R.bm25_search(index.index(), frame(spark, [(1, "w1 w2 w0")]).withColumnRenamed("id", "query_id")).count() == 0


def test_a_lost_batch_changes_nothing(spark, tmp_path, monkeypatch):
    index = SegmentedIndex(Store(spark, str(tmp_path)))
    index.add(frame(spark, [(1, "w1 w2"), (2, None)]))
    before = index.segments()
    monkeypatch.setattr(index, "_list", lambda segments: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        index.add(frame(spark, [(1, "w3")]))
    except RuntimeError:
        pass
    assert SegmentedIndex(Store(spark, str(tmp_path))).segments() == before
    monkeypatch.undo()
    index.add(frame(spark, [(1, "w4")]))
    same(spark, index, {1: "w4", 2: ""})


def test_segments_stay_few(spark, tmp_path):
    index = SegmentedIndex(Store(spark, str(tmp_path)))
    for n in range(4):
        index.add(frame(spark, [(10 * n + i, "w1 w2") for i in range(3)]))
        index.tidy(ratio=2)
    sizes = index.sizes()
    assert sum(sizes) == 12 and all(a >= 2 * sum(sizes[i + 1 :]) for i, a in enumerate(sizes[:-1]))
    assert index.index().terms.agg(F.max("df")).first()[0] == 12


def test_postings_of_a_batch_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Texts are dealt by id once; their postings are counted, sorted and written where they lie, and texts are tokenized once."""
    index, plans = SegmentedIndex(Store(spark, str(tmp_path))), []
    write, cached = index._write_postings, spark.sparkContext._jsc.sc().getPersistentRDDs().size()

    def seen(rows, folder):
        write(rows, folder)
        plans.append(rows.sortWithinPartitions("term", "id")._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(index, "_write_postings", seen)
    index.add(frame(spark, [(i, text()) for i in range(200)]))
    index.add(frame(spark, [(i, text()) for i in range(150, 300)]))
    index.compact()
    assert all("InMemoryTableScan" in p and "Exchange" not in p.split("InMemoryRelation")[0] for p in plans[:2]) and len(plans) == 3
    files = spark.read.parquet(f"{tmp_path}/segments/{index.segments()[0][2]}/postings").withColumn("file", F.input_file_name())
    terms = files.select("file", "term").distinct().groupBy("term").count()
    assert files.select("file").distinct().count() > 1 and terms.agg(F.max("count")).first()[0] > 1  # a common term spans several files
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == cached
