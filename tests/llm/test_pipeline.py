import os
from collections import Counter

import pytest

import corpus_pipeline
from quern.llm import common

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= n
        docs, n = out, out.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert mixed.where("taken <= 0 or taken > 3 * size").count() == 0
    assert mixed.count() == corpus_pipeline.run(spark, DATA).count()


@pytest.fixture(scope="module")
def hostile(spark):
    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    texts = [None, "", " \n ", "one", "ONE two", "same words here", "same words here", passage, f"{passage} and more", "x" * 5000, "word " * 30_000, "é" * 300]
    rows = [(i, t, ("en", None)[i % 2], (None, "a", "b")[i % 3], "x") for i, t in enumerate(texts)]
    rows += [rows[5], (5, "another text", "en", "a", "x"), (None, None, None, None, None), (None, "same words here", "en", "b", "x")]
    # columns whose names the operators use themselves
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    return docs.selectExpr("*", "score as fp", "score as digest", "score as n", "score as key", "score as size", "score as _quern_id", "score as _quern_sha", "score as __quern_items")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_hostile_rows(spark, hostile, name, stage):
    out = stage(spark, hostile, DATA)
    if name == "mixing":
        assert all(0 < r.taken <= 3 * r.size for r in out.collect())
    else:
        assert out.columns == hostile.columns
        assert not Counter(map(str, out.collect())) - Counter(map(str, hostile.collect()))
        kept = Counter(r.text or "" for r in out.select("text").collect())
        if name == "exact dedup":
            assert kept == Counter({r.text or "" for r in hostile.select("text").collect()})
            assert {r.doc_id for r in out.where("text = 'same words here'").collect()} == {6}
        if name == "near dedup":
            assert kept["same words here"] == 1 and kept["another text"] == 1 and sum(kept[x] for x in ("", " \n ")) == 1
        if name == "decontamination":
            had = Counter(r.text or "" for r in hostile.select("text").collect())
            assert all(kept[t] == n for t, n in had.items() if len(t) < 100 or t[0] in "xé") and sum(kept.values()) == sum(had.values()) - 2
    assert stage(spark, hostile.where("false"), DATA).count() == 0


def test_run_leaves_no_tables_of_stages(spark):
    folder = f"{common.shared_dir(spark)}/quern"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, DATA).count() > 0
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"decontamination", "keyed", "ranges"}


def test_scratch_deletes_what_is_not_kept(spark):
    rows = spark.range(3)
    outside = common.persist(rows, "outside")
    with common.scratch(spark) as tables:
        kept, gone = tables.keep(common.persist(rows, "kept")), common.persist(rows, "gone")
    assert kept.count() == outside.count() == 3 and not os.path.exists(gone._quern_path)
    common.discard(kept, outside)
    assert not os.path.exists(outside._quern_path)


@pytest.mark.parametrize("hot", [1, 10, 1000])
def test_join_hot_equals_a_join(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 5 + [3, 4, None])], "k long, v long")
    table = spark.createDataFrame([(1, "a", 50), (2, "b", 5), (3, "c", 1), (9, "d", 0)], "key long, name string, n long")
    got = common.join_hot(rows, table, {"k": "key"}, "n").select("v", "name").collect()
    assert sorted(got) == sorted(rows.join(table, rows.k == table.key).select("v", "name").collect())
