"""Vectors fitted on a corpus against the singular values of the whole matrix."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.operators import lsa
from quern.plans import queries

rng = np.random.default_rng(5)
TOPICS = [[f"t{t}w{i}" for i in range(25)] for t in range(6)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(240):
        words = [*rng.choice(TOPICS[i % 6], 30), *rng.choice(TOPICS[(i * 7) % 6], 3)]
        rows.append((i, " ".join(words), i % 6))
    return spark.createDataFrame([*rows, *[(500 + i, rows[0][1], 0) for i in range(100)], (900, None, -1), (901, "", -1), (902, "of the", -1)], "id long, text string, columns int").repartition(5).cache()


def dense(docs, columns):
    """The matrix itself."""
    rows = lsa.columns_of(docs, columns).orderBy("id").collect()
    tf = np.zeros((len(rows), columns))
    for i, r in enumerate(rows):
        np.add.at(tf[i], r["columns"], 1)
    df = (tf > 0).sum(0)
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * np.where(df > 0, np.log((1 + len(rows)) / (1 + df)) + 1, 0)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


def test_singular_values_equal_those_of_the_matrix(docs, monkeypatch):
    monkeypatch.setattr(lsa, "ENTRIES", 300)
    monkeypatch.setattr(lsa, "SUM_COLUMNS", 100)
    monkeypatch.setattr(lsa, "GROUPS", 2)
    model, x = lsa.fit(docs, rank=8, columns=1024, passes=6), dense(docs, 1024)
    _, want, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.values, want[:8], rtol=1e-3) and np.allclose(model.directions.T @ model.directions, np.eye(8), atol=1e-9)
    got = {r.id: np.array(r.embedding) for r in lsa.encode(docs, model).collect()}
    assert len(got) == docs.count() and not any(got[i].any() for i in (900, 901, 902))
    brute = x @ vt[:6].T  # six topics: their space is that of the first six directions
    six = lsa.fit(docs, rank=6, columns=1024, passes=6)
    mine = {r.id: np.array(r.embedding) for r in lsa.encode(docs, six).collect()}
    for i, row in enumerate(docs.orderBy("id").limit(60).collect()):
        other = brute[i] / np.linalg.norm(brute[i])
        for j in (0, 1, 2):
            assert mine[row.id] @ mine[j] == pytest.approx(other @ (brute[j] / np.linalg.norm(brute[j])), abs=0.02)


def test_texts_of_a_topic_are_near(docs):
    vectors = lsa.encode(docs, lsa.fit(docs, rank=6, columns=2048)).where("id < 240").orderBy("id").collect()
    x, topic = np.array([v.embedding for v in vectors]), np.array([v.id % 6 for v in vectors])
    near = (x @ x.T - 2 * np.eye(len(x))).argmax(1)
    assert (topic[near] == topic).mean() > 0.95 and np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5)


def test_fits_do_not_depend_on_partitions(docs):
    a, b = lsa.fit(docs.coalesce(1), rank=4, columns=512), lsa.fit(docs.repartition(9), rank=4, columns=512)
    assert np.allclose(a.values, b.values, rtol=1e-9)


def test_an_empty_corpus(spark, docs):
    model = lsa.fit(docs.where("false"), rank=4, columns=64)
    assert len(model.values) == 0 and {len(r.embedding) for r in lsa.encode(docs, model).collect()} == {0}
    assert lsa.encode(docs.where("false"), model).select(F.size("embedding")).count() == 0


@pytest.mark.parametrize("dense_columns, cells", [(0, 1 << 20), (40, 100), (1 << 13, 1 << 20)])
def test_vectors_do_not_depend_on_the_dense_part_and_texts_are_tokenized_once(docs, monkeypatch, dense_columns, cells):
    want = {r.id: np.array(r.embedding) for r in lsa.encode(docs, lsa.fit(docs, rank=6, columns=512)).collect()}
    for name, value in {"DENSE_COLUMNS": dense_columns, "CELLS": cells, "STEP": 7}.items():
        monkeypatch.setattr(lsa, name, value)
    tokenized, tokenize = [], lsa.tokenize
    monkeypatch.setattr(lsa, "tokenize", lambda c: tokenized.append(c) or tokenize(c))
    got = lsa.fit_encode(docs.select("id", "text", F.lit("a").alias("source")), rank=6, columns=512)
    assert got.columns == ["id", "source", "embedding"] and len(tokenized) == 1
    got = {r.id: np.array(r.embedding) for r in got.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-5) for i in want)


def test_a_table_in_one_row_group_is_dealt_over_all_cores(spark, tmp_path):
    table = pa.table({"doc_id": np.arange(4000), "text": [f"a text {i}" for i in range(4000)], "source": ["s"] * 4000, "lang": ["en"] * 4000})
    pq.write_table(table, tmp_path / "documents.parquet")
    small = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        assert queries.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() >= 4
        held = queries.docs_of(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in held) == 4000 and max(r["count"] for r in held) < 2000
