"""The vector and sparse indexes against plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import block_index as K, retrieval as R, vector_index as V

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def vectors(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(12, 16))[g.integers(0, 12, 900)] + 0.4 * g.normal(size=(900, 16))
    x = np.vstack([x, np.repeat(x[:1], 400, axis=0)])  # one vector in many rows
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(x)] + [(5000, None, 1)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, section int").repartition(4).cache()


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("id % 45 = 0 or id = 5000").select(F.col("id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def texts(spark):
    g = np.random.default_rng(4)
    p = 1 / np.arange(1, 61)
    rows = [(i, " ".join(g.choice(WORDS, g.integers(0, 40), p=p / p.sum()))) for i in range(700)]
    return spark.createDataFrame([*rows, (900, None), *[(1000 + i, rows[5][1]) for i in range(40)]], "id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "w59 w58 w57"), (2, "w0 w1 w0"), (3, "nothing of it"), (4, ""), (5, "w30 w2 w45 w12"), (6, None)], "query_id long, text string")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_all_cells_are_exact_and_few_find_most(vectors, asked, monkeypatch):
    monkeypatch.setattr(V, "FILE_ROWS", 50)  # the repeated vector's cell has several files
    index = V.build_cells(vectors, cells=24)
    assert index.sizes.sum() == 1300 and index.vectors.count() == 1300
    exact = R.dense_search(vectors, asked, 7)
    assert rows_of(V.cell_search(index, asked, 7, None)) == rows_of(exact)
    probes = V.probes_for(index, 7)
    found = V.recall(V.cell_search(index, asked, 7, probes), exact).agg(F.sum("n_found"), F.sum("n_exact")).first()
    assert probes < 12 and found[0] >= 0.9 * found[1]
    hot = index.vectors.where(F.col("cell") == int(np.argmax(index.sizes)))
    assert index.sizes.max() >= 400 and len(hot.inputFiles()) > 1


def test_only_probed_cells_are_read(vectors, asked):
    index = V.build_cells(vectors, cells=24)
    plan = V.cell_search(index, asked.limit(1), 7, 2)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "cell" in filters and filters.count(",") <= 1


def test_cells_do_not_depend_on_partitions(vectors):
    one, many = V.fit_cells(vectors.coalesce(1), 9), V.fit_cells(vectors.repartition(7), 9)
    assert (one == many).all() and np.allclose(np.linalg.norm(one, axis=1), 1)
    assert len(V.fit_cells(vectors, 9, fit_rows=300)) == 9


def test_cells_of_nothing(spark, vectors, asked):
    index = V.build_cells(vectors.where("false"))
    assert V.cell_search(index, asked, 7).count() == 0 and V.probes_for(index) == 1
    assert V.cell_search(V.build_cells(vectors.limit(3), cells=10), asked.where("false"), 7).count() == 0


@pytest.mark.parametrize("first, size", [(1, 16), (4, None)])
def test_block_search_equals_plain_search(texts, questions, first, size):
    plain = R.bm25_index(texts)
    index = K.block_index(plain, size and F.floor(F.col("id") / size))
    for k in (5, 2000):
        hits, read = K.block_search(index, questions, k, first)
        assert rows_of(hits) == rows_of(R.bm25_search(plain, questions, k))
    hits, read = K.block_search(index, questions, 3, first)
    read = {r.query_id: r for r in read.collect()}
    assert read[1].opened < read[1].blocks and all(r.opened <= r.blocks for r in read.values()) and 3 not in read
    plain.release()


def test_bounds_hold(texts, questions):
    plain = R.bm25_index(texts)
    index = K.block_index(plain, F.floor(F.col("id") / 16))
    weighted = R.query_terms(questions, index.terms)
    scores = R.bm25_search(plain, questions, 10_000).withColumn("block", F.floor(F.col("id") / 16))
    assert scores.join(K._bounds(index, weighted), ["query_id", "block"], "left").where("bound is null or bound < bm25_score").count() == 0
    plain.release()


def test_nothing_stays_cached(spark, texts, questions):
    cached = spark.sparkContext._jsc.sc().getPersistentRDDs
    before = cached().size()
    index = R.bm25_index(texts)
    R.bm25_search(index, questions).count()
    assert cached().size() > before
    index.release()
    assert cached().size() == before


def test_section_filter_comes_before_the_cut(spark):
    docs = spark.createDataFrame([(i, "gold gold gold") for i in range(60)] + [(100 + i, "gold and a long tail of words") for i in range(5)], "id long, text string")
    vectors = docs.select("id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"), (F.col("id") >= 100).alias("section"))
    asked = spark.createDataFrame([(1, "gold", [-1.0, 0.0])], "query_id long, text string, embedding array<float>")
    index = R.bm25_index(docs)
    got = R.hybrid_search(index, vectors, asked, 4, F.col("section"), vectors)
    assert sorted(r.id for r in got.collect()) == [100, 101, 102, 103]
    index.release()
