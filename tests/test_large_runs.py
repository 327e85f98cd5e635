"""Chunks of semantic groups of runs of any size: the same as by rows that hold a run, with no row as long as a run."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import chunking as C
from quern.sources import shared


def units_of(spark, seed):
    pick = random.Random(seed)
    text = lambda: " ".join(f"w{pick.randrange(99)}" for _ in range(pick.choice([0, 1, 3, 8, 20, 35, 60, 170])))
    vector = lambda run: [1.0, 0.0] if run == 3 else [pick.choice([0.1, 0.5, 0.9]), pick.random()]
    rows = [(run, i, " " * pick.randrange(2) + text() + "\n", vector(run)) for run, n in ((1, 90), (2, 40), (3, 60), (None, 30)) for i in range(n)]
    rows += [(4, 0, "alone", [1.0, 0.0]), (5, 0, " ", [1.0, 0.0]), (6, 0, "short", [1.0, 0.0]), (6, 1, "too", [0.0, 1.0])]
    pick.shuffle(rows)
    return spark.createDataFrame(rows, "run int, unit int, text string, embedding array<double>").repartition(5)


@pytest.mark.parametrize("seed, limits", [(1, {}), (2, {"max_words": 40, "min_words": 15, "overlap": 5}), (3, {"max_words": 20, "min_words": 500, "overlap": 3, "min_chars": 200}), (4, {"min_words": 0, "overlap": 0})])
def test_large_runs_have_the_same_chunks(spark, seed, limits):
    units = units_of(spark, seed)
    plain, large = C.semantic_chunks(units, **limits), C.semantic_chunks(units, **limits, large=True)
    rows = lambda df: sorted(map(repr, df.select("run", "chunk_index", "text").collect()))
    assert rows(large) == rows(plain) and large.columns == plain.columns and large.count() > 4
    assert dict(large.dtypes) == dict(plain.dtypes)


def test_no_row_holds_a_run(spark, monkeypatch):
    """What is gathered of a run of 600 units is written by chunk, none of them longer than its words allow."""
    kept = {}
    monkeypatch.setattr(C, "stored", lambda df, name, *by, **path: kept.setdefault(name, shared.stored(df, name, *by, **path)))
    units = spark.range(600).select(F.lit(1).alias("run"), F.col("id").alias("unit"), F.repeat(F.lit("word "), F.lit(30)).alias("text"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    assert C.semantic_chunks(units, large=True).count() == 120
    assert kept["chunks"].agg(F.max("units"), F.sum("units")).first() == (5, 600)


def test_begins_go_on_over_batches():
    rows = [(1, 0, 5), (1, 0, 5), (1, 0, 1), (1, 1, 1), (None, 1, 9), (None, 1, 1), (None, 1, 1), (2, 1, 99), (2, 1, 1)]
    table = pa.table({c: pa.array(x) for c, x in zip(("run", "group", "n"), zip(*rows))})
    for step in (1, 2, 9):
        batches = [b for i in range(0, 9, step) for b in table.slice(i, step).to_batches()]
        assert [x for b in C.begins(iter(batches), "run", 10) for x in b.column("begin").to_pylist()] == [1, 0, 1, 1, 1, 0, 1, 1, 1]
