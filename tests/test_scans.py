"""Scans and percentiles of groups of any size against windows and sorted groups."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from quern.operators import chunking as C, scans

rng = random.Random(1)
ROWS = "g int, o int, v string, x int, k string, c boolean"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("n, groups, parts", [(2500, [1, 2, None], 9), (700, list(range(300)), 5), (10, [1], 20)])
def test_scans_equal_windows(spark, small_batches, n, groups, parts):
    rows = [(rng.choice(groups), i, rng.choice([None, None, f"v{i}"]), rng.choice([None, 1, 2, 5]), rng.choice("abbb"), rng.random() < 0.8) for i in range(n)]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    got = scans.scan(df, ["g"], ["o"], last={"lv": F.col("v")}, total={"sx": F.col("x")}, before={"bk": F.col("k"), "ba": F.array("o")}, after={"ak": F.array("o"), "av": F.col("v")}, starts={"st": (F.col("k"), F.col("c"))}, parts=parts)
    w = W.partitionBy("g").orderBy("o")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    began = F.when((F.lag("k").over(w).isNull() | (F.lag("k").over(w) != F.col("k"))) & F.col("c"), 1).otherwise(0)
    want = df.withColumn("began", began).select(
        "*", F.last("v", True).over(upto).alias("lv"), F.coalesce(F.sum("x").over(upto), F.lit(0)).alias("sx"), F.lag("k").over(w).alias("bk"), F.lag(F.array("o")).over(w).alias("ba"),
        F.lead(F.array("o")).over(w).alias("ak"), F.lead("v").over(w).alias("av"), F.sum("began").over(upto).alias("st"),
    ).drop("began")
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_one_column_of_all_rows_lies_in_many_tasks(spark):
    cells = spark.range(20_000).select(F.lit("d").alias("doc"), F.lit(0).alias("table_no"), F.col("id").alias("row_no"), F.lit(0).alias("col_no"), F.when(F.col("id") % 4999 == 1, F.concat(F.lit("v"), "id")).otherwise("—").alias("cell"))
    got = C.forward_fill(cells, ranges=8)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    scanned = spark.read.parquet(*got.inputFiles()).groupBy("_part").count().collect()
    assert len(scanned) == 8 and max(r["count"] for r in scanned) < 2 * 20_000 / 8 and sum(sizes) == 20_000
    assert sorted(map(tuple, got.select("row_no", "cell").collect())) == sorted(map(tuple, C.forward_fill(cells).select("row_no", "cell").collect()))


def test_ranges_give_the_same_runs_and_groups(spark, monkeypatch):
    lines = spark.createDataFrame([("a" if i < 900 else f"b{i % 3}", i, rng.choice(["heading", "table", "prose", "prose"]), f"x{i}") for i in range(1000)], "doc string, line_no int, kind string, body string").repartition(3)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
    assert same(C.structure_runs(lines), C.structure_runs(lines, ranges=7))
    monkeypatch.setattr(C, "SORTED", 50)
    units = spark.createDataFrame([(1 if i < 500 else i // 4, i, [float(rng.randint(0, 3)), 1.0]) for i in range(600)], "run int, unit int, embedding array<float>").repartition(3)
    assert same(C.semantic_groups(units), C.semantic_groups(units, ranges=6))


@pytest.mark.parametrize("p", [0.3, 1.0, 0.77])
def test_percentiles_equal_sorted_groups(spark, p):
    values = [(rng.choice([1, 1, 1, 2, None]), rng.choice([rng.gauss(0, 1), 5.0, rng.random() * 1e-300, -1e308, 1e308, None, float(rng.randint(0, 3))])) for _ in range(4000)]
    df = spark.createDataFrame([*values, (1, float("nan")), *((7, 2.5) for _ in range(200)), *((8, float(i)) for i in range(9))], "g int, v double")
    want = {r.g: r.q for r in df.where("not isnan(v)").groupBy("g").agg(F.percentile("v", F.lit(p)).alias("q")).collect()}
    assert {r.g: r.q for r in scans.exact_percentile(df, "g", "v", p, "q", small=40).collect()} == want


def test_scans_of_nothing(spark):
    none = spark.createDataFrame([], ROWS)
    assert scans.scan(none, ["g"], ["o"], last={"lv": F.col("v")}, parts=3).count() == 0
    assert scans.exact_percentile(none, "g", "x", 0.5).count() == 0
