"""Spans against all stretches of a text."""

import random

from quern.operators import positions as P

rng = random.Random(4)


def brute(tokens, terms):
    held = set(tokens) & terms
    spans = [j - i + 1 for i in range(len(tokens)) for j in range(i, len(tokens)) if held <= set(tokens[i : j + 1])]
    return (len(held), min(spans)) if held else None


def test_spans_equal_all_stretches(spark):
    texts = [[rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(rng.randint(0, 25))] for _ in range(60)]
    docs = spark.createDataFrame([*((i, " ".join(t)) for i, t in enumerate(texts)), (99, None)], "id long, text string").repartition(3)
    asked = {1: "aa bb cc", 2: "ff", 3: "dd dd zz aa", 4: "", 5: "zz"}
    queries = spark.createDataFrame([*asked.items(), (6, None)], "query_id long, text string")
    hits = docs.select("id").crossJoin(queries.select("query_id"))
    got = {(r.query_id, r.id): (r.covered, r.span, r.terms) for r in P.spans(P.positional_postings(docs), queries, hits).collect()}
    want = {(q, i): (*b, len(set(text.split()))) for q, text in asked.items() for i, t in enumerate(texts) if (b := brute(t, set(text.split())))}
    assert got == want


def test_close_terms_come_first(spark):
    docs = spark.createDataFrame([(1, "red x1 x2 x3 apple"), (2, "x1 apple red"), (3, "red red red"), (4, "pear")], "id long, text string")
    queries = spark.createDataFrame([(1, "red apple")], "query_id long, text string")
    got = P.span_rerank(P.positional_postings(docs), queries, docs.selectExpr("1L as query_id", "id"), 3).orderBy("rank").collect()
    assert [(r.id, r.covered, r.span) for r in got] == [(2, 2, 2), (3, 1, 1), (1, 2, 5)]
