"""Postings with positions, and hits ranked by how closely a text holds a query's terms.

A posting is (term, id, positions of the term among the text's tokens). Of a hit, the positions of the query's terms are
walked in order, with the last place of each term at hand; the shortest stretch that holds every term that the text has at
all is its span. Only the postings of the query's terms are read, and only those of hits are gathered: a row is one
query and one text, as long as the text's occurrences of those terms.

Defined cases: a text without a term of the query has no span and isn't among the results; one term spans one token; null texts and
queries have no tokens; repeated terms of a query count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import tokenize
from quern.operators.retrieval import top_k


def positional_postings(docs: DataFrame) -> DataFrame:
    """term, id, positions (from 0, ascending) of (id, text)."""
    tokens = docs.select("id", F.posexplode(tokenize(F.col("text"))).alias("place", "term"))
    return tokens.groupBy("term", "id").agg(F.array_sort(F.collect_list("place")).alias("positions"))


def shortest_span(events: Column, n: Column) -> Column:
    """The length of the shortest stretch with each of ``n`` terms, from (place, term number) in the order of places."""
    state = F.struct(F.array_repeat(F.lit(-1), n).alias("lasts"), F.lit(None).cast("int").alias("best"))

    def step(s: Column, e: Column) -> Column:
        lasts = F.transform(s["lasts"], lambda x, i: F.when(i == e["term"], e["place"]).otherwise(x))
        return F.struct(lasts.alias("lasts"), F.least(s["best"], F.when(F.array_min(lasts) >= 0, e["place"] - F.array_min(lasts) + 1)).alias("best"))

    return F.aggregate(events, state, step, lambda s: s["best"])


def spans(postings: DataFrame, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, id, terms (of the query), covered (of them, by the text), span: of the hits (query_id, id)."""
    terms = queries.select("query_id", F.array_distinct(tokenize(F.col("text"))).alias("all")).where(F.size("all") > 0)
    asked = terms.select("query_id", F.size("all").alias("terms"), F.explode("all").alias("term"))
    wanted = hits.select("query_id", "id").join(asked, "query_id")
    found = postings.join(wanted, ["term", "id"]).groupBy("query_id", "id", "terms").agg(F.collect_list(F.struct("term", "positions")).alias("found"))
    numbered = F.flatten(F.transform("found", lambda f, i: F.transform(f["positions"], lambda p: F.struct(p.alias("place"), i.alias("term")))))
    return found.select("query_id", "id", "terms", F.size("found").alias("covered"), shortest_span(F.array_sort(numbered), F.size("found")).alias("span"))


def span_rerank(postings: DataFrame, queries: DataFrame, hits: DataFrame, k: int = 8) -> DataFrame:
    """query_id, id, covered, span, span_score, rank: the share of the query's terms, times how densely the span holds them."""
    score = F.col("covered") / F.col("terms") * (F.col("covered") / F.col("span"))
    return top_k(spans(postings, queries, hits).withColumn("span_score", F.round(score, 9)), "span_score", k).select("query_id", "id", "covered", "span", "span_score", "rank")
