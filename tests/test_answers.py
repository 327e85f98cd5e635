"""A cache that a batch of questions fills for itself."""

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers as A, retrieval as R


def test_equal_questions_are_answered_once(spark):
    docs = spark.createDataFrame([(i, f"{w} is a colour of many things", "s", "general") for i, w in enumerate(("red", "green", "blue"))], "id long, text string, source string, section string")
    index = R.bm25_index(docs)
    search = lambda q: R.bm25_search(index, q, 2).select("query_id", "id", "rank").join(docs, "id")
    rows = [(i, 500 - i, "what of red", []) for i in range(300)]  # a hot question, the last comes first
    rows += [(1000, 1, "what of green", []), (1001, 2, "what of green", []), (1002, 3, "what of green", [("u", "a")]), (1003, None, "what of green", None), (1004, 9, "nothing known", []), (1005, 9, "nothing known", []), (1006, 4, "what of blue", []), (1007, 5, None, [])]
    asked = spark.createDataFrame(rows, "query_id long, seq long, text string, recent array<struct<user:string,assistant:string>>").repartition(4)
    key = docs.where("id = 2").select(T.cache_key(F.lit("what of blue"), F.col("text")).alias("key"), F.lit("a kept answer").alias("value"))
    calls = lambda messages: F.concat(F.lit("an answer: "), F.expr("uuid()"))  # noqa: E731 - each call another
    got = {r.query_id: r for r in A.answer_in_order(asked, search, calls, key).collect()}
    assert len(got) == len(rows)
    hot = [got[i] for i in range(300)]
    assert len({r.answer for r in hot}) == 1 and [r.query_id for r in hot if not r.cached] == [299]
    assert not got[1003].cached and got[1000].cached and got[1001].cached and {got[i].answer for i in (1000, 1001, 1003)} == {got[1003].answer}
    assert not got[1002].cached and got[1002].answer != got[1003].answer and got[1002].key is None
    assert got[1004].chunks_found == 0 and not got[1004].cached and not got[1005].cached and got[1004].answer != got[1005].answer
    assert got[1006].cached and got[1006].answer == "a kept answer" and not got[1007].cached
    entries = A.cache_entries(A.answer_in_order(asked, search, calls, key), 1).collect()
    assert len(entries) == 2
    index.release()
