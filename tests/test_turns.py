"""Turns as a stream and as a batch of replies."""

from pyspark.sql import functions as F

from quern.operators import conversation as G, replies, retrieval as R
from quern.streaming import loop, turns as S


def test_streamed_history_equals_the_batch(spark, tmp_path):
    intents = ["greeting", "in_scope", "crisis", "greeting", None, "in_scope"]
    rows = [(c, i, f"t{c}{i}", x) for c in (1, 2) for i, x in enumerate(intents)]
    schema = "conv_id long, turn long, text string, intent string"
    batch = spark.createDataFrame(rows, schema)
    source = str(tmp_path / "in")
    for low in (0, 3):  # two micro-batches, so the state is carried over
        batch.where(F.col("turn").between(low, low + 2)).coalesce(1).write.mode("append").parquet(source)
        stream = S.history(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    names = ["conv_id", "turn", "text", "intent", "recent", "has_history", "last_answer"]
    got = spark.read.parquet(str(tmp_path / "out")).select(names).orderBy("conv_id", "turn").collect()
    assert got == G.history(batch).select(names).orderBy("conv_id", "turn").collect()


def test_replies(spark):
    said = ["hi", "what is the tuition?", "say it in english", "clear", "say it in english", "ok thanks", "lorem ipsum"]
    turns = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "conv_id long, turn long, text string")
    docs = spark.createDataFrame([(1, "tuition is five coins"), (2, "blue sky"), (3, "green leaf")], "id long, text string")

    def search(queries):
        hits = R.bm25_search(R.bm25_index(docs), queries, 3)
        return hits.join(docs, "id").select("query_id", "rank", "text", F.lit("fees").alias("source"), F.lit("general").alias("section"))

    got = {r.turn: r for r in replies.reply(turns, search).collect()}
    assert set(got) == {0, 1, 2, 4, 5, 6}
    assert got[1].answer == "tuition is five coins\nSource: fees" and got[1].chunks_found == 1
    assert got[2].answer == got[1].answer
    assert got[4].answer == replies.NOTHING_TO_TRANSLATE
    assert got[0].answer.startswith("Hello") and got[5].answer.startswith("You are welcome. Is") and got[6].intent == "out_of_scope"


def _search(docs):
    def search(queries):
        hits = R.bm25_search(R.bm25_index(docs), queries, 3)
        return hits.join(docs, "id").select("query_id", "rank", "text", F.lit("fees").alias("source"), F.lit("general").alias("section"))

    return search


def test_streamed_replies_equal_the_batch_over_restarts_and_repeated_batches(spark, tmp_path):
    said = ["hi", "what is the tuition?", "say it in english", "sources", "clear", "say it in english", "ok thanks", None, "lorem ipsum", "how can I apply for the green leaf?", "thanks", "say it in english"]
    schema = "conv_id long, turn long, text string"
    turns = spark.createDataFrame([(c, i, t) for c in (1, 2, None) for i, t in enumerate(said[: 12 if c else 8])], schema)
    docs = spark.createDataFrame([(1, "tuition is five coins"), (2, "blue sky"), (3, "green leaf")], "id long, text string")
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for low in (0, 5):  # the second start goes on from the checkpoint
        turns.where(F.col("turn").between(low, 4 if low == 0 else 11)).coalesce(1).write.mode("append").parquet(source)
        loop.start(spark.readStream.schema(schema).parquet(source), _search(docs), out, check).awaitTermination()
    order = ("conv_id", "turn")
    got = loop.read(spark, out).orderBy(*order).collect()
    assert len(got) == 2 * 10 + 6
    known = [r for r in got if r.conv_id is not None]
    assert known == replies.reply(turns.where("conv_id is not null"), _search(docs)).select(*got[0].asDict()).orderBy(*order).collect()
    assert {r.turn: r.answer for r in known if r.conv_id == 1}[11] == {r.turn: r.answer for r in known if r.conv_id == 1}[9]
    # a batch whose commit is lost runs again and replaces its rows
    last = max(int(p.name) for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "check" / "commits").iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    loop.start(spark.readStream.schema(schema).parquet(source), _search(docs), out, check).awaitTermination()
    assert loop.read(spark, out).orderBy(*order).collect() == got
