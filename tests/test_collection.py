"""Chunks of structured lines, collections on disk, and answers from them."""

from pyspark.sql import functions as F

from quern.operators import answers as A, corpus, retrieval as R
from quern.sources import store as S

TEXT = """[H1] Fees
The tuition is five coins a year. Payment is due in autumn, before the first lesson begins.
[TABLE] Art — Fee: 5, with a studio of its own for every single learner
[TABLE] Art — Place: the north hall beside the river and the old mill
[TABLE] Law — Fee: 7, with a library open through all of the night
[H2] Questions
Q: Where is the north hall? It is hard to find.
A: Beside the river, behind the old mill.
Q: When does the library open for readers?
A: It is open through all of the night."""


def lines_of(spark):
    return corpus.tagged_lines(spark.createDataFrame([("a", TEXT), ("b", None), ("c", ""), ("d", "short")], "doc string, text string"))


def test_chunks_follow_the_structure(spark):
    got = [r.asDict() for r in corpus.build_chunks(lines_of(spark), min_words=3, overlap=0).orderBy("chunk_index").collect()]
    assert {r["doc"] for r in got} == {"a"} and [r["id"] for r in got] == [f"a_{i}" for i in range(len(got))]
    assert all(r["total_chunks"] == len(got) for r in got)
    tables = [r["text"] for r in got if r["kind"] == "table"]
    assert [t.splitlines()[0] for t in tables] == ["Fees", "Fees"] and tables[0].count("Art —") == 2 and "Law —" in tables[1]
    prose = [r["text"] for r in got if r["kind"] == "prose"]
    assert prose[0].startswith("Fees\nThe tuition")
    assert any("hard to find. A: Beside the river" in t for t in prose) and all(t.startswith(("Fees\n", "Questions\n")) for t in prose)


def test_long_tables_are_split_between_rows(spark):
    rows = [("a", i, "table", f"T — row {i} " + "w " * 30) for i in range(10)]
    got = corpus.build_chunks(spark.createDataFrame(rows, "doc string, line_no int, kind string, body string"), max_words=100).orderBy("chunk_index").collect()
    assert [len(r.text.splitlines()) for r in got] == [2, 2, 2, 2, 2]


def test_table_rows_become_sentences(spark):
    cells = [(0, 0, ["Name", "Fee"]), (1, 0, ["Art", "5"]), (2, 0, ["Law", "-"]), (3, 1, ["1", "2"]), (4, 1, ["3"])]
    rows = [("a", n, "table", None, t, c) for n, t, c in cells] + [("a", 9, "prose", "end", None, None)]
    lines = spark.createDataFrame(rows, "doc string, line_no int, kind string, body string, table_no int, cells array<string>")
    got = [(r.line_no, r.kind, r.body) for r in corpus.table_sentences(lines).orderBy("line_no").collect()]
    assert got == [(1, "table", "Art — Fee: 5"), (2, "table", "Law — Fee: 5"), (3, "prose", "1 | 2"), (4, "prose", "3 | 2"), (9, "prose", "end")]


def test_vectors_are_unit_and_fixed(spark):
    rows = corpus.encode(spark.createDataFrame([("red apple",), ("apple red",), ("",), (None,)], "text string"))
    a, b, c, d = [r.embedding for r in rows.collect()]
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and sum(c) == sum(d) == 0 and len(a) == corpus.DIMENSION


def test_store_versions(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"))
    assert store.count("t") == 0 and not store.is_populated("t")
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, x string, version int")
    store.upsert("t", rows)
    store.upsert("t", rows.where("id = 2").withColumns({"x": F.lit("c"), "version": F.lit(2)}))
    store.upsert("t", rows.where("id = 1").withColumns({"id": F.lit(3).cast("long")}))
    assert sorted((r.id, r.x) for r in store.read("t").collect()) == [(1, "a"), (2, "c"), (3, "a")]
    (tmp_path / "s" / "t" / "v9").mkdir()  # a job that didn't end
    assert store.versions("t") == [2, 3] and store.count("t") == 3
    store.reset()
    assert store.versions("t") == []


def test_answers_over_a_collection(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "c"))
    literal = spark.createDataFrame([("k1", "kb", "The gate is painted green every spring by the gardeners.", "Notes", "general")], "id string, doc string, text string, source string, section string")
    assert S.build(store, lines_of(spark), literal) and not S.build(store, lines_of(spark))
    search = S.searcher(store, 3)
    questions = spark.createDataFrame([(1, "Who paints the gate green?", None), (2, "zzzz qqqq", None), (3, "library at night", [("hi", "hello")])], f"query_id long, text string, recent {A.EXCHANGES}")
    plain = {r.query_id: r for r in A.retrieval_answer(questions, search).collect()}
    assert plain[1].answer.startswith(A.LEAD["en"] + "\n\nThe gate is painted") and plain[1].sources.startswith("Notes")

    def model(messages):
        return F.when(F.size(messages) == 2, F.concat(F.lit("<think>hm</think>answer to "), F.element_at(messages, -1)["content"])).otherwise("Error: no")

    first = A.answer(questions, search, model).cache()
    got = {r.query_id: r for r in first.collect()}
    assert got[1].answer.startswith("answer to Context:\n[1] Notes\nThe gate is painted") and got[1].key and not got[1].cached
    assert got[3].key is None and "Source: " in got[3].answer
    again = {r.query_id: r for r in A.answer(questions, search, model, A.cache_entries(first, 1)).collect()}
    assert again[1].cached and again[1].answer == got[1].answer and not again[3].cached
    shown = {r.query_id: r.display for r in A.format_answer(first).collect()}
    assert shown[1].splitlines()[-1].startswith("[Retrieved ")
    missing = A.answer(questions.where("query_id = 2"), lambda q: search(q).limit(0)).first()
    assert missing.answer == A.APOLOGY["en"] and missing.chunks_found == 0


def test_dialect_falls_back_to_the_question_as_put(spark):
    index = R.bm25_index(spark.createDataFrame([(1, "فلوس كثيرة"), (2, "x"), (3, "y")], "id long, text string"))

    def search(q):
        hits = R.bm25_search(index, q, 3)
        return hits.select("query_id", "id", "rank")

    questions = spark.createDataFrame([(1, "فلوس")], "query_id long, text string")
    assert [r.id for r in A.search_twice(questions, search).collect()] == [1]
