"""Text functions, routing, chunking and retrieval on small inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import routing, text as T
from quern.operators import chunking as C, conversation as G, retrieval as R
from quern.sources.documents import docx_lines


def value(spark, expression, x):
    return spark.createDataFrame([(x,)], "x string").select(expression(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("text, tokens", [("The 97.80% of كِتاب, word_1 a", ["97", "80%", "تاب", "word_1"]), ("إلى", []), ("الكلية ال", ["كلية", "ال"]), ("", [])])
def test_tokenize(spark, text, tokens):
    assert value(spark, T.tokenize, text) == tokens


@pytest.mark.parametrize("f, text, want", [
    (T.clean, "  أهلا  بك \n--\n\n1. كتاب​", "اهلا بك\n١. كتاب"),
    (T.clean_inline, "a \n b ---- c", "a b  c"),
    (T.clean, "***\n!!!\n—\n(-_-)\n[./\\]\n،؛", "***\n!!!\n—"),
    (T.clean, "ـكتـابـ\uf0b7 أإآٱ\u200b\u200e", "كتاب اااا\u200e"),
    (T.clean, "1. Register\n2) سجل\n  3. سجل\n4.\n\n5. كتاب\n12.5 كتاب\n٣. x", "1. Register\n٢) سجل\n3. سجل\n٤.\n5. كتاب\n١٢.5 كتاب\n٣. x"),
    (T.clean_inline, "ﺔ ﻟ ﺎ\u200d ﻻ", "ة ل ا ﻻ"),
    (T.join_broken_lines, "كتاب ال\nabc في\nجديد", "كتاب ال abc فيجديد"),
    (T.join_broken_lines, "a ال\nب\nت", "a الب ت"),
    (T.join_broken_lines, "a الي\n\n  في \n ب \nx", "a الي فيب x"),
    (T.language, "abc", "en"), (T.language, "", "ar"), (T.language, "ab كت", "ar"),
    (T.sentences, "One two. Three four? Six.", ["One two.", "Three four?"]),
    (T.urls, "see www.x.org/a and https://y.z/b)", ["https://www.x.org/a", "https://y.z/b"]),
    (T.without_thoughts, "<think>a\nb</think> c ", "c"),
    (lambda c: T.tail_words(c, 2), "a b  c", "b c"),
    (T.join_broken_lines, "كتاب ال\nجديد\nabc", "كتاب الجديد abc"),
    (T.document_label, "my_file", "my file"),
    (routing.intent, "hi", "greeting"), (routing.intent, "ok thanks", "acknowledgment"), (routing.intent, "what is the tuition?", "in_scope"),
    (routing.intent, "kill myself", "crisis"), (routing.intent, "you idiot", "offensive"), (routing.intent, "tell me a joke", "out_of_scope"), (routing.intent, "say it in english", "language_switch"), (routing.intent, "lorem ipsum", "out_of_scope"),
    (routing.language_switch, "translate it to arabic", "en"), (routing.language_switch, "in arabic", "ar"), (routing.language_switch, "hello", None),
    (lambda c: C.pack(F.split(c, ","), 3), "a b,c,d e f g,h", ["a b c", "d e f g", "h"]),
    (lambda c: C.merge_small(F.split(c, ","), 2), "a,b c,d,e f", ["a", "b c d", "e f"]),
    (lambda c: C.add_overlap(F.split(c, ","), 1), "a b,c d,e", ["a b", "b c d", "d e"]),
    (lambda c: C.without_repeats(F.split(c, ",")), "a,a,b,a", ["a", "b", "a"]),
    (lambda c: C.semantic_row(F.array(F.lit("Name (x)"), F.lit("Fee"), F.lit("Note")), F.split(c, ",")), "Art,5,-", "Art — Fee: 5"),
    (lambda c: C.semantic_row(F.array(F.lit("Name"), F.lit("Fee")), F.split(c, ",")), "-,5", "Fee: 5"),
    (lambda c: C.semantic_row(F.array(F.lit("Name"), F.lit(" — Fee (EGP) -"), F.lit("()")), F.split(c, ",")), "Art, 5 ,6,7", "Art — Fee: 5، (): 6"),
    (lambda c: C.semantic_row(F.array(F.lit("x (name)"), F.lit("y")), F.split(c, ",")), "Art", "Art"),
    (lambda c: C.semantic_row(F.array(F.lit("x"), F.lit("y")), F.split(c, ",")), "Art,—", "x: Art"),
    (lambda c: C.semantic_row(F.array(F.lit("name"), F.lit("y")), F.split(c, ",")), "-, ", ""),
    (lambda c: C.is_header(F.split(c, ",")), "a,b,c,1,2", True),
])
def test_functions(spark, f, text, want):
    assert value(spark, f, text) == want


def test_hybrid_and_fusion_modes(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue sky"), (4, "")], "id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(7, "red apple", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    index = R.bm25_index(docs)
    assert [r.id for r in R.bm25_search(index, queries, 5).orderBy("rank").collect()][0] == 1
    assert {r.id for r in R.dense_search(vectors, queries, 3).collect()} == {1, 2}
    fused = R.hybrid_search(index, vectors, queries, 3)
    assert fused.orderBy("rank").first().id == 1 and fused.groupBy("id").count().where("count > 1").count() == 0
    assert R.hybrid_search(index, vectors, queries, 3, key_mode="compat").where("id = 1").count() == 2
    assert R.hybrid_rerank_search(index, vectors, queries, docs, 2).orderBy("rank").first().rerank_score == 1.0


def test_history_and_cache(spark):
    turns = spark.createDataFrame([(1, i, f"t{i}", x) for i, x in enumerate(["greeting", "in_scope", "crisis", "greeting", "in_scope"])], "conv_id long, turn long, text string, intent string")
    got = {r.turn: r for r in G.history(turns).collect()}
    assert [x.text for x in got[4].recent] == ["t1", "t2", "t3"] and got[4].last_answer == "t2" and not got[0].has_history
    cache = spark.createDataFrame([("k", "old", 1)], "key string, value string, version int")
    assert G.cache_store(cache, cache.withColumns({"value": F.lit("new"), "version": F.lit(2)})).first().value == "new"


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    head = '<w:pPr><w:pStyle w:val="Heading 2"/></w:pPr>'
    xml = f"<w:document {w}><w:body>{p('Title', head)}{p('Text')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    assert [x[1:] for x in docx_lines(out.getvalue())] == [("heading", 2, "Title", None, None), ("prose", None, "Text", None, None), ("table", None, "a | b", 0, ["a", "b"])]
