"""Rules by an automaton against trying every rule."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from quern.functions import lexicons as lex, routing
from quern.functions.text import java
from quern.operators import rules


@pytest.mark.parametrize("pattern, literals", [
    ("(weather|طقس)", {"weather", "طقس"}), (r"\bjoke\b|نكتة", {"joke", "نكتة"}), ("[?؟]", {"?", "؟"}), (r"[?\d]", None), ("(write.*code|python code)", {"write", "python code"}), (r"ترجم\s*(ل)?\s*عربي", {"ترجم"}),
    ("a?b*", None), ("(ab|c?)d", {"d"}), ("(abc)+x", {"abc"}), ("X(YZ|Q)", {"x"}), (r"\b(in|at) english\b", {" english"}), ("^(ما|كم)", {"ما", "كم"}), ("ما|من", {"م"}), ("(a|)(b|)", None),
])
def test_literals(pattern, literals):
    assert rules.literals_of(pattern) == literals


def brute(rows, text, default="out_of_scope"):
    """Every rule tried in order."""
    words = text.split()
    known = {w for p, _, kind, w, *_ in rows if kind == "every"}
    for _, intent, kind, p, least, most in sorted(rows, key=lambda r: r[:4]):
        if (least and len(words) < least) or (most and len(words) > most):
            continue
        bare = [b for w in words if len(b := w.strip(rules.EDGES)) > 1]
        hit = {"substring": lambda: p in text, "word": lambda: regex.search(java(rf"\b{regex.escape(p)}\b"), text), "regex": lambda: regex.search(java(p), text, regex.I), "every": lambda: bare and all(b in known for b in bare)}[kind]()
        if hit and text:
            return intent
    return default


def test_the_automaton_misses_no_rule():
    rng, rows = random.Random(3), rules.default_rules()
    ready = rules.Rules(rows, "out_of_scope")
    pieces = [*lex.GREETINGS, *lex.ACKNOWLEDGMENTS, *lex.KEYWORDS_AR, *lex.KEYWORDS_EN, "translate it", "in english", "ترجم ل عربي", "kill myself", "damn", "write my code", "كرة قدم", "?", "x", "كلمة", "hello!", "stop"]
    for _ in range(2000):
        text = " ".join(rng.choices(pieces, k=rng.randint(0, 7))).lower()
        assert ready.intent(text) == brute(rows, text), text


def test_patterns_are_tried_only_where_a_literal_fires():
    ready = rules.Rules(rules.default_rules(), "out_of_scope")
    tried = [0]

    class Counting:
        def __init__(self, p):
            self.p = p

        def search(self, text):
            tried[0] += 1
            return self.p.search(text)

    ready.pattern = {i: Counting(p) for i, p in ready.pattern.items()}
    assert ready.intent("lorem ipsum dolor sit amet") == "out_of_scope" and tried[0] <= 4 < len(ready.pattern)


def test_rules_of_a_table(spark):
    messages = spark.createDataFrame([(1, "Say HELLO now", "x"), (2, None, "x"), (3, "  ", "x"), (4, "hello hello hello hello hello", "x"), (5, "both red and blue", "x")], "i int, text string, kind string")
    table = spark.createDataFrame([(2, "greeting", "word", "hello", None, 4), (3, "blue", "regex", "bl.e", None, None), (3, "a red", "substring", "red", None, None)], rules.SCHEMA)
    got = {r.i: r.intent for r in rules.route(messages, table, default="none").collect()}
    assert got == {1: "greeting", 2: "none", 3: "none", 4: "none", 5: "a red"}
    assert {r.intent for r in rules.route(messages, table.where("false")).collect()} == {"out_of_scope"}
    with pytest.raises(ValueError, match="kinds"):
        rules.route(messages, table.withColumn("kind", F.lit("odd")))


def test_equals_the_case_expression(spark):
    texts = ["Hi there", "ok thanks", "ok ok ok ok ok ok ok", "you idiot", "tell me a joke", "ما هي شروط القبول", "كلب", "كلبة", "الكتاب جيد", "أ ب", "can't go on", "Can one swim?", "hi,", "damned"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("want", routing.intent(F.col("text")))
    assert rules.route(df, spark.createDataFrame(rules.default_rules(), rules.SCHEMA)).where("intent <> want").count() == 0
