"""Answers to batches of questions: search, cache, model, fallback, and their display.

``search`` takes (query_id, text) rows and gives hits (query_id, rank, text, source, section); a
model is a column function of messages, which may be a Pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import text as T
from quern.operators import conversation as G
from quern.sources.shared import stored

Search = Callable[[DataFrame], DataFrame]
#: Replies by language, ``ar`` and ``en``.
APOLOGY = {"en": "No answer was found.", "ar": "لم أجد إجابة."}
LEAD = {"en": "Based on available information:", "ar": "بناء على المعلومات المتاحة:"}
SYSTEM = {"en": "Answer from the context only.", "ar": "أجب من السياق فقط."}
EXCHANGES = "array<struct<user:string,assistant:string>>"


def by_language(texts: dict[str, str], language: str = "language") -> Column:
    return F.when(F.col(language) == "ar", texts["ar"]).otherwise(texts["en"])


def search_twice(questions: DataFrame, search: Search) -> DataFrame:
    """Hits of the questions with Arabic dialect normalized; of those without any hit, as they were put. They are written once, with their texts."""
    c = F.col("text")
    plain = questions.select("query_id", "text", F.when(T.language(c) == "ar", T.normalize_dialect(c)).otherwise(c).alias("plain"))
    hits = stored(search(plain.select("query_id", F.col("plain").alias("text"))), "plain-hits")
    missed = plain.where("plain <> text").join(hits.select("query_id"), "query_id", "left_anti")
    return hits.unionByName(stored(search(missed.select("query_id", "text")), "put-hits"))


def _per_query(questions: DataFrame, hits: DataFrame) -> DataFrame:
    best = hits.groupBy("query_id").agg(F.min_by(F.struct("text", "source"), "rank").alias("top"), F.count("*").alias("n"))
    told = questions.withColumn("language", T.language(F.col("text"))).join(best, "query_id", "left").join(G.sources(hits), "query_id", "left")
    return told.withColumn("chunks_found", F.coalesce("n", F.lit(0))).drop("n")


def retrieval_answer(questions: DataFrame, search: Search, shown: int = 2) -> DataFrame:
    """query_id, answer, sources, language, chunks_found without a model: the first hits' texts."""
    hits = search_twice(questions.select("query_id", "text"), search)
    texts = hits.where(F.col("rank") <= shown).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    rows = _per_query(questions, hits).join(texts, "query_id", "left")
    answer = F.when(F.col("body").isNull(), by_language(APOLOGY)).otherwise(T.strip(F.concat_ws("\n\n", by_language(LEAD), "body")))
    return rows.select("query_id", answer.alias("answer"), "sources", "language", "chunks_found")


def answer(questions: DataFrame, search: Search, generate: Callable[[Column], Column] | None = None, cache: DataFrame | None = None) -> DataFrame:
    """query_id, answer, sources, language, chunks_found, cached, key of questions (query_id, text, recent).

    ``recent`` holds the exchanges before (none or null: no history). Questions without a history and
    with hits are looked up in ``cache`` (key, value) by the question and its first hit; only the others
    meet the model. An answer that is missing, short or an error gives way to the first hit with its
    source, or to an apology. ``key`` is null where an answer isn't for the cache.
    """
    keyed = _keyed(questions, search)
    known = keyed.join(cache.select("key", "value"), "key", "left") if cache is not None else keyed.withColumn("value", F.lit(None).cast("string"))
    return _said(known.where("value is null"), generate).unionByName(_told(known.where("value is not null")))


def _keyed(questions: DataFrame, search: Search) -> DataFrame:
    """The questions with their hits' first text, context and sources, and the key where an answer is for the cache."""
    hits = search_twice(questions.select("query_id", "text"), search)
    rows = _per_query(questions, hits).join(G.build_context(hits), "query_id", "left")
    recent = F.coalesce(F.slice("recent", F.greatest(F.size("recent") - 2, F.lit(1)), 3), F.array().cast(EXCHANGES))
    return rows.withColumn("recent", recent).withColumn("key", F.when((F.col("chunks_found") > 0) & (F.size("recent") == 0), T.cache_key(F.col("text"), F.col("top.text"))))


_ANSWER = ("query_id", "answer", "sources", "language", "chunks_found", "cached", "key")


def _said(rows: DataFrame, generate: Callable[[Column], Column] | None) -> DataFrame:
    """What the model says, or what stands in for it."""
    prompt = F.concat_ws("\n\n", F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit(""))), F.concat(F.lit("Question: "), F.col("text")))
    said = generate(G.messages(by_language(SYSTEM), F.col("recent"), prompt)) if generate else F.lit(None).cast("string")
    first = F.when(F.col("top").isNull(), by_language(APOLOGY)).otherwise(F.concat_ws("\n", "top.text", F.concat(F.lit("Source: "), F.col("top.source"))))
    fresh = rows.withColumn("said", T.without_thoughts(said)).withColumn("answer", F.when(G.needs_fallback(F.col("said")), first).otherwise(F.col("said")))
    return fresh.withColumn("cached", F.lit(False)).select(*_ANSWER)


def _told(rows: DataFrame) -> DataFrame:
    return rows.withColumn("answer", F.col("value")).withColumn("cached", F.lit(True)).select(*_ANSWER)


#: Keys of a batch that may be broadcast as hot ones.
HOT_KEYS = 2_000


def answer_in_order(questions: DataFrame, search: Search, generate: Callable[[Column], Column] | None = None, cache: DataFrame | None = None) -> DataFrame:
    """As ``answer``, with a cache that the batch fills for itself: questions (query_id, seq, text, recent) come in the order of seq.

    A question sees what was in ``cache`` and the answers to earlier questions of the batch, so of equal ones only
    the first meets the model, and those after it are told its answer. Questions of a seq come by query_id; a null seq first. A question
    that is asked very often isn't gathered: the first of each key is an aggregate, and the answers to hot keys are broadcast.
    """
    keyed = stored(_keyed(questions, search), "keyed")
    firsts = keyed.where("key is not null").groupBy("key").agg(F.min(F.struct("seq", "query_id")).alias("_first"), F.count("*").alias("_n"))
    known = firsts.join(cache.select("key", "value"), "key", "left") if cache is not None else firsts.withColumn("value", F.lit(None).cast("string"))
    known = stored(known.withColumnRenamed("key", "_key"), "firsts")
    told = _by_key(keyed.where("key is not null"), known)
    is_first = F.col("value").isNull() & (F.struct("seq", "query_id") == F.col("_first"))
    alone = keyed.where("key is null").select(*keyed.columns)
    asked = stored(_said(told.where(is_first).select(*keyed.columns).unionByName(alone), generate), "said")
    values = asked.where("key is not null").select(F.col("key").alias("_key"), F.col("answer").alias("_value"))
    values = stored(known.join(values, "_key", "left").withColumn("value", F.coalesce("value", "_value")).drop("_value"), "values")
    later = told.where(~is_first).drop("_key", "_first", "_n", "value")
    return asked.unionByName(_told(_by_key(later, values)))


def _by_key(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the table's row of their key; those of keys with more than 1 / HOT_KEYS of all rows, HOT_KEYS at most, aren't shuffled."""
    total = table.agg(F.sum("_n")).first()[0] or 0
    hot, same = F.col("_n") > total / HOT_KEYS, F.col("key") == F.col("_key")
    rest = rows.join(F.broadcast(table.where(hot).select("_key")), same, "left_anti")
    return rows.join(F.broadcast(table.where(hot)), same).unionByName(rest.join(table.where(~hot), same))


def cache_entries(answers: DataFrame, version: int) -> DataFrame:
    """key, value, version of the answers that go to the cache; of equal keys one."""
    return answers.where("key is not null and not cached").groupBy("key").agg(F.min("answer").alias("value")).withColumn("version", F.lit(version))


def format_answer(answers: DataFrame, show_sources: bool = True) -> DataFrame:
    """query_id, display: the answer, its sources, and how many sections were found."""
    cached = F.when(F.col("cached"), " (cached)").otherwise("") if "cached" in answers.columns else F.lit("")
    found = F.when(F.col("chunks_found") > 0, F.concat(F.lit("[Retrieved "), F.col("chunks_found").cast("string"), F.lit(" relevant sections"), cached, F.lit("]")))
    return answers.select("query_id", F.concat_ws("\n", "answer", F.nullif("sources", F.lit("")) if show_sources else F.lit(None).cast("string"), found).alias("display"))
