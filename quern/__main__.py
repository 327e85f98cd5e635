"""From a folder of files to answers: ``python -m quern FOLDER STORE QUESTION...``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession, functions as F

from quern.operators import answers as A
from quern.sources import folder, store as S
from quern.sources.shared import stored


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quern", description="Builds a collection from DOCX and PDF files and answers questions from it.")
    parser.add_argument("folder", help="the files")
    parser.add_argument("store", help="where the collection is kept")
    parser.add_argument("questions", nargs="*")
    parser.add_argument("--rebuild", action="store_true", help="build the collection anew")
    parser.add_argument("--literal", help="Parquet rows (id, text, source, section) that complete the collection")
    parser.add_argument("--best", action="store_true", help="answer with the best section instead of the first two")
    parser.add_argument("--no-sources", action="store_true", help="leave the sources out")
    parser.add_argument("--no-cache", action="store_true", help="don't keep answers for the next call")
    parser.add_argument("-k", type=int, default=3, help="sections to look up")
    return parser.parse_args(args)


def run(spark: SparkSession, args: argparse.Namespace) -> list[tuple[str, str]]:
    """(question, what is displayed) of the questions, after building the collection if need be."""
    store = S.Store(spark, args.store)
    if args.rebuild or not store.is_populated("chunks"):
        lines, _, skipped = folder.load(spark, args.folder)
        for r in skipped.collect():  # a row a file that wasn't read
            print(f"skipped {r.filename}: {r.reason}")
        store.write("lines", lines)
        S.build(store, store.read("lines"), spark.read.parquet(args.literal) if args.literal else None, rebuild=args.rebuild)
    if not args.questions:
        return []
    asked = spark.createDataFrame(list(enumerate(args.questions)), "query_id long, text string").withColumns({"recent": F.array().cast(A.EXCHANGES), "seq": F.col("query_id")})
    search = S.searcher(store, args.k)
    if args.best:
        found = stored(A.answer_in_order(asked, search, cache=store.read("answers") if store.versions("answers") and not args.no_cache else None), "answers")
        if not args.no_cache:
            store.upsert("answers", A.cache_entries(found, int(time.time())), key="key")
    else:
        found = A.retrieval_answer(asked, search)
    shown = A.format_answer(found, not args.no_sources).orderBy("query_id").collect()  # a row a question
    return list(zip(args.questions, [r.display for r in shown], strict=True))


if __name__ == "__main__":
    session = SparkSession.builder.appName("quern").getOrCreate()
    for question, display in run(session, arguments()):
        print(f"{question}\n{display}\n")
    session.stop()
