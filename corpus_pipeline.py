"""Cleaning and mixing a corpus: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import discard, persist, read_table, scratch
from quern.llm.decontaminate import drop_contaminated
from quern.llm.exact_dedup import drop_copies
from quern.llm.mixing import mix
from quern.llm.quality import keep_quality
from quern.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labelled rows of its input.

    A null text is scored as an empty one; rows with a null id are scored but not learned from; of
    repeated rows each is judged, all alike; without labels all stay; an empty table stays empty.
    """
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null texts equal empty ones; a null id is less than any; of repeated rows one stays; an empty table stays empty.
    """
    return drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest doc_id stays.

    Null and wordless texts are near copies of each other; a null id is larger than any; of repeated rows
    that stay one does; an empty table stays empty.
    """
    return drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages in a twentieth of their words or more go.

    Null and wordless texts are clean; each row is judged by its own text, whatever its id; an empty
    table or benchmark leaves all.
    """
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents with the words taken of them, repeats counted.

    Null and wordless texts are never taken; a null source is a source of its own; repeated rows are
    documents of their own; an empty table gives no rows.
    """
    return mix(docs).where("taken > 0")


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", decontaminated), ("mixing", mixed)]

#: A classifier's votes and SimHash fingerprints can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; what a stage keeps is written, and what it wrote beside that deleted."""
    docs = last = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as tables:
            docs = tables.keep(persist(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if name != STAGES[0][0]:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
