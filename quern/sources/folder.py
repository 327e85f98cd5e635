"""A folder of DOCX and PDF files as lines for chunking, with what was skipped and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.functions.text import clean, strip
from quern.operators.corpus import table_sentences
from quern.sources.documents import choose_text, discover, is_image_only, read_docx
from quern.sources.pdf import page_lines, read_pdf, tables_first


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(_name(path), r"\.[^.]+$", "")


def _texts(lines: DataFrame, name: str) -> DataFrame:
    """doc and the lines of each file as one text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"])
    return lines.groupBy("doc").agg(strip(F.array_join(ordered, "\n")).alias(name))


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, files, skipped) of a folder; of files with one stem the DOCX file counts."""
    return parse(discover(spark, folder))


def parse(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, files, skipped) of files (path, ext, content).

    lines: doc (the stem), line_no, kind, body, cleaned; for ``operators.corpus.build_chunks``.
    files: doc, filename, extraction_method of the files that gave lines: ``docx``, or of a PDF file ``blocks``,
    or ``fallback`` where those hold 100 characters at most and tables first hold more.
    skipped: filename, reason: ``failed: ...`` or ``image_only`` of the others.
    Each frame parses the files anew, so write the lines before using them more than once.
    """
    docx, pdf = read_docx(found).withColumnRenamed("path", "doc"), read_pdf(found).withColumnRenamed("path", "doc")
    readable = pdf.where("error is null")
    blocks, tables = page_lines(readable), tables_first(readable)
    candidates = is_image_only(readable).join(_texts(blocks, "blocks"), "doc", "left").join(_texts(tables, "tables"), "doc", "left")
    chosen = candidates.select("doc", choose_text(F.col("image_only"), F.coalesce("blocks", F.lit("")), F.coalesce("tables", F.lit("")))["method"].alias("method"))
    of = lambda lines, method: lines.join(chosen.where(F.col("method") == method).select("doc"), "doc", "left_semi")
    raw = table_sentences(docx.where("kind <> 'failed'")).unionByName(of(blocks, "blocks")).unionByName(of(tables, "fallback"))
    lines = raw.withColumn("body", clean(F.col("body"))).where("body <> ''")
    ways = chosen.where("method in ('blocks', 'fallback')").unionByName(docx.where("kind <> 'failed'").select("doc", F.lit("docx").alias("method")).distinct())
    files = ways.select(_stem(F.col("doc")).alias("doc"), _name(F.col("doc")).alias("filename"), F.col("method").alias("extraction_method"))
    unread = docx.where("kind = 'failed'").select("doc", F.col("body").alias("error")).unionByName(pdf.where("error is not null").select("doc", "error"))
    failed = unread.unionByName(chosen.where("method = 'failed'").select("doc", F.lit("too little text").alias("error")))
    images = chosen.where("method = 'image_only'").select("doc")
    skipped = failed.select(_name(F.col("doc")).alias("filename"), F.concat(F.lit("failed: "), "error").alias("reason")).unionByName(images.select(_name(F.col("doc")).alias("filename"), F.lit("image_only").alias("reason")))
    return lines.withColumn("doc", _stem(F.col("doc"))), files, skipped
