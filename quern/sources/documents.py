"""Document files as rows: discovery, DOCX paragraphs and tables, and the choice of a PDF's text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LINES = "path string, line_no int, kind string, level int, body string, table_no int, cells array<string>"
HEADING = re.compile(r"^(?:heading\s*|عنوان\s*)?([1-6])$", re.I)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, stem, ext, content of PDF and DOCX files; of equal stems the DOCX file; no lock files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,docx}").load(folder)
    name = F.substring_index("path", "/", -1)
    parts = files.select("path", F.regexp_extract(name, r"^(.*)\.[^.]+$", 1).alias("stem"), F.lower(F.substring_index(name, ".", -1)).alias("ext"), "content").where(~name.startswith("~$"))
    better = parts.where("ext = 'docx'").select("stem").distinct()
    return parts.where("ext = 'docx'").unionByName(parts.where("ext = 'pdf'").join(better, "stem", "left_anti").select(parts.columns))


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{NS}t"))


def docx_lines(content: bytes) -> Iterator[tuple]:
    """(line_no, kind, level, body, table_no, cells) of a DOCX file in document order.

    A table gives a line a row, its cells joined by `` | `` in the body; other lines have no cells.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{NS}body")
    n = tables = 0
    for node in body if body is not None else ():
        if node.tag == f"{NS}p":
            style = node.find(f"{NS}pPr/{NS}pStyle")
            level = HEADING.match(style.get(f"{NS}val", "").strip()) if style is not None else None
            if text := _text(node).strip():
                yield n, "heading" if level else "prose", int(level[1]) if level else None, text, None, None
                n += 1
        elif node.tag == f"{NS}tbl":
            for row in node.iter(f"{NS}tr"):
                cells = [" ".join(filter(None, (_text(p).strip() for p in c.iter(f"{NS}p")))) for c in row.iter(f"{NS}tc")]
                yield n, "table", None, " | ".join(cells), tables, cells
                n += 1
            tables += 1


def read_docx(files: DataFrame) -> DataFrame:
    """Tagged lines of DOCX files; a file that can't be read gives one row of kind ``failed``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, *x) for x in docx_lines(content)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    rows = [(path, 0, "failed", None, str(e), None, None)]
                yield pd.DataFrame(rows, columns=["path", "line_no", "kind", "level", "body", "table_no", "cells"]).astype({"level": "Int32", "table_no": "Int32"})

    return files.where("ext = 'docx'").select("path", "content").mapInPandas(parse, LINES)


def is_image_only(blocks: DataFrame, min_chars: int = 50) -> DataFrame:
    """doc, image_only: whether a document's pages hold fewer than so many characters."""
    return blocks.groupBy("doc").agg((F.coalesce(F.sum(F.length(F.trim("text"))), F.lit(0)) < min_chars).alias("image_only"))


def choose_text(image_only: Column, blocks: Column, fallback: Column, min_chars: int = 100) -> Column:
    """struct(text, method): the first candidate of more than so many characters."""
    pick = lambda text, method: F.struct(text.alias("text"), F.lit(method).alias("method"))
    return F.when(image_only, pick(F.lit(""), "image_only")).when(F.length(blocks) > min_chars, pick(blocks, "blocks")).when(F.length(fallback) > min_chars, pick(fallback, "fallback")).otherwise(pick(F.lit(""), "failed"))
