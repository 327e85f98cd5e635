"""From lines of documents to enriched, embedded chunks.

Lines (doc, line_no, kind, body) of kind heading, table or prose come from ``sources`` or from
``tagged_lines``. A third of all lines may belong to one document: only the chunks of one run (the
prose under one heading between tables) meet in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quern.functions import text as T
from quern.operators import chunking as C
from quern.sources.shared import stored

#: Width of the hashed vectors that stand in for a model's.
DIMENSION = 256
QUESTION, MARKER = r"(?i)^(س:|Q:)", r"(?im)^(س:|ج:|Q:|A:)"


def encode(rows: DataFrame, text: str = "text", out: str = "embedding", dimension: int = DIMENSION) -> DataFrame:
    """rows with unit vectors of hashed token counts (zero without tokens): an offline stand-in for a model."""
    tokens = rows.withColumn("_tokens", F.coalesce(T.tokenize(F.col(text)), F.array().cast("array<string>")))
    counts = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dimension).transform(tokens)
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counts)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_counts", "_unit")


def tagged_lines(texts: DataFrame) -> DataFrame:
    """doc, line_no, kind, body of texts (doc, text) whose lines may bear ``[H1]`` to ``[H6]`` or ``[TABLE]``.

    Blank lines and null texts give no rows; a table row without a text still ends the prose before it.
    """
    line = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(T.strip(F.col("line")) != "")
    c, head, row = F.col("line"), r"^\[H[1-6]\]\s*", r"^\[TABLE\] "
    kind = F.when(c.rlike(head), "heading").when(c.rlike(row), "table").otherwise("prose")
    body = F.when(kind == "prose", c).otherwise(T.strip(F.regexp_replace(c, f"{head}|{row}", "")))
    return line.select("doc", "line_no", kind.alias("kind"), body.alias("body"))


def table_sentences(lines: DataFrame) -> DataFrame:
    """Lines of ``sources.read_docx`` (doc for path) with each table row as a sentence.

    Under a header row each further row names its cells, placeholders filled from above; a table
    without one keeps its rows, cells joined by `` | ``, as prose. Rows fit the first row's width.
    """
    rows = lines.where("kind = 'table' and size(cells) > 0").withColumn("cells", C.without_repeats(F.col("cells")))
    table = W.partitionBy("doc", "table_no")
    first = F.min_by("cells", "line_no").over(table)
    known = rows.withColumn("first", first).withColumn("headed", C.is_header(F.col("first")) & (F.count("*").over(table) > 1) & (F.size("first") > 0))
    body = known.withColumn("top", F.min("line_no").over(table)).where("not headed or line_no > top")
    cells = body.select("doc", "table_no", "line_no", "headed", "first", F.posexplode(C.fit_row(F.col("cells"), F.size("first"))).alias("col_no", "cell")).withColumnRenamed("line_no", "row_no")
    filled = C.forward_fill(cells).groupBy("doc", "row_no").agg(F.first("headed").alias("headed"), F.first("first").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda x: x["cell"]).alias("row"))
    joined = F.array_join(F.filter("row", lambda x: T.strip(x) != ""), " | ")
    said = filled.select("doc", F.col("row_no").alias("line_no"), F.when(F.col("headed"), "table").otherwise("prose").alias("kind"), F.when(F.col("headed"), C.semantic_row(F.col("first"), F.col("row"))).otherwise(joined).alias("body")).where("body <> ''")
    return lines.where("kind in ('heading', 'prose')").select("doc", "line_no", "kind", "body").unionByName(said)


def qa_or_sentences(lines: Column) -> Column:
    """Units of a run's lines: questions with their answers where any are marked, else sentences."""
    text = F.array_join(lines, "\n")

    def step(units: Column, x: Column) -> Column:
        opens = x.rlike(QUESTION) | (F.size(units) == 0)
        glued = F.concat(F.slice(units, 1, F.size(units) - 1), F.array(F.concat_ws(" ", F.element_at(units, -1), x)))
        return F.when(opens, F.array_append(units, x)).otherwise(glued)

    pairs = F.aggregate(F.transform(lines, T.strip), F.array().cast("array<string>"), step)
    return F.when(text.rlike(MARKER), F.filter(pairs, lambda u: F.length(u) > 5)).otherwise(T.sentences(text))


def build_chunks(lines: DataFrame, encoder: Callable[[DataFrame], DataFrame] = encode, max_words: int = C.MAX_WORDS, min_words: int = C.MIN_WORDS, overlap: int = C.OVERLAP, min_chars: int = C.MIN_CHARS) -> DataFrame:
    """id, doc, chunk_index, total_chunks, kind, text: chunks of lines (doc, line_no, kind, body).

    Prose under a heading is grouped by topic; table rows of one title are packed whole. Each chunk
    begins with its heading unless it holds it. ``encoder`` adds ``embedding`` to rows with ``text``.
    """
    runs = stored(C.structure_runs(lines.where("body is not null")).withColumn("run", F.struct("doc", "run", "heading")), "runs")  # a run has one heading; prose and tables read it
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]).alias(c)
    prose = runs.where("kind = 'prose'").groupBy("run").agg(ordered("lines"))
    units = prose.select("run", F.posexplode(qa_or_sentences(F.col("lines"))).alias("unit", "text"))
    topics = C.semantic_chunks(encoder(units), max_words, min_words, overlap, min_chars).select("run", F.lit(0).alias("part"), "chunk_index", "text", F.lit("prose").alias("kind"))

    by = W.partitionBy("run").orderBy("line_no")
    titled = runs.where("kind = 'table' and body <> ''").withColumn("title", T.row_title(F.col("body")))
    changed = F.coalesce((F.lag("title").over(by) != F.col("title")).cast("int"), F.lit(0))
    parts = titled.withColumn("changed", changed).withColumn("part", F.sum("changed").over(by).cast("int"))
    packed = parts.groupBy("run", "part").agg(ordered("rows"))
    tables = packed.select("run", "part", F.posexplode(C.pack(F.col("rows"), max_words, "\n")).alias("chunk_index", "text"), F.lit("table").alias("kind"))

    whole = topics.unionByName(tables).withColumn("text", T.with_heading(T.strip(F.col("text")), F.col("run.heading"))).where(F.length(T.strip(F.col("text"))) > min_chars)
    numbered = whole.select(F.col("run.doc").alias("doc"), F.struct("run.run", "part", "chunk_index").alias("seq"), "kind", "text")
    return C.assign_ids(numbered).select("id", "doc", "chunk_index", "total_chunks", "kind", "text")


def enrich(chunks: DataFrame) -> DataFrame:
    """chunks (doc, kind, text) with source, section, chunk_type, language, has_url, word_count and letters."""
    c = F.col("text")
    return chunks.withColumns({
        "source": T.document_label(F.col("doc").cast("string")), "section": T.section(c), "chunk_type": T.chunk_type(c, F.col("kind")), "language": T.chunk_language(c),
        "has_url": T.has_url(c), "word_count": F.size(T.words(c)), "arabic_letters": T.n_matches(c, T.ARABIC), "latin_letters": T.n_matches(c, "A-Za-z"),
    })
