"""Chunks from lines, sentences and semantic units, and the rows of tables and page layouts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quern.functions import lexicons as lex
from quern.functions.text import cosine, join_broken_lines, let, sentences, strip, tail_words, words
from quern.operators.scans import SORTED, exact_percentile, scan
from quern.sources.shared import stored

#: Words of a chunk at most and at least, and of an overlap; characters that a chunk must exceed.
MAX_WORDS, MIN_WORDS, OVERLAP, MIN_CHARS = 150, 40, 30, 40
PERCENTILE = 0.3


def chunk_fixed(text: Column, size: int = 500, overlap: int = 50, min_chars: int = 30) -> Column:
    """Windows of ``size`` words that overlap; those of more than ``min_chars`` characters."""

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size - overlap))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))

    return F.filter(let(words(text), windows), lambda x: F.length(x) > min_chars)


def counted(units: Column) -> Column:
    """Units as structs with their number of words."""
    return F.transform(units, lambda u: F.struct(u.alias("text"), F.size(words(u)).alias("n")))


def pack(units: Column, max_words: int, mark: str = " ") -> Column:
    """Units joined greedily by ``mark`` up to ``max_words``; a longer one stands alone."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(s: Column, u: Column) -> Column:
        full = (s["n"] > 0) & (s["n"] + u["n"] > max_words)
        return F.struct(
            F.when(full, F.array_append(s["done"], s["open"])).otherwise(s["done"]).alias("done"),
            F.when(full | (s["n"] == 0), u["text"]).otherwise(F.concat_ws(mark, s["open"], u["text"])).alias("open"),
            F.when(full, u["n"]).otherwise(s["n"] + u["n"]).alias("n"),
        )

    return F.aggregate(counted(units), state, step, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def merge_small(chunks: Column, min_words: int) -> Column:
    """Chunks of fewer words are appended to the one before; the first stays."""

    def step(s: Column, c: Column) -> Column:
        small = (F.size(s) > 0) & (F.size(words(c)) < min_words)
        last = F.concat_ws(" ", F.element_at(s, -1), c)
        return F.when(small, F.concat(F.slice(s, 1, F.size(s) - 1), F.array(last))).otherwise(F.array_append(s, c))

    return F.aggregate(chunks, F.array().cast("array<string>"), step)


def add_overlap(chunks: Column, n: int) -> Column:
    """Each chunk but the first begins with the last n words of the one before."""
    return let(chunks, lambda cs: F.transform(cs, lambda c, i: F.when(i == 0, c).otherwise(F.concat_ws(" ", tail_words(F.get(cs, i - 1), n), c))))


def chunk_sentences(text: Column, max_words: int = 200, overlap: int = 40, min_chars: int = MIN_CHARS) -> Column:
    """Sentences packed greedily; a chunk begins with the whole sentences before it that fit the overlap."""
    kind = "array<struct<text:string,n:int>>"
    pile = lambda xs, n: F.struct(xs.alias("xs"), n.alias("n"))
    none = pile(F.array().cast(kind), F.lit(0))

    def tail(xs: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            fits = s["on"] & (s["n"] + x["n"] <= overlap)
            return F.struct(F.when(fits, F.array_prepend(s["xs"], x)).otherwise(s["xs"]).alias("xs"), F.when(fits, s["n"] + x["n"]).otherwise(s["n"]).alias("n"), fits.alias("on"))

        return F.aggregate(F.reverse(xs), F.struct(F.array().cast(kind).alias("xs"), F.lit(0).alias("n"), F.lit(True).alias("on")), step)

    def step(s: Column, x: Column) -> Column:
        piled, alone = s["open"], x["n"] > max_words
        full = (F.size(piled["xs"]) > 0) & (piled["n"] + x["n"] > max_words)
        flushed = F.when((full | alone) & (F.size(piled["xs"]) > 0), F.array_append(s["done"], piled["xs"])).otherwise(s["done"])
        grown = F.when(alone, none).when(full, let(tail(piled["xs"]), lambda t: pile(F.array_append(t["xs"], x), t["n"] + x["n"]))).otherwise(pile(F.array_append(piled["xs"], x), piled["n"] + x["n"]))
        return F.struct(F.when(alone, F.array_append(flushed, F.array(x))).otherwise(flushed).alias("done"), grown.alias("open"))

    state = F.struct(F.array().cast(f"array<{kind}>").alias("done"), none.alias("open"))
    packed = F.aggregate(counted(sentences(text)), state, step, lambda s: F.when(F.size(s["open"]["xs"]) > 0, F.array_append(s["done"], s["open"]["xs"])).otherwise(s["done"]))
    return F.filter(F.transform(packed, lambda xs: F.array_join(F.transform(xs, lambda x: x["text"]), " ")), lambda c: F.length(c) > min_chars)


def semantic_groups(units: DataFrame, percentile: float = PERCENTILE, run: str = "run", ranges: int | None = None) -> DataFrame:
    """units (run, unit, embedding) with sim to the next unit, the run's threshold and the group.

    A group ends where the similarity to the next unit is strictly below the run's percentile. With ``ranges`` runs may be of
    any size: they are scanned in so many ranges, and the percentile is found by passes of histograms.
    """
    if ranges:
        sims = scan(units, [run], ["unit"], after={"next": F.col("embedding")}, parts=ranges)
        sims = stored(sims.withColumn("sim", cosine(F.col("embedding"), F.col("next"))).drop("next"), "sims")
        limits = exact_percentile(sims, run, "sim", percentile, "threshold", SORTED)
        flag = F.coalesce(F.col("sim") < F.col("threshold"), F.lit(False)).cast("int")
        return scan(_with_limits(sims, limits, run), [run], ["unit"], total={"group": flag}, parts=ranges).withColumn("group", F.col("group") - flag)
    by = W.partitionBy(run).orderBy("unit")
    sims = units.withColumn("sim", cosine(F.col("embedding"), F.lead("embedding").over(by)))
    joined = sims.withColumn("threshold", F.percentile("sim", F.lit(percentile)).over(W.partitionBy(run)))  # of the same shuffle
    breaks = F.coalesce((F.lag("sim").over(by) < F.col("threshold")).cast("int"), F.lit(0))
    return joined.withColumn("breaks", breaks).withColumn("group", F.sum("breaks").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("breaks")


def _with_limits(rows: DataFrame, limits: DataFrame, run: str) -> DataFrame:
    """Rows with their run's threshold; those of large runs, which are few, aren't shuffled."""
    limits = stored(limits.withColumnRenamed(run, "_run").join(rows.groupBy(F.col(run).alias("_r")).agg(F.count("*").alias("_n")), F.col("_run").eqNullSafe(F.col("_r"))).drop("_r"), "limits")
    same, large = F.col(run).eqNullSafe(F.col("_run")), limits.where(F.col("_n") > SORTED)  # rows / SORTED at most
    rest = rows.join(F.broadcast(large.select("_run")), same, "left_anti").join(limits.where(F.col("_n") <= SORTED), same, "left")
    return rows.join(F.broadcast(large), same).unionByName(rest).drop("_run", "_n")


def begins(batches: Iterator[pa.RecordBatch], run: str, max_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (run, group, n, ...) in the order of runs, groups and units, with begin: 1 where ``pack`` opens a chunk."""
    at, size = None, 0
    for batch in batches:
        out = []
        for here in zip(*(batch.column(c).to_pylist() for c in (run, "group", "n"))):
            begin = here[:2] != at or size + here[2] > max_words
            at, size = here[:2], here[2] if begin else size + here[2]
            out.append(int(begin))
        yield batch.append_column("begin", pa.array(out, pa.int64()))


def semantic_chunks(units: DataFrame, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS, overlap: int = OVERLAP, min_chars: int = MIN_CHARS, run: str = "run", large: bool = False) -> DataFrame:
    """run, chunk_index, text from units with text and embedding; a run of one unit stays as it is.

    Units are trimmed, and blank ones left out. With ``large`` runs may be of any size: a unit's chunk is found from counts of words
    alone, and no row holds more than a chunk's text; otherwise a row holds a run's.
    """
    units = units.withColumn("text", strip(F.col("text"))).where("text <> ''")
    if large:
        return _chunks_of_large_runs(units, max_words, min_words, overlap, min_chars, run)
    grouped = semantic_groups(units, run=run).groupBy(run, "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "text"))), lambda x: x["text"]).alias("texts"))
    per_run = grouped.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("group", "texts"))).alias("gs"), F.sum(F.size("texts")).alias("n"))
    split = F.flatten(F.transform("gs", lambda g: pack(g["texts"], max_words)))
    whole = F.flatten(F.transform("gs", lambda g: g["texts"]))
    rest = F.filter(add_overlap(merge_small(split, min_words), overlap), lambda c: F.length(strip(c)) > min_chars)
    return per_run.select(run, F.posexplode(F.when(F.col("n") <= 1, whole).otherwise(rest)).alias("chunk_index", "text"))


def _chunks_of_large_runs(units: DataFrame, max_words: int, min_words: int, overlap: int, min_chars: int, run: str) -> DataFrame:
    """``semantic_chunks`` of trimmed units; the windows by run hold vectors, numbers and tails, no texts."""
    rows = stored(units.select(run, "unit", "text", "embedding", F.size(words(F.col("text"))).alias("n"), F.monotonically_increasing_id().alias("row")), "units")
    grouped = semantic_groups(rows.drop("text"), run=run).select(run, "unit", "row", "n", "group").repartition(run, "group").sortWithinPartitions(run, "group", "unit", "row")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.schema)
    begun = grouped.mapInArrow(lambda batches: begins(batches, run, max_words), f"{kinds}, begin long")
    order = W.partitionBy(run).orderBy("unit", "row")
    split = begun.withColumn("split", F.sum("begin").over(order)).withColumn("size", F.sum("n").over(W.partitionBy(run, "split")))
    opens = (F.col("begin") == 1) & ((F.col("size") >= min_words) | (F.col("split") == 1))  # as merge_small, the first stays
    placed = split.withColumn("chunk", F.sum(opens.cast("long")).over(order)).select("row", F.col(run).alias("_run"), "chunk")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "row", "text"))), lambda x: x["text"]), " ")
    chunks = rows.select("row", "unit", "text").join(placed, "row").groupBy("_run", "chunk").agg(joined.alias("text"), F.count("*").alias("units"))
    chunks = stored(chunks.withColumn("tail", tail_words(F.col("text"), overlap)).withColumn("chars", F.length("text")), "chunks")
    by = W.partitionBy("_run").orderBy("chunk")
    sized = chunks.select("_run", "chunk", "chars", F.lag("tail").over(by).alias("before"), (F.sum("units").over(W.partitionBy("_run")) <= 1).alias("alone"))
    kept = sized.where(F.col("alone") | (F.col("chars") + F.coalesce(F.length("before") + 1, F.lit(0)) > min_chars))
    numbered = kept.select(F.col("_run").alias("_r"), F.col("chunk").alias("_c"), "before", (F.row_number().over(by) - 1).alias("chunk_index"))
    same = F.col("_run").eqNullSafe(F.col("_r")) & (F.col("chunk") == F.col("_c"))
    return chunks.join(numbered, same).select(F.col("_run").alias(run), "chunk_index", F.concat_ws(" ", "before", "text").alias("text"))


def qa_units(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """Units of lines (doc, line_no, body): each begins at a question mark line, answers are glued to it."""
    by = W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    island = F.sum(F.col("body").rlike(r"(?i)^(س:|Q:)").cast("int")).over(by)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]), " ")
    return lines.withColumn("unit", island).groupBy(doc, "unit").agg(joined.alias("text"))


def structure_runs(lines: DataFrame, doc: str = "doc", ranges: int | None = None) -> DataFrame:
    """lines (doc, line_no, kind, body) with their heading and the number of their run.

    A run is a stretch of table or prose lines under one heading. With ``ranges`` documents may be of any size: they are scanned in so many ranges.
    """
    if ranges:
        heading = F.when(F.col("kind") == "heading", F.col("body"))
        runs = {"run": (F.col("kind"), F.col("kind") != "heading")}  # a line after a heading differs from it
        return scan(lines, [doc], ["line_no"], last={"heading": heading}, starts=runs, parts=ranges).where("kind <> 'heading'")
    by = W.partitionBy(doc).orderBy("line_no")
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    tagged = lines.withColumn("heading", F.last(F.when(F.col("kind") == "heading", F.col("body")), ignorenulls=True).over(upto)).withColumn("heads", F.sum((F.col("kind") == "heading").cast("int")).over(upto)).where("kind <> 'heading'")
    changed = F.coalesce(((F.lag("kind").over(by) != F.col("kind")) | (F.lag("heads").over(by) != F.col("heads"))).cast("int"), F.lit(1))
    return tagged.withColumn("changed", changed).withColumn("run", F.sum("changed").over(upto)).drop("changed", "heads")


def assign_ids(chunks: DataFrame, doc: str = "doc") -> DataFrame:
    """id (<doc>_<i>), chunk_index and total_chunks, by the order of seq within a document."""
    index = F.row_number().over(W.partitionBy(doc).orderBy("seq")) - 1
    return chunks.withColumn("chunk_index", index).withColumn("total_chunks", F.count("*").over(W.partitionBy(doc))).withColumn("id", F.concat_ws("_", doc, "chunk_index"))


def forward_fill(cells: DataFrame, placeholders=lex.PLACEHOLDERS, ranges: int | None = None) -> DataFrame:
    """cells (doc, table_no, row_no, col_no, cell), trimmed: placeholders take the value above; without one they stay.

    With ``ranges`` columns may be of any size: they are scanned in so many ranges.
    """
    if ranges:
        bare = strip(F.col("cell"))
        filled = scan(cells, ["doc", "table_no", "col_no"], ["row_no"], last={"_above": F.when(~bare.isin(*placeholders), bare)}, parts=ranges)
        return filled.withColumn("cell", F.coalesce("_above", bare)).drop("_above")
    by = W.partitionBy("doc", "table_no", "col_no").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    bare = strip(F.col("cell"))
    real = F.when(~bare.isin(*placeholders), bare)
    return cells.withColumn("cell", F.coalesce(F.last(real, ignorenulls=True).over(by), bare))


def is_header(row: Column) -> Column:
    """Whether three fifths of a row's cells are neither blank nor hold a digit."""
    return F.size(F.filter(row, lambda x: (strip(x) != "") & ~x.rlike(r"\p{Nd}"))) >= 0.6 * F.size(row)


def fit_row(row: Column, width: Column) -> Column:
    """A row padded with blanks or cut to a width."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))), F.lit(1), width)


def without_repeats(row: Column) -> Column:
    """Without cells equal to the one before, as merged cells repeat."""
    return F.filter(F.transform(row, lambda x, i: F.when((i == 0) | (x != F.get(row, i - 1)), x)), lambda x: x.isNotNull())


def semantic_row(headers: Column, row: Column, names=lex.NAME_COLUMNS, placeholders=lex.PLACEHOLDERS) -> Column:
    """A row as a sentence: the name column as title, the other cells as ``header: value``.

    A title that is a placeholder is none. Brackets in headers are left out of what is said; cells
    without a header of their own aren't said.
    """
    bare = F.transform(headers, lambda h: F.regexp_replace(F.regexp_replace(strip(h), r"\([^)]+\)", ""), "^[ —-]+|[ —-]+$", ""))
    pairs = F.zip_with(bare, F.slice(row, F.lit(1), F.size(headers)), lambda h, v: F.struct(h.alias("h"), strip(v).alias("v")))
    first, title = strip(F.lower(F.get(headers, F.lit(0)))), strip(F.get(row, F.lit(0)))
    named = F.exists(F.array(*[F.lit(x) for x in names]), lambda n: F.contains(first, n))
    titled = F.coalesce(named & ~title.isin(*placeholders), F.lit(False))
    kept = F.filter(F.slice(pairs, F.when(titled, 2).otherwise(1), F.size(pairs)), lambda p: ~p["v"].isin(*placeholders))
    rest = F.array_join(F.transform(kept, lambda p: F.when(p["h"] != "", F.concat_ws(": ", p["h"], p["v"])).otherwise(p["v"])), "، ")
    return F.when(titled, F.concat_ws(" — ", title, F.nullif(rest, F.lit("")))).otherwise(rest)


def layout_lines(blocks: DataFrame, step: float = 15) -> DataFrame:
    """doc, page, y, text: blocks of equal rounded height as a row, cells from left to right."""
    y = F.bround(F.col("y0") / step) * step
    cells = blocks.withColumn("text", join_broken_lines(F.col("text"))).where(F.length("text") > 1)
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " | ")
    return cells.groupBy("doc", "page", y.alias("y")).agg(row.alias("text"))
