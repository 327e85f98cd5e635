"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Every document gets a key that is random but repeatable (a digest of seed, id and text). Within a
source the keys are range-partitioned by their leading digits - uniform, so the ranges of a hot
source are as even as any - and prefix sums of token counts run in two steps: over the ranges of
a source, then inside a range. A source's budget is whole epochs plus a rest; the rest is cut
exactly where the prefix sum reaches it, inside a document if need be.

Targets: sources ordered by code point (null last) weigh 1, 2, 3, repeating, and share the total
size; a source's target stops at ``max_epochs`` times its size and the excess is reshared by
weight until none is above (the closed form of that filling).

Defined cases: a null text has size 0; documents of size 0 are taken 0 times; a null source is a
source of its own; repeated rows are separate documents; an empty table gives no rows; columns other
than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quern.llm.common import persist

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of a key that name its range: 4096 ranges a source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """source, source_size, target: one row per source, from (source, source_size).

    The window below spans one row per source, not per document.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    by_fill = W.orderBy(F.col("fill"), F.col("rank"))
    upto, onward, all_rows = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    rows = (
        sizes.withColumn("rank", rank)
        .withColumn("weight", (F.col("rank") - 1) % 3 + 1)
        .withColumn("limit", F.col("source_size") * max_epochs)
        .withColumn("fill", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("filled", F.coalesce(F.sum("limit").over(upto), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(onward))
        .withColumn("open", (wide("total") - wide("filled")) * wide("weight") <= wide("limit") * wide("weights"))
        # from the first source that isn't full, all share what the full ones leave
        .withColumn("rest", F.min(F.when(F.col("open"), F.struct("fill", "rank", "filled", "weights"))).over(all_rows))
    )
    share = (F.col("total") - F.col("rest.filled")) * F.col("weight") / F.col("rest.weights")
    full = F.struct("fill", "rank") < F.struct("rest.fill", "rest.rank")
    return rows.select("source", "source_size", F.when(full, F.col("limit").cast("double")).otherwise(share.cast("double")).alias("target"))


def mix(docs: DataFrame, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs``."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    keyed = persist(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key")).withColumn("range", F.substring("key", 1, RANGE_DIGITS)),
        "keyed",
    )
    ranges = persist(keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), max_epochs)
    before = F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.withColumn("start", before)
    at = starts.join(targets.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t"))).select(F.col("source").alias("s"), F.col("range").alias("r"), "start", "source_size", "target")
    rows = keyed.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    within = W.partitionBy("s", "r").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    prefix = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("prefix")))
    return (
        rows.withColumn("prefix", prefix)
        .withColumn("epochs", epochs)
        .withColumn("rest", rest)
        .select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
    )
