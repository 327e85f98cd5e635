"""Scans along ordered groups of any size: a group is cut into ranges, each is scanned alone, and a state is carried over the cuts.

Rows are range-partitioned and sorted by group and order once, so a group that holds all rows lies in as many tasks as any other. A task
scans its rows in batches and writes them with what it knows; of each range only the first and the last row are read to
the driver, which tells for every range what the ranges before (or after) it hand over, and the rows of a range's first
group take it in a broadcast of one row a range. No task holds a group, and no window orders one.

Kinds of scans (each of a column, by output name): ``last``: the last value that isn't null up to the row; ``total``: the sum up to the row;
``before`` and ``after``: the value of the neighbouring row; ``starts``: how many rows up to this one are counted and differ from the
row before (of a pair: the value, and whether the row is counted).

Defined cases: null group keys are a group; the order of rows of equal keys is open; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quern.sources.shared import stored


def differs(xs: pa.Array, before: pa.Array) -> np.ndarray:
    """Whether each value isn't that of ``before``; nulls equal each other."""
    unequal = pc.fill_null(pc.not_equal(xs, before), False).to_numpy(zero_copy_only=False)
    return unequal | (xs.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))


class _Range:
    """The scan of one range, batch by batch: what the rows so far hand on."""

    def __init__(self, group: list[str], kinds: dict[str, list[str]]):
        self.group, self.kinds, self.seen, self.groups = group, kinds, None, 0
        self.held: dict[str, pa.Array] = {}
        self.totals: dict[str, int] = dict.fromkeys(kinds["total"] + kinds["starts"], 0)

    def scan(self, batch: pa.RecordBatch, following: pa.RecordBatch | None, part: int) -> pa.RecordBatch:
        n, at = batch.num_rows, np.arange(batch.num_rows)
        ahead = lambda c: pa.concat_arrays([self.seen.column(c) if self.seen else pa.nulls(1, batch.column(c).type), batch.column(c).slice(0, n - 1)])
        new = np.zeros(n, bool)
        for c in self.group:
            new |= differs(batch.column(c), ahead(c))
        first = self.seen is None
        new[0] |= first
        begins = np.maximum.accumulate(np.where(new, at, -1))  # -1: the group goes on from the batch before
        number = self.groups + np.cumsum(new)
        out = {}
        for c in self.kinds["last"]:
            col = batch.column(c)
            known = np.maximum.accumulate(np.where(col.is_valid().to_numpy(zero_copy_only=False), at, -1))
            take = np.where((known >= begins) & (known >= 0), known + 1, np.where(begins < 0, 0, -1))
            both = pa.concat_arrays([self.held.get(c, pa.nulls(1, col.type)), col])
            out[c] = both.take(pa.array(take, mask=take < 0))
            self.held[c] = out[c].slice(n - 1)
        for c in self.kinds["before"]:
            out[c] = pc.if_else(pa.array(new), pa.nulls(n, batch.column(c).type), ahead(c)) if not pa.types.is_nested(batch.column(c).type) else _masked(ahead(c), new)
        for c in self.kinds["after"]:
            nxt = following.column(c).slice(0, 1) if following is not None else pa.nulls(1, batch.column(c).type)
            ends = np.append(new[1:], following is None or any(differs(following.column(g).slice(0, 1), batch.column(g).slice(n - 1))[0] for g in self.group))
            out[c] = _masked(pa.concat_arrays([batch.column(c).slice(1), nxt]), ends)
        for c in self.kinds["total"] + self.kinds["starts"]:
            if c in self.kinds["total"]:
                value = pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                value = ((new | differs(batch.column(c), ahead(c))) & pc.fill_null(batch.column(f"{c}_counted"), False).to_numpy(zero_copy_only=False)).astype(np.int64)
            summed = np.cumsum(value)
            start = np.where(begins > 0, summed[np.maximum(begins, 1) - 1], np.where(begins == 0, 0, -self.totals[c]))
            out[c] = pa.array(summed - start)
            self.totals[c] = int(summed[-1] - start[-1])
        self.seen, self.groups = batch.slice(n - 1), int(number[-1])
        flags = {"_part": pa.array(np.full(n, part, np.int32)), "_head": pa.array(number == 1), "_first": pa.array((at == 0) & first), "_edge": pa.array((at == n - 1) & (following is None))}
        same = [c for c in batch.schema.names if c not in out]
        scanned = {f"{c}_out": x for c, x in out.items()}
        keep = {c: batch.column(c) for c in same} | {c: batch.column(c) for c in out}
        return pa.record_batch({**keep, **scanned, **flags})


def _masked(xs: pa.Array, gone: np.ndarray) -> pa.Array:
    return xs.take(pa.array(np.arange(len(xs)), mask=gone))


def scan(
    df: DataFrame, group: list[str], order: list[str], last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None, starts: dict[str, tuple[Column, Column]] | None = None, parts: int | None = None,
) -> DataFrame:
    """``df`` with the outputs of scans along ``order`` within ``group``, in ``parts`` ranges (the session's shuffle partitions)."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = {"last": last or {}, "total": total or {}, "before": before or {}, "after": after or {}, "starts": {k: v for k, (v, _) in (starts or {}).items()}}
    named, kinds, inputs = {}, {}, {}
    for kind, columns in given.items():
        kinds[kind] = []
        for out, column in columns.items():
            c = f"_in{len(named)}"
            named[c] = out
            kinds[kind].append(c)
            inputs[c] = column.cast("long") if kind == "total" else column
            if kind == "starts":
                inputs[f"{c}_counted"] = starts[out][1]
    keys = {f"_g{i}": F.col(g) for i, g in enumerate(group)}
    rows = df.select("*", *(x.alias(c) for c, x in (keys | inputs).items()))
    dealt = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    kind_of = {f.name: f.dataType.simpleString() for f in rows.schema}
    whole = [*kinds["total"], *kinds["starts"]]
    kept = [c for c in rows.columns if c not in named]
    types = {c: kind_of[c] for c in [*kept, *named]} | {f"{c}_out": "long" if c in whole else kind_of[c] for c in named} | {"_part": "int", "_head": "boolean", "_first": "boolean", "_edge": "boolean"}
    schema, names, key_names = ", ".join(f"`{c}` {t}" for c, t in types.items()), list(types), list(keys)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part, held = _Range(key_names, kinds), TaskContext.get().partitionId(), None
        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield state.scan(held, batch, part).select(names)
                held = batch
        if held is not None:
            yield state.scan(held, None, part).select(names)

    scanned = stored(dealt.mapInArrow(local, schema), "scan")
    ends = scanned.where("_first or _edge").select("_part", "_first", "_edge", *keys, *named, *(f"{c}_counted" for c in kinds["starts"]), *(f"{c}_out" for c in named)).collect()  # two rows a range
    over = spark.createDataFrame(_carried(ends, list(keys), kinds), ", ".join(["_at int", *(f"{c}_over {'long' if c in whole else kind_of[c]}" for c in named)]))
    joined = scanned.join(F.broadcast(over), F.col("_part") == F.col("_at"), "left")  # one row a range
    outputs = []
    for kind, columns in kinds.items():
        for c in columns:
            own, more = F.col(f"{c}_out"), F.col(f"{c}_over")
            full = {"last": F.when(F.col("_head"), F.coalesce(own, more)).otherwise(own), "before": F.when(F.col("_first"), more).otherwise(own), "after": F.when(F.col("_edge"), more).otherwise(own)}
            outputs.append(full.get(kind, own + F.when(F.col("_head"), F.coalesce(more, F.lit(0))).otherwise(0)).alias(named[c]))
    return joined.select(*(c for c in df.columns if c not in named.values()), *outputs)


def _carried(ends: list, keys: list[str], kinds: dict[str, list[str]]) -> list[tuple]:
    """For each range what it takes over from its neighbours, in the order of the columns named _in0 and so on."""
    by_part: dict[int, dict[str, object]] = {}
    for r in ends:
        for flag in ("_first", "_edge"):
            if r[flag]:
                by_part.setdefault(r["_part"], {})[flag] = r
    names = sorted((c for columns in kinds.values() for c in columns), key=lambda c: int(c[3:]))
    of = lambda r: tuple(r[k] for k in keys)
    over: dict[int, dict[str, object]] = {p: {} for p in by_part}
    state: dict[str, object] | None = None  # at the end of the ranges so far: the group, and each column's value
    previous = None
    for p in sorted(by_part):
        first, edge = by_part[p]["_first"], by_part[p]["_edge"]
        goes_on = state is not None and state["group"] == of(first)
        if goes_on:
            for c in kinds["last"] + kinds["total"]:
                over[p][c] = state[c]
            for c in kinds["before"]:
                over[p][c] = previous[c]
            for c in kinds["starts"]:  # the range took its first row for a start
                over[p][c] = state[c] - int(bool(first[f"{c}_counted"]) and first[c] == previous[c])
        if previous is not None and of(previous) == of(first):
            over[previous["_part"]] |= {c: first[c] for c in kinds["after"]}
        one = goes_on and of(edge) == of(first)
        state = {"group": of(edge)}
        for c in kinds["last"]:
            state[c] = over[p][c] if one and edge[f"{c}_out"] is None else edge[f"{c}_out"]
        for c in kinds["total"] + kinds["starts"]:
            state[c] = edge[f"{c}_out"] + (over[p][c] if one else 0)
        previous = edge
    return [(p, *(over[p].get(c) for c in names)) for p in sorted(over)]


# --- percentiles ---------------------------------------------------------------------------------

#: Bins of a pass, and values that one task may sort.
BINS, SORTED = 4096, 20_000


def exact_percentile(df: DataFrame, group: str, value: str, p: float, name: str = "percentile", small: int = SORTED) -> DataFrame:
    """group, ``name``: the interpolated percentile of each group's values, as ``percentile`` gives it, without holding a large group.

    Groups of up to ``small`` values are sorted. In larger ones, of which there are few, passes of BINS bins between the least and the
    largest candidate tell in which bin each of the two order statistics lies, until no more than ``small`` values are left there
    or all are equal. A pass sends a row for each bin. Nulls and NaN are left out.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    counts = stored(rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "counts")
    large = counts.where(F.col("n") > small)
    few = rows.join(F.broadcast(large.select(F.col("_g").alias("_h"))), F.col("_g").eqNullSafe(F.col("_h")), "left_anti")  # total / small rows at most
    found = few.groupBy("_g").agg(F.percentile("_v", F.lit(p)).alias(name))
    if large.isEmpty():
        return found.select(F.col("_g").alias(group), name)
    place = F.lit(p) * (F.col("n") - 1)
    both = F.explode(F.array(*(F.struct(F.lit(i).alias("which"), f(place).cast("long").alias("rank")) for i, f in enumerate((F.floor, F.ceil)))))
    targets = stored(large.select(F.col("_g").alias("_h"), "n", "lo", "hi", place.alias("place"), both.alias("t")).select("_h", "place", "lo", "hi", "t.which", "t.rank", F.col("n").alias("left")), "targets")
    inside = lambda t: rows.join(F.broadcast(t), F.col("_g").eqNullSafe(F.col("_h")) & F.col("_v").between(F.col("lo"), F.col("hi")))  # noqa: E731 - two rows a large group
    while not targets.where(F.col("left") > small).where("lo < hi").isEmpty():
        done = targets.where((F.col("left") <= small) | (F.col("lo") >= F.col("hi")))
        open_ = targets.where((F.col("left") > small) & (F.col("lo") < F.col("hi")))
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bins = inside(open_).withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1))).groupBy("_h", "which", "place", "rank", "bin").agg(F.count("*").alias("left"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        listed = F.array_sort(F.collect_list(F.struct("bin", "left", "lo", "hi")))  # BINS at most
        step = lambda s, b: F.when(s["found"] | (s["rank"] >= b["left"]), F.struct(F.when(s["found"], s["rank"]).otherwise(s["rank"] - b["left"]).alias("rank"), s["found"].alias("found"), s["lo"].alias("lo"), s["hi"].alias("hi"), s["left"].alias("left"))).otherwise(F.struct(s["rank"].alias("rank"), F.lit(True).alias("found"), b["lo"].alias("lo"), b["hi"].alias("hi"), b["left"].alias("left")))
        zero = F.struct(F.col("rank").alias("rank"), F.lit(False).alias("found"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0).cast("long").alias("left"))
        narrowed = bins.groupBy("_h", "which", "place", "rank").agg(listed.alias("bins")).select("_h", "which", "place", F.aggregate("bins", zero, step).alias("s"))
        targets = stored(done.unionByName(narrowed.select("_h", "place", "s.lo", "s.hi", "which", "s.rank", "s.left")), "targets")
    equal = targets.where("lo = hi").select("_h", "which", "place", F.col("lo").alias("v"))
    sorted_ = inside(targets.where("lo < hi")).groupBy("_h", "which", "place", "rank").agg(F.array_sort(F.collect_list("_v")).alias("vs")).select("_h", "which", "place", F.get("vs", F.col("rank").cast("int")).alias("v"))  # ``small`` at most
    ends = equal.unionByName(sorted_).groupBy("_h").agg(F.max("place").alias("place"), F.max(F.when(F.col("which") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("v"))).alias("b"))
    upper = F.ceil("place") - F.col("place")
    mixed = ends.select(F.col("_h").alias("_g"), F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(upper * F.col("a") + (1 - upper) * F.col("b")).alias(name))
    return found.unionByName(mixed).select(F.col("_g").alias(group), name)
