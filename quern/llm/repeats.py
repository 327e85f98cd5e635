"""Dedup of repeated substrings by a depth-limited radix sort of suffixes.

Every window of ``width`` bytes has an anchor: its ``gram`` bytes of least hash, the leftmost of equals. Equal
windows have equal anchors at equal places, so only suffixes at anchors are ordered, about one in seventy
bytes. Neighbouring windows with one anchor travel as one string, which holds all their bytes.

1. The first digit is the anchor's gram. Grams are counted by hash, and windows whose gram occurs once leave.
2. The strings of the others are dealt by their gram. Within a gram, the suffixes that begin at the
   anchors are ordered by most-significant-digit passes of eight bytes, to the depth of a window and no
   further; groups of one leave at each pass. The bytes before the anchors are ordered alike, read backwards.
3. The places where neighbours in these orders part give each suffix's class at every depth. Windows are equal if
   their classes are, forwards and backwards, at the depths that the window reaches: the groups of two
   or more are exactly the repeated windows. A string's repeated windows overlap, so they cover one stretch.

A gram of more than ``group`` places, which many texts share, is split further by the windows themselves: they
are counted by a 128-bit digest, so no group meets in one task. Equal strings are merged by such a digest before
they are shuffled, and the stretches found go back to their places by it; the few strings that occur very
often are broadcast for that. Texts are cut into overlapping pieces, so that a long one needs no more memory.

A window is repeated if it starts at two places of the input, in one text or in two. Nothing but
counts, filters and a bounded number of hot strings reaches the driver.

Defined cases: a null text is empty; a text shorter than a window keeps all; a text of a window
or more that occurs twice is removed whole; repeated rows are copies of each other; null ids stay
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import _positions, bloom, discard, join_hot, persist, slices, texts

WIDTH, GRAM = 200, 64
#: Places of a gram beyond which its windows are counted one by one.
GROUP = 50_000
#: Bytes of a block of texts; places within it take PLACE_BITS bits beside a hash.
PIECE, PLACE_BITS = 1 << 19, 20
#: Strings of a task that are merged before they go on, and strings that are ordered at once.
STRINGS, ORDERED = 20_000, 6_000
#: Compression of the texts that are kept beside.
LEVEL = 6
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes in a row (a polynomial, then mixed)."""
    size = PIECE + gram
    up, down = _powers(size)
    out = []
    for at in range(0, len(data) - gram + 1, PIECE):
        piece = data[at : at + PIECE + gram - 1]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: len(piece) - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _sliding(f: Callable, x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = f(x[:-size], x[size:]), size * 2
    rest = width - size
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def pieces_of(block: list[bytes], width: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """(texts, starts, data, ends) of pieces of texts, ``limit`` bytes together; each window lies in one piece."""
    held: list[tuple[int, int, bytes]] = []
    size, step = 0, max(1, limit - width)

    def packed() -> tuple:
        number, start, data = zip(*held, strict=True)
        return np.array(number), np.array(start), b"".join(data), np.cumsum([len(x) for x in data])

    for i, text in enumerate(block):
        for at in range(0, max(0, len(text) - width + 1), step):
            piece = text[at : at + step + width - 1]
            if held and size + len(piece) > limit:
                yield packed()
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield packed()


def anchored(data: bytes, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor, hash) of the runs of windows with one anchor; no window lies over two pieces."""
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    span, low = width - gram + 1, np.uint64((1 << PLACE_BITS) - 1)
    if len(h) < span:
        return (np.empty(0, np.int64),) * 4
    least = _sliding(np.minimum, (h & ~low) | np.arange(len(h), dtype=np.uint64), span)
    inside = np.ones(len(least), bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - width + 1) : end] = False
    s = np.flatnonzero(inside)
    place = (least[s] & low).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 1) | (np.diff(place) != 0)])) if len(s) else s
    tail = np.concatenate([head[1:], [len(s)]]) - 1 if len(s) else s
    return s[head], s[tail], place[head], h[place[head]].view(np.int64)


def in_filter(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for p in _positions(h, len(words) << 6):
        ok &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


# --- the radix sort ------------------------------------------------------------------------------


def radix_order(group: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of rows by group and digits (big-endian words of 8 bytes), most significant digit first.

    ``group`` ascends. common[i]: leading bytes that the rows order[i - 1] and order[i] share, -1 in two groups.
    """
    n, depth = digits.shape
    order = np.arange(n)
    common = np.full(n, 8 * depth, np.int64)
    if n:
        common[np.concatenate([[True], group[1:] != group[:-1]])] = -1
    part = common < 8 * depth  # where a group of rows equal so far begins
    for t in range(depth):
        number = np.cumsum(part)
        alone = part & np.concatenate([part[1:], [True]])
        at = np.flatnonzero(~alone)  # groups of one leave
        if not len(at):
            break
        rows = order[at]
        digit = digits[rows, t]
        new = np.lexsort((digit, number[at]))
        order[at], digit = rows[new], digit[new]
        differs = np.flatnonzero((digit[1:] != digit[:-1]) & ~part[at[1:]]) + 1
        x = digit[differs] ^ digit[differs - 1]
        same = sum(((x >> np.uint64(56 - 8 * k)) == 0).astype(np.int64) for k in range(8))
        common[at[differs]] = 8 * t + same
        part[at[differs]] = True
    return order, common


def _digits(data: np.ndarray, start: np.ndarray, size: np.ndarray, depth: int, step: int) -> np.ndarray:
    """Digits of the ``size`` bytes from each start on (backwards for a step of -1), zeros beyond."""
    k = np.arange(-(-depth // 8) * 8)
    at = np.clip(start[:, None] + step * k, 0, max(0, len(data) - 1))
    found = np.where(k < size[:, None], data[at] if len(data) else 0, 0).astype(np.uint8)
    return np.ascontiguousarray(found).view(">u8").astype(np.uint64)


def repeated_stretches(group: np.ndarray, n: np.ndarray, back: np.ndarray, strings: list[bytes], width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string, where its first repeated window begins and its last one ends; both 0 if there is none.

    ``group`` (the strings' gram) ascends, ``n`` counts a string's places, ``back`` is the anchor's place in it.
    """
    k, sizes = len(strings), np.array([len(x) for x in strings], np.int64)
    data, start = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes
    classes = []
    for digits in (_digits(data, start + back, np.minimum(sizes - back, width), width, 1), _digits(data, start + back - 1, back, width - gram, -1)):
        order, common = radix_order(group, digits)
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        classes.append((place, common))
    (forth, ahead), (behind, before) = classes
    nearest, farthest = back - (sizes - width), back  # how far before the anchor windows begin
    least, most = np.full(k, width), np.full(k, -1)
    for d in range(width - gram + 1):
        some = np.flatnonzero((nearest <= d) & (d <= farthest))
        if len(some):
            code = np.cumsum(ahead < width - d)[forth[some]] * (k + 1) + np.cumsum(before < d)[behind[some]]
            order = np.argsort(code, kind="stable")
            ranked = code[order]
            same = ranked[1:] == ranked[:-1]
            again = np.zeros(len(some), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            hit = some[again | (n[some] > 1)]
            least[hit] = np.minimum(least[hit], d)
            most[hit] = d
    found = most >= 0
    return np.where(found, back - most, 0), np.where(found, back - least + width, 0)


# --- passes --------------------------------------------------------------------------------------

STRING = "gram long, hi long, lo long, n long, back int, string binary"
STRETCH = "hi long, lo long, n long, a int, b int"


def _long(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def strings_of(batch: pa.RecordBatch, names: tuple[str, str, str], width: int) -> Iterator[tuple[int, list[int], list[int], list[bytes]]]:
    """(row, starts, backs, strings) of packed texts' strings, from their lists of starts, sizes and backs."""
    unpack = zstandard.ZstdDecompressor()
    lists = [batch.column(c) for c in names]
    for i in range(batch.num_rows):
        starts, sizes, backs = (x[i].as_py() for x in lists)
        if starts:
            text = unpack.decompress(batch.column("packed")[i].as_py())
            yield i, starts, backs, [text[a : a + k] for a, k in zip(starts, sizes, strict=True)]


def merged_strings(work: DataFrame, names: tuple[str, str, str], width: int, gram: int) -> DataFrame:
    """The distinct strings of each task, with their gram's hash and the number of their places."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            d, rows = _long(list(table)), list(table.values())
            out = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())], names=[x.split()[0] for x in STRING.split(", ")])
            table.clear()
            return out

        for batch in slices(batches, "packed", PIECE):
            for _, _, backs, strings in strings_of(batch, names, width):
                for back, x in zip(backs, strings, strict=True):
                    d = xxhash.xxh3_128_digest(x)
                    if d in table:
                        table[d][1] += 1
                    else:
                        table[d] = [int.from_bytes(xxhash.xxh3_64_digest(x[back : back + gram]), "big", signed=True), 1, back, x]
                if len(table) >= STRINGS:
                    yield flush()
        yield flush()

    return work.select("packed", *names).mapInArrow(emit, STRING)


def ordered_stretches(strings: DataFrame, width: int, gram: int) -> DataFrame:
    """The stretches of repeated windows of strings dealt by their gram, by radix sort."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            once: list[list] = []
            for g, hi, lo, n, back, x in rows:  # equal strings are neighbours
                if once and once[-1][1:3] == [hi, lo] and once[-1][0] == g:
                    once[-1][3] += n
                else:
                    once.append([g, hi, lo, n, back, x])
            g, hi, lo, n, back, x = zip(*once, strict=True) if once else ((),) * 6
            a, b = repeated_stretches(np.array(g, np.int64), np.array(n, np.int64), np.array(back, np.int64), list(x), width, gram)
            ok = b > 0
            kinds = (np.int64, np.int64, np.int64, np.int32, np.int32)
            return pa.record_batch([pa.array(np.array(c, t)[ok]) for c, t in zip((hi, lo, n, a, b), kinds, strict=True)], names=[c.split()[0] for c in STRETCH.split(", ")])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("gram", "hi", "lo", "n", "back", "string")), strict=True)
            if len(held) >= ORDERED:  # all but the last gram, which may go on
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield settle(held[:cut])
                    held = held[cut:]
        yield settle(held)

    dealt = strings.repartition("gram").sortWithinPartitions("gram", "hi", "lo")
    return dealt.mapInArrow(sort, STRETCH)


def counted_stretches(strings: DataFrame, width: int) -> DataFrame:
    """The same for strings of grams that very many places share: their windows are counted one by one."""
    once = persist(strings.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.first("string").alias("string")), "hot")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "string", 1 << 14):
            x, sizes = batch.column("string").to_pylist(), np.asarray(pa.compute.binary_length(batch.column("string"))).astype(np.int64) - width + 1
            d = _long([xxhash.xxh3_128_digest(t[o : o + width]) for t in x for o in range(len(t) - width + 1)])
            at = np.repeat(np.arange(len(x)), sizes)
            offset = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.record_batch([pa.array(d[:, 0]), pa.array(d[:, 1]), *(batch.column(c).take(pa.array(at)) for c in ("hi", "lo", "n")), pa.array(offset.astype(np.int32))], names=["hi", "lo", "string_hi", "string_lo", "n", "o"])

    each = once.mapInArrow(windows, "hi long, lo long, string_hi long, string_lo long, n long, o int")
    again = persist(each.groupBy("hi", "lo").agg(F.sum("n").alias("times")).where("times > 1"), "windows")
    met = join_hot(each, again.select(F.col("hi").alias("h"), F.col("lo").alias("l"), "times"), {"hi": "h", "lo": "l"}, "times")
    return met.groupBy(F.col("string_hi").alias("hi"), F.col("string_lo").alias("lo")).agg(F.max("n").alias("n"), F.min("o").cast("int").alias("a"), (F.max("o") + width).cast("int").alias("b"))


def repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``, and the removed spans."""
    if not 0 < gram <= width:
        raise ValueError("a gram is a part of a window")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(text, 256)
    meta = persist(docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("sha"), F.octet_length(text).cast("long").alias("n_bytes")), "meta")
    long_texts = docs.select(text.alias("text"), sha.alias("sha")).where(F.octet_length("text") >= width)

    # the first digit: how many places each gram has
    def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            for _, _, data, ends in pieces_of(texts(batch.column("text")), width, PIECE):
                h, n = np.unique(anchored(data, ends, width, gram)[3], return_counts=True)
                yield pa.record_batch([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    grams = long_texts.select("text").mapInArrow(gram_rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    again = persist(grams.where("n > 1"), "grams")
    shared = spark.sparkContext.broadcast((bloom(again.select("h"), "h"), bloom(again.where(F.col("n") > group).select("h"), "h")))
    lists = ("starts", "sizes", "backs")
    hot_lists = tuple(f"hot_{c}" for c in lists)

    # the texts that may hold a repeated window, packed, with the strings of their windows
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, (twice, hot), seen = zstandard.ZstdCompressor(LEVEL), shared.value, set()
        tid = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", PIECE):
            shas, block = batch.column("sha").to_pylist(), texts(batch.column("text"))
            found: list[tuple[list, ...]] = [tuple([] for _ in range(6)) for _ in block]
            for number, start, data, ends in pieces_of([b"" if s in seen else t for s, t in zip(shas, block, strict=True)], width, PIECE):
                first, last, anchor, h = (x for x in anchored(data, ends, width, gram))
                ok = in_filter(twice, h)
                first, last, anchor, h = first[ok], last[ok], anchor[ok], h[ok]
                piece = np.searchsorted(ends, first, side="right")
                begin = start[piece] - np.concatenate([[0], ends[:-1]])[piece] + first
                is_hot = in_filter(hot, h)
                for i, b, size, back, x in zip(number[piece].tolist(), begin.tolist(), (last - first + width).tolist(), (anchor - first).tolist(), is_hot.tolist(), strict=True):
                    for values, value in zip(found[i][3 * x : 3 * x + 3], (b, size, back), strict=True):
                        values.append(value)
            if len(seen) > 20_000:
                seen.clear()
            seen.update(shas)
            rows = []
            for s, t, x in zip(shas, block, found, strict=True):
                if x[0] or x[3]:
                    rows.append((tid, s, pack.compress(t), *x))
                    tid += 1
            kinds = (pa.int64(), pa.string(), pa.binary(), *[pa.list_(pa.int32())] * 6)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True)], names=["tid", "sha", "packed", *lists, *hot_lists])

    schema = "tid long, sha string, packed binary, " + ", ".join(f"{c} array<int>" for c in (*lists, *hot_lists))
    work = persist(long_texts.select("sha", "text").mapInArrow(candidates, schema), "texts")
    stretches = ordered_stretches(merged_strings(work, lists, width, gram), width, gram)
    if again.where(F.col("n") > group).limit(1).count():
        stretches = stretches.unionByName(counted_stretches(merged_strings(work.where(F.size("hot_starts") > 0), hot_lists, width, gram), width))
    stretches = persist(stretches, "stretches")

    # back to the places of the strings
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", PIECE):
            for names in (lists, hot_lists):
                for i, starts, _, strings in strings_of(batch, names, width):
                    d = _long([xxhash.xxh3_128_digest(x) for x in strings])
                    yield pa.record_batch([batch.column("tid").take(pa.array(np.full(len(d), i))), pa.array(starts, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["tid", "start", "hi", "lo"])

    rows = work.select("tid", "packed", *lists, *hot_lists).mapInArrow(together(places), "tid long, start int, hi long, lo long")
    met = join_hot(rows, stretches.select(F.col("hi").alias("h"), F.col("lo").alias("l"), "n", "a", "b"), {"hi": "h", "lo": "l"}, "n")
    spans = met.groupBy("tid").agg(F.collect_list(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))).alias("found"))  # a text's own

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "packed", PIECE):
            rows = []
            for i, (sha, packed) in enumerate(zip(batch.column("sha").to_pylist(), batch.column("packed"), strict=True)):
                found, text = batch.column("found")[i].values, unpack.decompress(packed.as_py())
                runs = joined(*(found.field(c).to_numpy().astype(np.int64) for c in ("a", "b")))
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                rows.append((sha, sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [x for r in runs for x in r]))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=["sha", "removed", "runs", "kept", "spans"])

    of_text = work.select("tid", "sha", "packed").join(spans, "tid").select("sha", "packed", "found")
    found = of_text.mapInArrow(result, "sha string, removed long, runs long, kept string, spans array<long>").dropDuplicates(["sha"])
    copies = persist(meta.groupBy("sha").count().where("count > 1").select(F.col("sha").alias("c"), F.lit(True).alias("copied")), "copies")
    named = persist(found.withColumnRenamed("sha", "c").join(copies, "c", "full"), "named")
    discard(again, work, stretches, copies)
    whole = F.col("copied").isNotNull() & (F.col("n_bytes") >= width)
    none = F.sha2(F.lit(""), 256)
    return meta.join(named, F.col("sha") == F.col("c"), "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, none).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
    )


def joined(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that stretches from a to b cover; stretches that touch make one run."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    head = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.empty(0, np.int64)
    return list(zip(a[head].tolist(), b[np.concatenate([head[1:], [len(a)]]) - 1].tolist(), strict=True)) if len(a) else []


def together(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 20_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` with its small batches put together."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in f(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield pa.concat_batches(held)
                held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    return out
