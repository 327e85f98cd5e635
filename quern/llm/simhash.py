"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints are 64-bit SimHashes of word shingles; two link at 4 or fewer differing bits. Three
segments of 22, 21 and 21 bits share those errors, so by pigeonhole either some segment has none
or at least two have exactly one. The first case meets on the segment's exact value. For the second,
each pair of segments is decoded to Golay codewords: one side's near codewords joined with the other
side's nearest one, in both roles. That is 3 + 33 keys a fingerprint at most, of 21 to 24 bits,
and no pair within 4 bits is missed. Members of a key meet in one task, are verified by their
differing bits, and leave a star per group of linked ones instead of all pairs; stars become
components. Copies of a fingerprint are merged before any key is made.

Within a key, linked fingerprints are taken out as they are reached, so a dense group costs little
more than its size. A key with more than ``block`` members is split: its members are dealt into
blocks and each pair of blocks is a group of its own, so no task holds an unbounded group.

Defined cases: a null or wordless text has fingerprint 0 and links like any other; a text of fewer
words than a shingle is one shingle; null ids count for nothing in component_id (null only if the
whole component has no id); repeated rows return repeated; an empty table gives no rows; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quern.llm import golay
from quern.llm.common import bloom, components, discard, free_names, in_bloom, join_hot, persist, slices, texts, word_pieces

#: (shift, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Which side of a Golay key a row stands on: its near codewords in the first or second segment, or both.
FIRST, SECOND, EITHER = 1, 2, 3
BLOCK = 1 << 20
MAX_DISTANCE = 4

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(text: bytes, shingle: int = 4, piece: int = 1 << 20) -> int:
    """The fingerprint: bit i is set if it is set in over half of the shingles' hashes, repeats included.

    Counts of bits add up over pieces of the text, so memory is that of a piece and of its last words.
    """
    ones, total, words, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for part in word_pieces(text, piece):
        words += part.lower().split()
        n = len(words)
        if n < shingle:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        h = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n - shingle + 1)
        by_byte = h.view(np.uint8).reshape(-1, 8)
        if len(h) < 512:
            ones += np.unpackbits(by_byte, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            ones += np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BITS for i in range(8)])
        total += len(h)
        words = words[n - shingle + 1 :]
    if not total:
        return digest(b" ".join(words), 42) if words else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, digest: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and, if asked for, sha (SHA-256 of the text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            held = texts(batch.column("text"))
            fp = np.array([simhash(t, shingle) for t in held], np.uint64)
            out = {"doc_id": batch.column("doc_id"), "fp": pa.array(fp.view(np.int64))}
            if digest:
                out["sha"] = pa.array([hashlib.sha256(t).digest() for t in held], pa.binary())
            yield pa.record_batch([*out.values()], names=[*out])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "doc_id long, fp long" + ", sha binary" * digest)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, side) rows of fingerprints; the key's upper half names its kind."""
    x, found = fp.view(np.uint64), []
    part = [((x >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    for kind, value in enumerate(part):
        found.append((kind << 32 | value, fp, np.full(len(fp), EITHER, np.int8)))
    nearest, near = [golay.nearest(p) for p in part], [golay.near(p) for p in part]
    single = [n[:, 0] == n[:, 1] for n in near]
    for kind, (a, b) in enumerate(PAIRS, len(SEGMENTS)):
        kind <<= 32
        found.append((kind | nearest[a].astype(np.int64) << 12 | nearest[b], fp, np.full(len(fp), EITHER, np.int8)))
        for j in range(1, 6):
            for side, own in ((FIRST, a), (SECOND, b)):
                some = ~single[own]
                x1, x2 = (near[a][some, j], nearest[b][some]) if side == FIRST else (nearest[a][some], near[b][some, j])
                found.append((kind | x1.astype(np.int64) << 12 | x2, fp[some], np.full(int(some.sum()), side, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def stars(fp: np.ndarray, side: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, int]]:
    """(members, root) of the linked groups of two or more within one key.

    A member that is reached leaves the rest at once, so each is compared with what is left only.
    """
    rest, rest_side = fp.view(np.uint64), side
    while len(rest) > 1:
        group, front = [rest[0]], [(rest[0], rest_side[0])]
        rest, rest_side = rest[1:], rest_side[1:]
        while front and len(rest):
            x, s = front.pop()
            linked = (np.bitwise_count(rest ^ x) <= distance) & (((s & FIRST) > 0) & ((rest_side & SECOND) > 0) | ((s & SECOND) > 0) & ((rest_side & FIRST) > 0))
            if linked.any():
                front += zip(rest[linked], rest_side[linked], strict=True)
                group += rest[linked].tolist()
                rest, rest_side = rest[~linked], rest_side[~linked]
        if len(group) > 1:
            members = np.array(group, np.uint64).view(np.int64)
            yield members, int(members.min())


def group_links(key: np.ndarray, fp: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all keys of sorted rows. Small groups are compared at once, by their distance in the order."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    small = np.repeat((sizes > 1) & (sizes <= 64), sizes)
    at, a, b = np.flatnonzero(small), [], []
    step = 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        x, y, s, t = fp[at], fp[at + step], side[at], side[at + step]
        ok = (np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= distance) & (((s & FIRST) > 0) & ((t & SECOND) > 0) | ((s & SECOND) > 0) & ((t & FIRST) > 0))
        a.append(x[ok])
        b.append(y[ok])
        step += 1
    for i in np.flatnonzero(sizes > 64):
        rows = slice(starts[i], starts[i] + sizes[i])
        for members, root in stars(fp[rows], side[rows], distance):
            a.append(members)
            b.append(np.full(len(members), root))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def links(nodes: DataFrame, distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect what is connected by fingerprints ``distance`` bits apart or less.

    ``nodes``: distinct fingerprints, column fp.
    """
    if distance > MAX_DISTANCE:
        raise ValueError("the keys find up to 4 differing bits")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch(list(keys_of(batch.column(0).to_numpy())), names=["key", "fp", "side"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8)]
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns[:3], strict=True)]
            # all but the last key, which may go on in the next batch
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield pa.record_batch(list(group_links(*(h[:cut] for h in held), distance)), names=["a", "b"])
                held = [h[cut:] for h in held]
        yield pa.record_batch(list(group_links(*held, distance)), names=["a", "b"])

    keys = nodes.select("fp").mapInArrow(make, "key long, fp long, side tinyint")
    if nodes.count() > block:  # else no key can have more members
        keys = split_large(persist(keys, "keys"), block)
    grouped = keys.repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(meet, "a long, b long").distinct()


def split_large(keys: DataFrame, block: int) -> DataFrame:
    """Keys of more than ``block`` members become one key per pair of blocks of their members."""
    sizes = keys.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("members")).where(F.col("members") > block)
    rows = keys.join(sizes, F.col("key") == F.col("k"), "left")
    n = F.ceil(F.col("members") / (block / 2)).cast("long")
    own = F.pmod(F.xxhash64("fp"), n)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.least(own, j) * n + F.greatest(own, j))
    split = rows.where("members is not null").select(F.explode(F.array_distinct(cells)).alias("cell"), "key", "fp", "side")
    # a hash of key and cell names the group; should two groups share one, they are compared together
    return rows.where("members is null").select("key", "fp", "side").unionByName(split.select(F.xxhash64("key", "cell").alias("key"), "fp", "side"))


def near_dedup(docs: DataFrame, shingle: int = 4, distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``."""
    prints = persist(fingerprints(docs, shingle), "fingerprints")
    nodes = persist(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, distance, block))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = persist(placed.select("fp", "n", F.col("root").alias("r")).join(firsts, F.col("r") == F.col("root")).select(F.col("fp").alias("node"), "n", "component_id"), "named")
    discard(nodes)
    return join_hot(prints, named, {"fp": "node"}, "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 4, distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, a null id last.

    A row is known by its id and its text's digest, so null and repeated ids are told apart. Of rows
    with equal id and text any one stays. Only rows that share an id with a row to drop are shuffled.
    """
    prints = persist(fingerprints(docs, shingle, digest=True), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "sha")
    nodes = persist(prints.groupBy("fp").agg(F.min(row).alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, distance, block))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("r"))
    firsts = placed.groupBy(F.col("r").alias("root")).agg(F.min("least").alias("first"), F.sum("n").alias("size")).where("size > 1")
    named = persist(placed.select(F.col("fp").alias("node"), "n", "r").join(firsts, F.col("r") == F.col("root")).select("node", "n", "first"), "named")
    discard(nodes)
    # one row of each id and text in the components of several rows: those to drop, and those that stay but repeat
    name, sha, own = free_names(docs, "id", "sha", "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha"))
    copies = join_hot(prints, named, {"fp": "node"}, "n").select(F.col("doc_id").alias(name), F.col("sha").alias(sha), stays.alias("stays"))
    found = persist(copies.groupBy(name, sha, "stays").count().where("not stays or count > 1"), "near")
    discard(prints, named)
    key = F.xxhash64(F.col("doc_id").cast("long"))
    maybe = in_bloom(docs.sparkSession, bloom(found.select(F.xxhash64(name).alias("h")).distinct(), "h"))(key)
    rows = docs.where(maybe).withColumn(own, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.col(own) == F.col(sha))
    out = docs.where(~maybe).unionByName(rows.join(found.select(name, sha), same, "left_anti").select(*docs.columns))
    again = found.where("stays").select(name, sha)
    if again.isEmpty():
        return out
    return out.unionByName(rows.join(again, same).dropDuplicates([name, sha]).select(*docs.columns))
