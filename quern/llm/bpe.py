"""Byte-level BPE: a priority queue of merge ranks over a doubly linked list of symbols, and the way back.

Texts are cut at special tokens, then into pieces by the vocabulary's pattern. A piece's bytes are a linked
list of symbols; all neighbours that have a rank lie in a heap by (rank, place). The least is merged, its new
neighbours are pushed, and an entry whose pair has changed meanwhile is stale and skipped. Pieces recur, so
a task remembers those it has merged. Decoding concatenates the bytes of the vocabulary's strings.

The work is a map over documents: nothing is shuffled, the vocabulary (a few MB) is broadcast, and a text
is worked off in slices that end where no piece can span, so memory holds one slice, its ids and the text.

The letters and numbers of the pattern are those of the library that the vocabulary's file is made for: characters
that are newer than this Python's tables are put to it once, on the driver.

Defined cases: null and empty texts have no ids and decode to the empty text; the strings of special tokens
become their ids, as in the library; repeated rows are encoded each; columns other than doc_id and text are
ignored; an empty table gives no rows. A piece of a million characters is one list, so it takes some 80 bytes a byte.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.common import slices, texts

#: Characters of a text that are worked on at once, and of a piece that is remembered, at most.
SLICE_CHARS, MEMO_CHARS = 1 << 19, 64
#: Pieces that a task remembers; then it forgets all and begins anew.
MEMO_PIECES = 1 << 19
#: Bits of a place in a piece, in the entries of the queue.
PLACE = 36
PLACES = (1 << PLACE) - 1
#: Symbols from which a list is held as an array of 4 bytes each.
LONG = 1 << 14
#: What splits a text into pieces; {L} and {N} stand for letters and numbers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
ASCII = re.compile(PATTERN.replace("{L}", "A-Za-z").replace("{N}", "0-9"), re.ASCII)
#: A space between ASCII letters: no piece reaches over its left edge, whatever comes before or after.
CUT = regex.compile("[A-Za-z] (?=[A-Za-z])|\\p{Ll} (?=\\p{Ll})")


def byte_marks() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def newer_characters(path: str) -> tuple[str, str]:
    """Letters and numbers of ``regex`` that the library doesn't count as such, as characters.

    Only characters that this Python's own tables don't know can differ; the library splits a text of all of them.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    out = []
    for kind, beside in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        known = regex.compile(kind)
        new = [c for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(c := chr(i)) == "Cn" and known.match(c)]
        ends = {b for _, (_, b) in split("".join(f"{beside}{c}{beside}." for c in new))}
        out.append("".join(c for i, c in enumerate(new) if 4 * i + 1 in ends))
    return out[0], out[1]


def ranges(chars: str) -> Iterator[str]:
    """Characters in ascending order as the ranges of a class."""
    starts = [i for i, c in enumerate(chars) if not i or ord(c) != ord(chars[i - 1]) + 1]
    for a, b in pairwise([*starts, len(chars)]):
        yield f"{chars[a]}-{chars[b - 1]}"


@dataclass
class Vocabulary:
    """strings: the bytes of each id; ranks: of pairs of ids; made: the id that a rank's merge gives."""

    strings: list[bytes]
    ranks: dict[tuple[int, int], int]
    made: list[int]
    of_byte: list[int]
    special: dict[str, int]
    new_letters: str = ""
    new_numbers: str = ""
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a tokenizer file (JSON) of byte-level BPE; parts of it that would change results aren't passed over but raise."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("lstrip", "rstrip", "single_word") if any(t[k] for t in file["added_tokens"])]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or file["normalizer"] or odd:
            raise ValueError(f"{path} isn't a plain byte-level BPE: {odd}")
        marks, vocab = byte_marks(), model["vocab"]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        strings = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            strings[i] = bytes(marks[c] for c in token)
        for token, i in special.items():
            strings[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        of_byte = [vocab[c] for c, _ in sorted(marks.items(), key=lambda m: m[1])]
        return cls(strings, ranks, [vocab[a + b] for a, b in merges], of_byte, special, *newer_characters(path))

    def pattern(self, text: str) -> regex.Pattern:
        """The pattern for a text: the same pieces by the simplest classes that its characters allow, as those are faster."""
        return ASCII if text.isascii() else self.plain if self.newer.isdisjoint(text) else self.exact

    @cached_property
    def newer(self) -> frozenset[str]:
        return frozenset(self.new_letters + self.new_numbers)

    @cached_property
    def plain(self) -> regex.Pattern:
        return regex.compile(PATTERN.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))

    @cached_property
    def exact(self) -> regex.Pattern:
        classes = (rf"[\p{{{kind}}}--[{''.join(ranges(new))}]]" if new else rf"\p{{{kind}}}" for kind, new in (("L", self.new_letters), ("N", self.new_numbers)))
        return regex.compile(PATTERN.replace("{L}", next(classes)).replace("{N}", next(classes)), regex.V1)

    @cached_property
    def specials(self) -> regex.Pattern:
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    @cached_property
    def byte_ranks(self) -> dict[tuple[int, int], int]:
        """Shifted ranks of pairs of bytes."""
        byte = {s: b for b, s in enumerate(self.of_byte)}
        return {(byte[a], byte[b]): r << PLACE for (a, b), r in self.ranks.items() if a in byte and b in byte}

    @cached_property
    def following(self) -> list:
        """Of each id, and at last of no symbol, the look-up of what may follow it: id to shifted rank."""
        pairs: list[dict[int, int]] = [{} for _ in range(len(self.strings) + 1)]
        for (a, b), r in self.ranks.items():
            pairs[a][b] = r << PLACE
        return [p.get for p in pairs]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a piece. An entry of the queue is a pair's rank, then the place of its left symbol."""
        n, none, following, made = len(piece), len(self.strings), self.following, self.made
        queue = [r + i for i, r in enumerate(map(self.byte_ranks.get, zip(piece, piece[1:]))) if r is not None]
        if not queue:
            return tuple(self.of_byte[b] for b in piece)
        listed = list if n < LONG else lambda xs: array("i", xs)
        symbols, before, after = listed([*map(self.of_byte.__getitem__, piece), none]), listed(range(-1, n)), listed(range(1, n + 1))
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & PLACES
            j = after[i]
            if following[symbols[i]](symbols[j]) != entry - i:
                continue  # stale: one of the two has been merged since
            new = symbols[i] = made[entry >> PLACE]
            symbols[j] = none
            h, k = before[i], after[j]
            after[i] = k
            if k < n:
                before[k] = i
            if (r := following[new](symbols[k])) is not None:
                heappush(queue, r + i)
            if (r := following[symbols[h]](new)) is not None:  # the first has the mark at the end before it
                heappush(queue, r + h)
        return tuple(s for s in symbols if s != none)

    def ids_of(self, pieces: list[str]) -> list[tuple[int, ...]]:
        found = list(map(self.memo.get, pieces))
        if None not in found:
            return found
        new = {p: self.merge(p.encode()) for p in {p for p, ids in zip(pieces, found, strict=True) if ids is None}}
        found = [ids or new[p] for p, ids in zip(pieces, found, strict=True)]
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.memo.clear()
        self.memo.update((p, ids) for p, ids in new.items() if len(p) <= MEMO_CHARS)
        return found

    def slices(self, text: str, size: int = SLICE_CHARS) -> Iterator[str]:
        start = 0
        while len(text) - start > size and (at := CUT.search(text, start + size)):
            yield text[start : at.end() - 1]
            start = at.end() - 1
        yield text[start:] if start else text

    def encode(self, text: str, size: int = SLICE_CHARS) -> np.ndarray:
        """The ids of a text, as 32-bit integers."""
        found = []
        for some in self.slices(text, size):
            for k, part in enumerate(self.specials.split(some) if self.special else [some]):
                ids = (self.special[part],) if k % 2 else chain.from_iterable(self.ids_of(self.pattern(part).findall(part)))
                found.append(np.fromiter(ids, np.int32))
        return np.concatenate(found) if found else np.empty(0, np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def encode_and_decode(docs: DataFrame, path: str, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id, ids (array of int), decoded (what the ids say): ``path`` names the vocabulary's file on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in slices(batches, "text"):
            rows = [vocabulary.encode(t.decode("utf-8", "replace"), slice_chars) for t in texts(batch.column("text"))]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
            yield pa.record_batch([batch.column("doc_id"), ids, pa.array([vocabulary.decode(x.tolist()) for x in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(both, f"doc_id {kind}, ids array<int>, decoded string")
