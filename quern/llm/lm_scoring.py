"""LM scoring by the likelihood of subword lattices.

A word's lattice has an arc for every vocabulary piece that occurs in it, weighted by the piece's
unigram score; the log-space forward recursion sums all segmentations. The pieces and their first
weights come from an existing vocabulary (a rank-based prior, as its scores are ranks); one round of
forward-backward counts over every distinct training word refits the weights. A word seen in training
is a vocabulary entry too: one more arc that spans it all. Its weight is its count less a discount,
and what the discounts free is the weight of the way into the pieces, so that the weights of all words
sum to one. The end of a text is a token of its own. The model's score of a text is the log10 of
its marginal probability: the sum over its tokens of the log of all paths through their lattices.

Words of equal length go through the recursion together, as arrays; words longer than ``LONG`` one by one.

Word counts cover all training documents: tasks count in bounded tables and the partial counts
meet by word. The most frequent words (at most ``head_words``) are broadcast with their scores, so hot
words are never shuffled; the tail's words join their counts. Long texts are counted in pieces.

Defined cases: a null or blank text is the end token alone; characters outside the vocabulary weigh
a fixed small probability; without training tokens only pieces score, and the base is
log10(0.1 / 0.1) = 0 per token; repeated rows are scored separately; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import bucket_of, discard, persist, slices, texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: What marks the start of a word in the vocabulary's pieces.
START = "▁"
#: Words of a task's table of counts, and bytes of text counted into it, at most.
TABLE_WORDS, TABLE_BYTES = 100_000, 32 << 20
HEAD_WORDS = 100_000
#: Bytes of text taken apart at once, and characters of a word that goes through the recursion alone.
PIECE_BYTES, LONG = 1 << 20, 48
#: Arcs of the lattices of a block of words.
BLOCK_ARCS = 1 << 19
#: Natural log of the probability of a character that no piece holds, and the prior's offset of ranks.
UNKNOWN, RANK_OFFSET = math.log(1e-7), 10.0
#: Name of the end token in the tables of counts; no word holds a space.
END = " end"

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Natural-log weights of the pieces of a vocabulary file, by rank: 1 / (rank + offset), normalised."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            ranks[model.id_to_piece(i).lower()] = min(-model.get_score(i), ranks.get(model.id_to_piece(i).lower(), 1e9))
    total = sum(1 / (r + RANK_OFFSET) for r in ranks.values())
    return {p: -math.log(r + RANK_OFFSET) - math.log(total) for p, r in sorted(ranks.items())}


# --- one word's lattice --------------------------------------------------------------------------


def _arcs(word: str, pieces: dict[str, float], longest: int) -> list[list[tuple[int, float, str]]]:
    """For each end, the (start, weight, piece) arcs of a word's lattice; lone characters always have one."""
    w, get = START + word, pieces.get
    out: list[list[tuple[int, float, str]]] = [[]]
    for j in range(1, len(w) + 1):
        found = []
        for i in range(max(0, j - longest), j):
            p = w[i:j]
            x = get(p)
            if x is not None:
                found.append((i, x, p))
        if not found or found[-1][0] != j - 1:
            found.append((j - 1, UNKNOWN, ""))
        out.append(found)
    return out


def _forward(arcs: list[list[tuple[int, float, str]]]) -> list[float]:
    out = [0.0]
    for found in arcs[1:]:
        top = max(out[i] + x for i, x, _ in found)
        out.append(top + math.log(sum(math.exp(out[i] + x - top) for i, x, _ in found)))
    return out


def log_likelihood(word: str, pieces: dict[str, float], longest: int) -> float:
    """Natural log of the summed probability of all segmentations of a word: the forward recursion."""
    return _forward(_arcs(word, pieces, longest))[-1]


def expected_pieces(word: str, count: float, pieces: dict[str, float], longest: int, into: dict[str, float]) -> None:
    """Add the expected uses of each piece over all segmentations of a word, times its count."""
    arcs = _arcs(word, pieces, longest)
    forward, share = _forward(arcs), [0.0] * len(arcs)
    share[-1] = count
    for j in range(len(arcs) - 1, 0, -1):  # how much of the count passes each place, from the end back
        s, f = share[j], forward[j]
        if s > 0:
            for i, x, p in arcs[j]:
                part = s * math.exp(forward[i] + x - f)
                share[i] += part
                if p:
                    into[p] = into.get(p, 0.0) + part


# --- many words' lattices at once ----------------------------------------------------------------


def _codes(words: list[str], length: int) -> np.ndarray:
    """The characters of words of one length, as code points; a row per word, which begins with START."""
    found = np.array([START + w for w in words], f"<U{length + 1}")
    return found.view(np.uint32).reshape(len(words), length + 1)


class Lattices:
    """The pieces as arrays: a hash table from a piece's polynomial hash to its number, and the weights."""

    def __init__(self, pieces: dict[str, float]):
        self.names, self.weights = list(pieces), np.array([*pieces.values(), UNKNOWN], np.float64)
        self.pieces, self.longest = pieces, max(map(len, pieces))
        bits = max(8, (8 * len(pieces)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        for i, name in enumerate(self.names):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in name:
                    h = h * BASE + np.uint64(ord(c) + 1)
                at = (h * MIX) >> self.shift
            while self.ids[at] >= 0:
                at = (at + np.uint64(1)) & self.mask
            self.keys[at], self.ids[at] = h, i

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The pieces' numbers of hashes, -1 for none."""
        at = (h * MIX) >> self.shift
        out, todo = self.ids[at], np.flatnonzero((self.ids[at] >= 0) & (self.keys[at] != h))
        while len(todo):  # the next places of those that met another piece
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            out[todo] = self.ids[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[at[todo]] != h[todo])]
        return out

    def arcs(self, codes: np.ndarray) -> np.ndarray:
        """arcs[w, j, k]: the number of the piece that ends after j + 1 characters and has k + 1; -1 without one."""
        n, size = codes.shape
        depth = min(self.longest, size)
        sums = np.zeros((n, size + 1), np.uint64)
        for j in range(size):
            sums[:, j + 1] = sums[:, j] * BASE + (codes[:, j].astype(np.uint64) + np.uint64(1))
        out, power = np.full((n, size, depth), -1, np.int32), np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(depth):
                power = power * BASE
                out[:, k:, k] = self.numbers((sums[:, k + 1 :] - sums[:, : size - k] * power).ravel()).reshape(n, size - k)
        lone = out[:, :, 0]
        lone[lone < 0] = len(self.names)
        return out

    def forward(self, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, weights): log sums of all ways to each place, and the arcs' log weights."""
        n, size, depth = arcs.shape
        weights = np.where(arcs >= 0, self.weights[arcs], -np.inf)
        out = np.zeros((n, size + 1))
        for j in range(size):
            k = min(j + 1, depth)
            terms = weights[:, j, :k] + out[:, j - k + 1 : j + 1][:, ::-1]
            top = terms.max(axis=1)
            out[:, j + 1] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
        return out, weights

    def blocks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indices, codes) of words of equal length, a bounded number of arcs at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for same in np.split(order, cuts) if len(order) else []:
            length = int(sizes[same[0]])
            if length > LONG:
                continue
            step = max(1, BLOCK_ARCS // ((length + 1) * min(self.longest, length + 1)))
            for at in range(0, len(same), step):
                some = same[at : at + step]
                yield some, _codes([words[i] for i in some.tolist()], length)

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for some, codes in self.blocks(words):
            out[some] = self.forward(self.arcs(codes))[0][:, -1]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = log_likelihood(w, self.pieces, self.longest)
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, times their counts."""
        uses, alone = np.zeros(len(self.names) + 1), {}
        for some, codes in self.blocks(words):
            arcs = self.arcs(codes)
            forward, weights = self.forward(arcs)
            n, size, depth = arcs.shape
            share = np.zeros((n, size + 1))
            share[:, -1] = counts[some]
            parts = np.zeros(arcs.shape)
            for j in range(size - 1, -1, -1):
                k = min(j + 1, depth)
                before = forward[:, j - k + 1 : j + 1][:, ::-1]
                part = share[:, j + 1, None] * np.exp(before + weights[:, j, :k] - forward[:, j + 1, None])
                parts[:, j, :k] = part
                share[:, j - k + 1 : j + 1] += part[:, ::-1]
            uses += np.bincount(np.where(arcs >= 0, arcs, len(self.names)).ravel(), parts.ravel(), len(uses))
        for w, c in zip(words, counts.tolist(), strict=True):
            if len(w) > LONG:
                expected_pieces(w, c, self.pieces, self.longest, alone)
        number = {p: i for i, p in enumerate(self.names)} if alone else {}
        for p, x in alone.items():
            uses[number[p]] += x
        return uses[:-1]


# --- counts, weights, scores ---------------------------------------------------------------------


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, those of about PIECE_BYTES at a time; no word is cut."""
    at = 0
    while at + PIECE_BYTES < len(text):
        end = at + PIECE_BYTES
        end = max(text.rfind(c, at, end) for c in (b" ", b"\n")) + 1 or min((x for x in (text.find(c, end) for c in (b" ", b"\n")) if x >= 0), default=len(text))
        yield text[at:end].lower().split()
        at = end
    yield text[at:].lower().split()


def word_counts(docs: DataFrame, held_out) -> DataFrame:
    """(word, c): training counts of all words of ``docs``, 0 for those of held-out documents only."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Counter = Counter()
        others: set = set()
        ends = taken = 0

        def flush() -> pa.RecordBatch:
            words = [*table, *(others - table.keys())]
            n = [*table.values(), *[0] * (len(words) - len(table))]
            out = pa.record_batch([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])
            table.clear()
            others.clear()
            return out

        for batch in slices(batches, "text"):
            held = batch.column("held").to_pylist()
            for h, t in zip(held, texts(batch.column("text")), strict=True):
                for some in pieces_of(t):
                    others.update(some) if h else table.update(some)
                    taken += sum(map(len, some))
                    if len(table) + len(others) >= TABLE_WORDS or taken >= TABLE_BYTES:
                        yield flush()
                        taken = 0
                ends += not h
        if ends:
            table[END.encode()] = ends
        yield flush()

    rows = docs.select(held_out.alias("held"), "text").mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


def fit_pieces(counts: DataFrame, pieces: dict[str, float]) -> dict[str, float]:
    """One round of expected counts over all training words; pieces it never uses keep a small weight."""
    shared = counts.sparkSession.sparkContext.broadcast(Lattices(pieces))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, uses = shared.value, 0.0
        for batch in batches:
            uses = uses + lattices.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(np.float64))
        used = np.flatnonzero(uses) if np.ndim(uses) else np.empty(0, np.int64)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(uses[used] if len(used) else [], pa.float64())], names=["piece", "n"])

    got = counts.where(F.col("c") > 0).where(F.col("word") != END).select("word", "c").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row a piece of the vocabulary at most
    if not len(got):
        return pieces
    prior = np.exp(np.array([*pieces.values()]))
    prior[got["piece"].to_numpy()] += got["n"].to_numpy()
    return dict(zip(pieces, np.log(prior / prior.sum()).tolist(), strict=True))


def discount(once: int, twice: int) -> float:
    """What is taken off every word's count, from the numbers of words seen once and twice."""
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5


def score_texts(docs: DataFrame, holdout: int = 10, vocabulary: str = VOCABULARY, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, subword_score, n_once of every row.

    subword_score is the log10 sum over the pieces' paths alone; n_once the tokens whose word occurs once in training.
    """
    spark = docs.sparkSession
    held_out = bucket_of(F.col("doc_id"), holdout) == 0
    counts = persist(word_counts(docs, held_out), "counts")
    known, is_end = F.col("c") > 0, F.col("word") == END
    n, v, ends, once, twice = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(known), F.coalesce(F.sum(F.when(is_end, F.col("c"))), F.lit(0)), F.count_if((F.col("c") == 1) & ~is_end), F.count_if((F.col("c") == 2) & ~is_end)).first()
    pieces = fit_pieces(counts, load_pieces(vocabulary))
    # the arcs' weights: a word's discounted count, and the way into the pieces
    d, n_words, v_words = discount(once, twice), n - ends, v - (ends > 0)
    into_pieces = d * v_words / n_words if n_words else 1.0
    p_end = (ends + 1) / (n + 2)
    shared = spark.sparkContext.broadcast(Lattices(pieces))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            end = np.array([w == END for w in words], bool)
            sub = math.log1p(-p_end) + shared.value.log_likelihoods(words)
            seen = c > 0
            whole = np.where(seen, math.log1p(-p_end) + np.log(np.where(seen, c - d, 1) / max(n_words, 1)), -np.inf)
            model = np.logaddexp(whole, sub + math.log(into_pieces))
            sub, model = (np.where(end, math.log(p_end), x) for x in (sub, model))
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            yield pa.record_batch([batch.column("word"), batch.column("c"), pa.array(base), pa.array(model / math.log(10)), pa.array(sub / math.log(10))], names=["word", "c", "base", "model", "sub"])

    table = persist(counts.mapInArrow(scored, "word string, c long, base double, model double, sub double"), "words")
    discard(counts)
    # the head: words whose count reaches the lowest eighth of an octave that keeps it within the bound
    octave = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(table.where(known).groupBy(octave.alias("o")).count().collect(), key=lambda r: -r[0])  # some hundred rows
    least, held = None, 0
    for o, k in sizes:
        if held + k > head_words:
            break
        least, held = o, held + k
    short = F.octet_length("word") <= 256  # bounds the bytes of the head as well
    is_head = known & short & (octave >= least) if least is not None else F.lit(False)
    is_head = is_head | is_end
    head = table.where(is_head).toArrow()
    # known, seen once, base, model, sub by row of the head; the end token stands last
    c = head.column("c").to_numpy()
    values = np.stack([c > 0, c == 1, *(head.column(x).to_numpy() for x in ("base", "model", "sub"))], 1) if len(c) else np.empty((0, 5))
    place = {w.encode(): i for i, w in enumerate(head.column("word").to_pylist())}
    if END.encode() not in place:  # no training documents
        values = np.concatenate([values, [[0, 0, math.log10(0.1 / (n + 0.1 * (v + 1))), math.log10(p_end), math.log10(p_end)]]])
        place[END.encode()] = len(values) - 1
    lookup = spark.sparkContext.broadcast((place, values))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        place, values = lookup.value
        end, get = values[place[END.encode()]], place.get
        for batch in slices(batches, "text", PIECE_BYTES):
            ids, helds = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
            for i, t in enumerate(texts(batch.column("text"))):
                ends_here = True
                for some in pieces_of(t):
                    tally = Counter(some)
                    times = np.fromiter(tally.values(), np.int64, len(tally))
                    at = np.fromiter((get(w, -1) for w in tally), np.int64, len(tally))
                    sums = times[at >= 0] @ values[at[at >= 0]] + ends_here * end
                    tail = np.flatnonzero(at < 0).tolist()
                    words = list(tally)
                    yield (row, ids[i], helds[i], len(some) + ends_here, sums, [words[j] for j in tail], times[at < 0])
                    ends_here = False
                row += 1

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of ``summed``, many at a time: one row per piece of text with its sums, one per word of the tail."""
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            k, sums = len(held), np.array([x[4] for x in held]).reshape(-1, 5)
            tails = np.fromiter((len(x[5]) for x in held), np.int64, k)
            none = pa.nulls(int(tails.sum()))
            rows = np.fromiter((x[0] for x in held), np.int64, k)
            words = [w for x in held for w in x[5]]
            both = lambda a, kind: pa.concat_arrays([a.cast(kind), none.cast(kind)])
            return pa.record_batch(
                [
                    pa.array(np.concatenate([rows, np.repeat(rows, tails)])),
                    both(pa.array([x[1] for x in held], pa.int64()), pa.int64()),
                    both(pa.array([x[2] for x in held], pa.bool_()), pa.bool_()),
                    pa.concat_arrays([pa.nulls(k).cast(pa.string()), pa.array(words, pa.binary()).cast(pa.string())]),
                    pa.array(np.concatenate([np.fromiter((x[3] for x in held), np.int64, k), *(x[6] for x in held)])),
                    *(both(pa.array(sums[:, j].astype(np.int64)), pa.int64()) for j in (0, 1)),
                    *(both(pa.array(sums[:, j]), pa.float64()) for j in (2, 3, 4)),
                ],
                names=["row", "doc_id", "held", "word", "n", "known", "once", "base", "model", "sub"],
            )

        for x in summed(batches):
            held.append(x)
            size += 1 + len(x[5])
            if size >= 50_000:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    schema = "row long, doc_id long, held boolean, word string, n long, known long, once long, base double, model double, sub double"
    rows = persist(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), "text").mapInArrow(batched, schema), "sums")
    scores = ("base", "model", "sub")
    tail = rows.where("word is not null").select("row", "word", "n").join(table.where(~is_head).select(F.col("word").alias("w"), "c", *scores), F.col("word") == F.col("w"))
    n_if = lambda x: F.when(x, F.col("n")).otherwise(0)
    none = F.lit(None)
    tail = tail.select("row", none.cast("long").alias("doc_id"), none.cast("boolean").alias("held"), F.lit(0).cast("long").alias("n"), n_if(known).alias("known"), n_if(F.col("c") == 1).alias("once"), *((F.col("n") * F.col(x)).alias(x) for x in scores))
    # sums of doubles depend on their order; rounded, they agree from run to run
    parts = tail.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held"), *(F.sum(x).alias(x) for x in ("n", "known", "once", *scores)))
    by_row = parts.unionByName(rows.where("word is null").drop("word")).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held"), *(F.sum(x).alias(x) for x in ("n", "known", "once")), *(F.round(F.sum(x), 9).alias(x) for x in scores))
    return by_row.select("doc_id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"), F.col("sub").alias("subword_score"), F.col("once").alias("n_once"))
