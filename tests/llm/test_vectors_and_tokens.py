"""Vector codes, whitening and BPE against brute force, and their edge cases."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import bpe, codes, queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (None, [0.5] * 32, None),
    (7, [0.25] * 32, 1),
    (7, [0.125] * 32, 1),
    (7, [0.125] * 32, 1),
    (-1, None, 1),
    (-2, [], 1),
    (-3, [float("nan")] + [0.0] * 31, 1),
    (-4, [float("inf")] + [0.0] * 31, 1),
    (-5, [None] + [0.0] * 31, None),
    (-6, [1.0] * 16, 3),
    (900, [-3.0, 1000.0] * 16, 3),
]


def made(n, hot=0):
    g = np.random.default_rng(5)
    x = (g.normal(size=(n, 32)) * np.linspace(0.05, 0.6, 32)).astype(np.float32)
    rows = [(i + 10, v.tolist(), None if i % 11 == 0 else i % 5) for i, v in enumerate(x)]
    return rows + [(5_000 + i, x[0].tolist(), 2) for i in range(hot)]


def table(spark, rows):
    clash = ("codes", "code", "error", "order", "low", "points", "_label", "_none", "at", "n", "component", "r", "label_error")
    return spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in clash}).repartition(3)


def good(rows):
    """The kept rows in the order of first entries, as matrix of floats."""
    kept = [r for r in rows if r[1] and len(r[1]) == 32 and all(c is not None and np.isfinite(c) for c in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(c)) for c in r[1]]))
    return kept, np.array([r[1] for r in kept], np.float32).astype(float)


def brute_codes(rows, parts, entries, rounds):
    kept, x = good(rows)
    x = np.floor(256 * x).astype(np.int64)
    w = 32 // parts
    books = [x[:entries, w * i : w * i + w].copy() for i in range(parts)]

    def nearest(i):
        d2 = ((x[:, None, w * i : w * i + w] - books[i][None]) ** 2).sum(2)
        return d2.argmin(1), d2.min(1)

    for _ in range(rounds):
        for i in range(parts):
            c, _ = nearest(i)
            for k in set(c.tolist()):
                books[i][k] = x[c == k, w * i : w * i + w].sum(0) // (c == k).sum()
    found = [nearest(i) for i in range(parts)]
    return sorted((str(r[0]), tuple(int(f[0][j]) for f in found), int(sum(f[1][j] for f in found)), str(r[2])) for j, r in enumerate(kept)), books


@pytest.mark.parametrize("n, hot, parts, entries", [(700, 0, 16, 64), (300, 400, 8, 64), (20, 0, 16, 64), (150, 0, 16, 3)])
def test_codes_equal_brute_force(spark, monkeypatch, n, hot, parts, entries):
    monkeypatch.setattr(codes, "BLOCK", 256)
    rows = made(n, hot) + ODD
    coded, books = codes.quantize(table(spark, rows), parts, entries, 2, 256.0)
    want, want_books = brute_codes(rows, parts, entries, 2)
    assert all((a == b).all() for a, b in zip(books, want_books, strict=True))
    got = codes.label_errors(coded).collect()
    assert sorted((str(r.vec_id), tuple(r.codes), r.error, str(r.label)) for r in got) == want
    for r in got:
        assert r.label_error == sum(e for _, _, e, label in want if label == str(r.label))
    assert codes.codebooks_digest(books) == hashlib.sha256(",".join(str(v) for b in want_books for v in b.ravel()).encode()).hexdigest()


def test_trees_hold_their_points():
    x = np.random.default_rng(1).integers(-50, 50, (777, 3))
    x[100:400] = x[0]
    order, low, high, sums = codes.build(x)
    assert sorted(order.tolist()) == list(range(777))
    base = 0
    for level in range(codes.depth(777) + 1):
        at = codes.bounds(777, level)
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            p = x[order[a:b]]
            assert (low[base + i] == p.min(0)).all() and (high[base + i] == p.max(0)).all() and (sums[base + i] == p.sum(0)).all()
        base += 1 << level
    book = np.unique(np.random.default_rng(2).integers(-50, 50, (20, 3)), axis=0)
    book = np.vstack([book, book[:3]])  # equal entries: the lower index has all
    found = np.zeros(777, np.int64)
    counts, _ = codes.filtered((low, high, sums), x[order], book, found)
    d2 = ((x[order][:, None] - book[None]) ** 2).sum(2)
    assert (found == d2.argmin(1)).all() and counts.tolist() == np.bincount(found, minlength=len(book)).tolist()


def test_few_comparisons_reach_points(monkeypatch):
    """Whole subtrees are assigned: fewer pairs of point and entry are compared than brute force compares."""
    compared, real = [0], codes.nearest_of
    monkeypatch.setattr(codes, "nearest_of", lambda owner, *a: (compared.__setitem__(0, compared[0] + len(owner)), real(owner, *a))[1])
    x = np.random.default_rng(3).integers(-300, 300, (4096, 2))
    order, *tree = codes.build(x)
    codes.filtered(tuple(tree), x[order], x[:64])
    assert compared[0] < 4096 * 64 / 8


def test_codes_of_odd_lengths(spark):
    rows = [(i, [float(i)] * 5, i) for i in range(9)]
    coded, books = codes.quantize(spark.createDataFrame(rows, VECTORS), parts=16, entries=4)
    assert [b.shape[1] for b in books] == [1] * 5 + [0] * 11
    assert {len(r.codes) for r in coded.collect()} == {16}
    huge, _ = codes.quantize(spark.createDataFrame([(i, [3e38 * (i % 2), -3e38]) for i in range(4)], "vec_id long, embedding array<float>").withColumn("label", F.lit(None).cast("string")), parts=2, entries=2)
    assert [r.error for r in huge.collect()] == [0] * 4


def test_whitening_equals_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 50)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = made(400, hot=200) + ODD
    got = whitening.whitened_components(table(spark, rows)).toPandas()
    kept, x = good(rows)
    x = np.floor(64 * x).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total, strict=True)) for row in x]
    c = (n * x - total) / n
    e, vectors = np.linalg.eigh(c.T @ c / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    assert len(got) == 32 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), e / e.sum(), rtol=1e-9)
    assert sorted(got[got.component == 1].deviation) == sorted(exact)
    want = np.abs(c @ vectors / np.sqrt(e))
    assert np.allclose(np.sort(np.abs(got.pivot_table(index="vec_id", columns="component", values="whitened", aggfunc="first").loc[900])), np.sort(want[[r[0] for r in kept].index(900)]), atol=1e-6)
    assert np.allclose(sorted(got[got.component == 3].whitened.abs()), sorted(want[:, 2]), atol=1e-7)


def test_small_deviations_keep_their_digits():
    g = np.random.default_rng(4)
    q, _ = np.linalg.qr(g.normal(size=(12, 12)))
    sigma = np.logspace(6, -6, 12)
    u, _ = np.linalg.qr(g.normal(size=(500, 12)))
    components, norms = whitening.jacobi(np.linalg.qr(u * sigma @ np.eye(12), mode="r"))
    assert np.allclose(norms, sigma, rtol=1e-9)
    components, norms = whitening.jacobi(np.linalg.qr(u * sigma @ q.T, mode="r"))
    assert np.allclose(components.T @ components, np.eye(12), atol=1e-12) and np.allclose(norms[:6], sigma[:6], rtol=1e-6)


def test_whitening_without_spread(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 1)], VECTORS)
    equal = spark.createDataFrame([(i, [0.3, 2.0], 1) for i in range(50)], VECTORS)
    flat = spark.createDataFrame([(i, [float(i), 2.0], 1) for i in range(50)], VECTORS)
    assert whitening.whitened_components(one).count() == 0 and whitening.whitened_components(equal).count() == 0
    assert {r.component for r in whitening.whitened_components(flat).collect()} == {1}
    far = spark.createDataFrame([(i, [1e11 * i, 1.0 * (i % 7)], 1) for i in range(50)], "vec_id long, embedding array<double>, label int")
    got = whitening.whitened_components(far).collect()
    assert len(got) == 100 and all(r.deviation is None and np.isfinite(r.whitened) for r in got)


TEXTS = [None, "", " ", "a", "Hello  world, it's 2024!\n\n", "<|endoftext|>x <|endoftext|><|endoftext|>", "naïve café 日本語 ①½² 😀👍🏽", "\x00\x1c\x85  \t", "ՙ ՘ ꟎ \U00010940", "ab" * 3000, "x" * 70_000, " " * 5000 + "y", ".,!?" * 800]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_bpe_equals_the_library(spark, library):
    rng = random.Random(2)
    pool = ["abcdefgh THE the 's't'll 'd  \n\t", "éüñ日本한العربية①½²", "😀👍🏽", "0123456789.,;!?-_#", "՘꟎\x85"]
    texts = TEXTS + TEXTS[:5] + ["".join(rng.choice(rng.choice(pool)) for _ in range(rng.randint(1, 300))) for _ in range(300)]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "x", "y", "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded string, n_tokens string").repartition(3)
    for size in (1 << 19, 5):
        got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in bpe.encode_and_decode(docs, PATH, size).collect())
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert got == sorted((str(None if i == 3 else i), ids, library.decode(ids, skip_special_tokens=False)) for i, ids in enumerate(want))
        assert all(a[2] == (texts[3 if a[0] == "None" else int(a[0])] or "") for a in got)


def test_bpe_query(spark, library, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op13_bpe_coding(spark, str(tmp_path)).collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


def test_one_very_long_piece_and_text(library):
    vocabulary, rng = bpe.Vocabulary.load(PATH), random.Random(1)
    word = "".join(rng.choices("abcdefghijklmnop", k=200_000))
    began = time.time()
    assert vocabulary.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids
    assert time.time() - began < 60
    text = " ".join("".join(rng.choices("etaoin", k=4)) for _ in range(300_000))
    assert len(list(vocabulary.slices(text, 1 << 16))) > 10 and "".join(vocabulary.slices(text, 1 << 16)) == text
    assert vocabulary.decode(vocabulary.encode(text, 1 << 16).tolist()) == text


def test_stale_entries_are_skipped():
    """Ranks are of pairs of ids: two ways to the same string aren't taken for each other."""
    strings = [b"a", b"b", b"c", b"bc", b"ab", b"abc", *(bytes([b]) for b in range(256))]
    of_byte = [b - 97 if b in b"abc" else 6 + b for b in range(256)]
    v = bpe.Vocabulary(strings, {(1, 2): 0, (0, 1): 1, (4, 2): 2}, [3, 4, 5], of_byte, {})
    assert v.merge(b"abc") == (0, 3) and v.merge(b"ab") == (4,) and v.merge(b"abcabab") == (0, 3, 4, 4)


def test_empty_tables_of_vectors_and_texts(spark):
    none = table(spark, []).where("false")
    assert codes.label_errors(codes.quantize(none)[0]).count() == 0 and whitening.whitened_components(none).count() == 0
    assert codes.quantize(table(spark, ODD[4:9]))[0].count() == 0
    assert bpe.encode_and_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
