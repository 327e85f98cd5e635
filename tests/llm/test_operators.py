"""The training-data operators against brute force, and their edge cases."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import archives, decontaminate, exact_dedup, golay, html_text, language_id, lm_scoring, mixing, quality, repeats, simhash

DOCS = "doc_id long, text string, lang string, source string"
rng = random.Random(1)
VOCABULARY = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def rows():
    base = [prose(rng.randint(3, 150)) for _ in range(60)]
    texts = [*base, *base[:10], base[0], base[0]]
    for t in base[10:30]:  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", "  \n ", "x", "A b.", "é" * 300, "to " * 400, prose(5000), "?!"]
    out = [(i, t, ("en", "de")[i % 2], None if i % 9 == 0 else f"s{i % 4}") for i, t in enumerate(texts)]
    return [*out, out[3], (None, base[4], None, "s1"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = F.lit("x")
    named = ("digest", "sha", "run", "fp", "key", "range", "h", "tid", "word", "held", "row", "n", "r", "s", "t", "label", "id", "rank", "score")
    return spark.createDataFrame(rows, DOCS).withColumns({c: clash for c in named}).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def u(t):
    return (t or "").encode()


def test_golay_neighbours_share_a_codeword():
    x = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    near = golay.near(x)
    for bit in range(23):
        assert (golay.nearest(x ^ (1 << bit))[:, None] == near).any(axis=1).all()


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_simhash_components(docs, rows, block):
    got = simhash.near_dedup(docs, block=block).collect()
    assert len(got) == len(rows)
    prints = {(i, t): simhash.simhash(u(t)) for i, t, *_ in rows}
    nodes = sorted(set(prints.values()))
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(nodes):
        for y in nodes[i + 1 :]:
            if (x ^ y).bit_count() <= 4:
                parent[find(x)] = find(y)
    least = defaultdict(list)
    for (i, _), x in prints.items():
        if i is not None:
            least[find(x)].append(i)
    want = Counter((i, f"{x:016x}", min(least[find(x)], default=None)) for (i, t), x in prints.items() for _ in range(sum(r[:2] == (i, t) for r in rows)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash_links_within_four_bits(spark):
    r = np.random.default_rng(2)
    seeds = r.integers(0, 1 << 63, 40)
    found = []
    for x in seeds.tolist():
        for _ in range(20):
            y = x
            for b in r.choice(63, r.integers(0, 5), replace=False).tolist():
                y ^= 1 << b
            found.append((y,))
    nodes = spark.createDataFrame(sorted(set(found)), "fp long")
    from quern.llm.common import components

    roots = {r.node: r.root for r in components(simhash.links(nodes, block=50)).collect()}
    for i, (x,) in enumerate(sorted(set(found))):
        for (y,) in sorted(set(found))[:i]:
            if (x ^ y).bit_count() <= 4:
                assert roots[x] == roots[y]


def test_decontaminate(spark, docs, rows):
    items = [(1, rows[0][1]), (2, "x"), (3, None), (4, "?!"), (10, " ".join((rows[1][1] or "").split()[:20])), (5, prose(40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: decontaminate.words_of(u(t))
    want = Counter()
    for i, t, *_ in rows:
        w, hit, names = words(t), set(), set()
        for name, q in items:
            v = words(q)
            k = min(13, len(v))
            grams = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if v else set()
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in grams:
                    hit |= set(range(a, a + k))
                    names.add(str(name))
        want[i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    for block in (4 << 20, 50):
        assert Counter(map(tuple, decontaminate.decontaminate(docs, bench, block_bytes=block).collect())) == want
        clean = decontaminate.drop_contaminated(docs.select(docs.columns), bench, block_bytes=block)
        assert clean.columns == docs.columns
    twice = spark.createDataFrame([*items, (7, rows[0][1]), (8, rows[0][1])], "item_id long, text string")
    found = Counter(r.item_id for r in decontaminate.longest_matches(docs, twice).collect())
    assert found["1"] == found["7"] == found["8"] > 0
    assert decontaminate.longest_matches(docs, bench).where("item_id = '1'").agg(F.max("length")).first()[0] >= len(words(rows[0][1]))


@pytest.mark.parametrize("text", [b"", b"aB", b"Abc" * 4096, b"abC" * 4096, b"abcdeF" * 5000, b"x" * 20000 + b"Y" * 20000, ("é" * 9 + "É").encode() * 3000])
def test_style_counts_capitals_of_whole_texts(text):
    assert quality.style(text)[2] == pytest.approx(sum(0x41 <= c <= 0x5A for c in text) / max(1, len(text)))


def test_quality_holds_out_and_learns(spark, docs, rows):
    good = [(i, prose(80), 1) for i in range(200)]
    bad = [(1000 + i, " ".join([rng.choice(VOCABULARY).upper() + "!!"] * 60), 0) for i in range(200)]
    table = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(table, labels, per_label=100).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([got[i].predicted == y for i, _, y in good + bad if got[i].held_out]) > 0.97
    assert quality.keep_quality(table, labels, per_label=100).count() == sum(r.predicted for r in got.values())
    edge = quality.quality_scores(docs, labels, per_label=50).collect()
    assert len(edge) == len(rows) and all(0 <= r.score <= 1 for r in edge)
    assert {r.score for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}


def test_quality_learns_from_each_sampled_id(spark):
    ids = [(i, i % 2) for i in range(40)]
    once = [(i, prose(30)) for i, _ in ids]
    labels = spark.createDataFrame(ids, "doc_id long, quality int")
    fit = lambda rows: quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, per_label=10)
    want = fit(once)
    sampled = next(i for i, _ in ids if len(fit(once[i : i + 1]).labels))
    for rows in ([once[sampled]] * 200 + once, once + [once[sampled]] * 200):
        got = fit(rows)
        assert got.labels.tolist() == want.labels.tolist() == [0.0] * 10 + [1.0] * 10
        assert np.allclose(got.vectors @ got.vectors.T, want.vectors @ want.vectors.T, atol=1e-4)


def test_quality_votes_equal_brute_force():
    r = np.random.default_rng(4)
    texts = [prose(int(n)).encode() for n in r.integers(1, 60, 120)] + [b"", b" ", b"x"]
    labels = r.integers(0, 2, 80)
    together = quality.features(texts)
    assert all((quality.features([t])[0] == x).all() for t, x in zip(texts, together, strict=True))  # whatever the block
    model = quality.Model.fit(together[:80], labels, dimensions=12, neighbours=5)
    got = model.score(texts)
    vectors = [quality._unit(model.weighted(quality.features([t])) @ model.projection)[0] for t in texts]
    for x, score in zip(vectors, got, strict=True):
        cosines = sorted(((sum(a * b for a, b in zip(x.tolist(), v.tolist(), strict=True)), y) for v, y in zip(model.vectors, labels, strict=True)), reverse=True)[:5]
        weights = [max(c, 0.0) ** 8 for c, _ in cosines]
        want = sum(w * y for w, (_, y) in zip(weights, cosines, strict=True)) / sum(weights) if sum(weights) > 1e-12 else model.prior
        assert score == pytest.approx(want, abs=1e-3)


DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    known = labels.where("quality in (0, 1)")
    found = quality.quality_scores(docs, labels).where("held_out").join(known, "doc_id").select("score", "predicted", "quality").toPandas()
    assert len(found) > 40 and (found.predicted == found.quality).mean() > 0.95
    good, bad = (found.score[found.quality == y].to_numpy() for y in (1, 0))
    assert (good[:, None] > bad).mean() > 0.98
    names = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(names) > 200 and (names.lang_pred == names.lang).mean() > 0.99


def test_pages_follow_their_template(spark):
    import html as H
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    checked = 0
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if not article:
            continue
        body = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->|<div class=.?ad.?>.*?</div>", "", article[1], flags=re.S)
        blocks = re.split(r"</?(?:h1|h2|h3|p|ul|ol|li|div|table|tr|td|th|blockquote|pre)\b[^>]*>", re.sub(r"<br\s*/?>", " ", body))
        want = "\n".join(x for x in (" ".join(H.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)
        checked += 1
        assert got[r.page_id] == want, r.page_id
    assert checked > 200


def test_a_long_text_among_short_ones(spark):
    long = " ".join(f"w{i * 7919 % 9973}" for i in range(700_000))  # some 4 MB, beyond a slice
    rows = [(1, "a few words", "en", "s"), (2, long, "en", "s"), (3, "", "en", "s"), (4, long, "en", "s"), (5, long[:3000], "de", "s"), (6, None, "de", "s")]
    table = spark.createDataFrame(rows, DOCS).coalesce(1)
    prints = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_dedup(table).collect()}
    assert prints[2] == prints[4] == (f"{simhash.simhash(long.encode()):016x}", 2) and prints[3] == prints[6]
    bench = spark.createDataFrame([(9, long[-200:])], "item_id long, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit > 0) for r in decontaminate.decontaminate(table, bench).collect()}
    assert hits[2] == hits[4] == (700_000, True) and not hits[1][1]
    assert {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(table, "largest").collect()} == {1: (1, True), 2: (4, False), 3: (6, False), 4: (4, True), 5: (5, True), 6: (6, True)}
    assert {r.doc_id: r.size for r in mixing.mix(table).collect()}[2] == 700_000
    assert len(language_id.identify(table).collect()) == len(quality.quality_scores(table, spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")).collect()) == 6
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.repeated_bytes(table).collect()}
    assert gone[2] == gone[4] == (len(long), len(long)) and gone[5] == (3000, 3000) and gone[1][1] == gone[3][1] == 0
    assert {r.doc_id: r.n_tokens for r in lm_scoring.score_texts(table).collect()}[4] == 700_001
    pages = table.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert {r.page_id: r.n_chars for r in html_text.extract_text(pages).collect()}[2] == len(long)
    archived = {r.page_id: (r.record_type, r.refers_to) for r in archives.archive_round_trip(pages).collect()}
    assert archived[2] == ("revisit", 4) and archived[4] == ("response", None)


def test_mixing_meets_targets(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(r.size for r in got)
    assert sum(x[0].target for x in by.values()) == pytest.approx(total)
    for x in by.values():
        assert x[0].source_size == sum(r.size for r in x) and abs(sum(r.taken for r in x) - x[0].target) <= 0.5
        assert x[0].target <= 3 * x[0].source_size


def test_targets_are_the_filling(spark):
    sizes = [("a", 10), ("b", 100), ("c", 3), ("d", 500), (None, 1), ("e", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: i % 3 + 1 for i, (s, _) in enumerate(order)}
    full, size = {}, dict(sizes)
    while True:
        left, free = sum(size.values()) - sum(full.values()), [s for s in size if s not in full]
        want = full | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if want[s] > 3 * size[s]]
        if not over:
            break
        full |= {s: 3 * size[s] for s in over}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &amp; simple", "plain & simple"),
    ("<html><body><nav>menu</nav><article><h1>T&eacute;</h1><p>One\n two.<br>Three.<p>Four<div class='ad'>buy</div></article><div id=comments><p>I say</p></div><footer>f</footer>", "Té\nOne two. Three.\nFour"),
    ("<body><div class=menu>x</div><div><p>A long paragraph, with some words.</p><p>Another one, as long as that.</p><ul><li>a<li>b</ul></div><aside>no</aside>", "A long paragraph, with some words.\nAnother one, as long as that.\na\nb"),
    ("<script>var a='<p>x</p>'</script><style>p{}</style><!-- c --><p>only</p><form>q <input></form>", "only"),
])
def test_html_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("passes", [1, 3])
def test_decontaminate_in_many_passes(spark, monkeypatch, passes):
    """Items of a block each, with the marks written between passes: the result of one pass."""
    monkeypatch.setattr(decontaminate, "PASSES", passes)
    items = [(i, f"{prose(20 + i)} item {i}") for i in range(7)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"{prose(30)} {items[i % 7][1]} {items[i % 3][1]} {prose(10 * i)}" for i in range(9)] + [None, "", prose(40)]
    table = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    one = decontaminate.decontaminate(table, bench).collect()
    assert sorted(one) == sorted(decontaminate.decontaminate(table, bench, block_bytes=50).collect())
    assert {r.doc_id for r in decontaminate.drop_contaminated(table, bench, block_bytes=50).collect()} == {r.doc_id for r in one if not r.contaminated}


@pytest.mark.parametrize("before", [-90, -40, -13, -1, 0, 1])
def test_matches_across_pieces_of_a_long_text(before):
    """A text is read in pieces of a megabyte; a passage over a cut is found, at its place."""
    item = " ".join(f"q{i}" for i in range(30)).encode()
    filler = (b"pq-" * (1 << 19))[: (1 << 20) + before]
    text = filler + b"." + item + b"; " + filler + b" " + item
    q = decontaminate.Queries.of([("a", item)], 13)
    ends, query, place, doc = decontaminate.shard_matches([b"x y", text, b""], q)
    words = decontaminate.words_of(text)
    at = [i for i in range(len(words)) if words[i : i + 13] in [item.split()[j : j + 13] for j in range(18)]]
    assert ends.tolist() == [2, 2 + len(words), 2 + len(words)] and sorted((place - 2).tolist()) == at and len(at) == 36 and set(doc.tolist()) == {1}


@pytest.mark.parametrize("block", [4 << 20, 50])
@pytest.mark.parametrize("share", [20, 2])
def test_drop_contaminated_by_row(spark, block, share):
    passage, clean, part = prose(40), prose(60), prose(150)
    found = [(None, passage), (1, passage), (1, clean), (None, clean), (2, clean), (2, f"{part} {passage}"), (3, None)]
    table = spark.createDataFrame([(i, t, "en", "s") for i, t in found], DOCS)
    bench = spark.createDataFrame([(1, passage), (2, prose(50))], "item_id long, text string")
    left = decontaminate.drop_contaminated(table, bench, share=share, block_bytes=block).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter(x for x in found if passage not in (x[1] or "") or share == 2 and x[1] != passage)


def test_drop_near_copies_by_row(spark):
    one, two, three, four, five = (prose(80) for _ in range(5))
    found = [(None, one), (None, one.upper()), (None, one), (1, two), (1, two.upper()), (2, two), (1, two), (3, three), (4, three), (4, four), (None, four.upper()), (None, five), (6, five), (6, five)]
    left = [(r.doc_id, r.text.lower()) for r in simhash.drop_near_copies(spark.createDataFrame([(i, t, "en", "s") for i, t in found], DOCS).repartition(3)).collect()]
    assert Counter(left) == Counter([(None, one), (1, two), (3, three), (4, four), (6, five)])


LONG = "A long paragraph, with words. " * 170


@pytest.mark.parametrize("html, text", [
    (f"<body><div><h1>T</h1><p>{LONG}</p><p>short</p></div></body>", ["T", LONG, "short"]),
    (f"<body><div><h1>T</h1><section><p>{LONG}</p></section><ul><li>a<li>b</ul></div></body>", ["T", LONG, "a", "b"]),
    (f"<body><div><h1>T</h1><ul><li>{LONG}<li>b</ul><p>c</p></div></body>", ["T", LONG, "b", "c"]),
    (f"<body><div><h1>T</h1><table><tr><td>{LONG}<td>b</table><p>c</p></div></body>", ["T", LONG, "b", "c"]),
    (f"<body><div><p>{LONG}</p><p>x</p></div><div><h2>U</h2><p>{LONG[:300]}</p></div></body>", [LONG, "x", "U", LONG[:300]]),
    (f"<body><div><p>{LONG}</p><p>x</p></div><div>side</div></body>", [LONG, "x"]),
    (f"<body><article><h2>T</h2><p>{LONG}</p></article><div>side</div><article><h2>U</h2><p>{LONG[:300]}</p></article></body>", ["T", LONG, "U", LONG[:300]]),
    (f"<body><main><article><p>{LONG}</p></article><p>x</p></main><div>side</div></body>", [LONG, "x"]),
])
def test_html_text_is_whole(html, text):
    assert html_text.main_text(html) == "\n".join(x.strip() for x in text)


@pytest.mark.parametrize("html, text", [
    (f'<body><div class="overflow-hidden"><h1>T</h1><p>{LONG}</p></div></body>', ["T", LONG]),
    (f'<body><form id="aspnetForm"><input type=hidden><div class="sidebar"><p>side, text.</p></div><div><h1>T</h1><p>{LONG}</p></div></form></body>', ["T", LONG]),
    (f'<body><div class="notice-board-post"><h1>T</h1><p>{LONG}</p></div></body>', ["T", LONG]),
    (f'<body><div class="social-science"><p>{LONG}</p></div><p>Copyright.</p></body>', [LONG]),
    (f'<body><div class="article-header"><h1>T</h1></div><div class="b"><p>{LONG}</p><p>x</p></div></body>', ["T", LONG, "x"]),
    (f'<body><article><div class="article-header"><h1>T</h1></div><div class="b"><p>{LONG}</p><p>x</p></div></article></body>', ["T", LONG, "x"]),
    (f'<body><div class="no-sidebar"><div id="main-nav"><a>a</a></div><div class=c><h1>T</h1><p>{LONG}</p><ul><li>z</ul></div><div class="comments-list"><p>{LONG}</p></div></div></body>', ["T", LONG, "z"]),
    (f'<body><header><h1>Site</h1></header><div><p>{LONG}</p></div><div class="comments"><p>{LONG * 9}</p></div></body>', [LONG]),
    ('<body><div class="ad">A long advert, longer than the article.</div><article><h1>T</h1><p>One.</article></body>', ["T", "One."]),
    (f'<body><p>{LONG}<span class="ad">buy</span> on</p><div hidden>no</div><div style="display: none">no</div></body>', [LONG + " on"]),
    (f'<body><div data-x="a>b" title=\'<p>no</p>\'><p>{LONG}</p></div', [LONG]),
])
def test_html_text_by_nodes(html, text):
    assert html_text.main_text(html) == "\n".join(x.strip().replace("  ", " ") for x in text)


def test_path_ratios():
    r = np.random.default_rng(5)
    for _ in range(20):
        blocks = [(int(p), "word, " * int(n) + "x") for p, n in zip(r.integers(0, 6, 30), r.integers(0, 9, 30), strict=True)]
        order = list(dict.fromkeys(p for p, _ in blocks))
        of = {p: [t for q, t in blocks if q == p] for p in order}
        length = [sum(map(len, of[p])) / len(of[p]) for p in order]
        marks = [(1 + sum(t.count(",") for t in of[p])) / len(of[p]) for p in order]
        total = sum(len(t) for _, t in blocks)
        want = {}
        for i, p in enumerate(order):
            a, b = max(0, i - 1), min(len(order) - 1, i + 1)
            x, y = (0.15 * v[a] + 0.7 * v[i] + 0.15 * v[b] for v in (length, marks))
            want[p] = (x * y) ** 0.5 * (sum(map(len, of[p])) / total) ** 0.5
        assert html_text.path_ratios(blocks) == pytest.approx(want)


@pytest.mark.parametrize("piece", ["<div>", "<div>x", "<a '", '<a ="', "<a ", "<p>x", "<span>x", "<!", "</b>", "<ul><li>", "<b><p>", "<div class='a' ", "</", "<script", "<table><tr><td>"])
def test_html_text_takes_linear_time(piece):
    began = time.process_time()
    html_text.main_text(piece * 100_000)
    assert time.process_time() - began < 20


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é b</p>", "x"), (None, None, None, "y"), (1, "u", "<p>é b</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract_text(pages).collect()), key=str) == sorted([(1, "u", "é b", 3), (1, "u", "é b", 3), (None, None, "", 0)], key=str)


def brute_repeats(rows, width):
    places = Counter(u(t)[k : k + width] for _, t, *_ in rows for k in range(len(u(t)) - width + 1))
    want = Counter()
    for i, t, *_ in rows:
        b = u(t)
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if places[b[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return want


@pytest.mark.parametrize("width, gram, group, piece", [(200, 64, 50_000, 1 << 20), (200, 64, 2, 3000), (40, 16, 5, 1 << 20), (12, 12, 3, 500)])
def test_repeated_bytes(spark, docs, rows, monkeypatch, width, gram, group, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    passage = prose(80)
    more = [(900 + k, f"{prose(k)} {passage[k:]} {prose(30)}", "en", "s") for k in range(12)]
    more += [(950, "\x00" * 700 + passage, "en", "s"), (951, passage[5:300] + "\x00" * 230, "en", "s"), (952, ("ab" * 150) + "c" + ("ba" * 120), "en", "s")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, DOCS).select("doc_id", "text"))
    got = repeats.repeated_bytes(table, width, gram, group).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_repeats([*rows, *more], width)
    assert all(sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed for r in got)


def test_radix_order_is_that_of_the_suffixes():
    r = np.random.default_rng(3)
    strings = [bytes(r.integers(97, 99, 40).astype(np.uint8)) for _ in range(300)]
    strings += strings[:40] + [strings[0][:30] + b"\xff" * 10, b"\x00" * 40, b"\xff" * 40]
    group = np.sort(r.integers(0, 4, len(strings)))
    digits = repeats._digits(np.frombuffer(b"".join(strings), np.uint8), np.arange(len(strings)) * 40, np.full(len(strings), 40), 40, 1)
    order, common = repeats.radix_order(group, digits)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings, strict=True))
    for k in range(1, len(order)):
        (i, j), same = order[k - 1 : k + 1], 0
        while same < 40 and strings[i][same] == strings[j][same]:
            same += 1
        assert common[k] == (same if group[i] == group[j] else -1)


def test_language_id(spark, docs, rows):
    two = [(i, " ".join(rng.choices(["und", "der", "keit", "nicht"] if i % 2 else ["the", "of", "with", "and"], k=30)), "de" if i % 2 else "en") for i in range(120)]
    table = spark.createDataFrame(two, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(table).collect()}
    assert all(got[i].lang_pred == x and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, x in two)
    edge = language_id.identify(docs).collect()
    assert len(edge) == len(rows) and all(0 <= r.score <= 1 for r in edge)
    unlettered = {i for i, t, *_ in rows if not any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in edge if r.lang_pred == "und"} == unlettered


def grams(text):
    row = b" " + bytes(32 if 9 <= x <= 13 else x for x in u(text).lower()) + b" "
    return [row[k : k + 4] for k in range(len(row) - 3)]


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_language_id_equals_sets_of_grams(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK_BYTES", block)
    members = defaultdict(set)
    for i, t, lang, _ in rows:
        if lang and zlib.crc32(("" if i is None else str(i)).encode()) % 3 != 1:
            members[lang] |= set(grams(t))
    names = sorted(members)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        found = grams(t)
        shares = [sum(g in members[x] for g in found) / max(1, len(found)) for x in names]
        ok = any(c.isalpha() for c in t or "")
        want.append((i, names[int(np.argmax(shares))] if ok else "und", max(shares) if ok else 0.0))
    want.sort(key=str)
    close = [a[0] == b[0] and abs(a[2] - b[2]) < 0.01 for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True)]
    assert all(close)
    assert sum(a[1] != b[1] for a, b in zip(got, want, strict=True)) <= 2  # near ties of shares


def test_language_id_of_lone_rows(spark):
    table = spark.createDataFrame([(i, None if i == 7 else "" if i == 8 else "a" if i == 9 else "the text and so on", "en", "s") for i in range(31)], DOCS).repartitionByRange(31, "doc_id")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(table).collect()}
    assert got == {i: "und" if i in (7, 8) else "en" for i in range(31)}


def test_language_id_learns_from_each_sampled_id(spark):
    once = [(i, prose(30), ("en", "de")[i % 2], "s") for i in range(60)]
    fit = lambda rows, n: language_id.learn(spark.createDataFrame(rows, DOCS).repartition(n), per_language=5)
    want = fit(once, 1)
    for rows, n in ((once[:1] * 300 + once, 3), (once + once[1:2] * 300, 7)):
        got = fit(rows, n)
        assert got.languages == want.languages and (got.slots == want.slots).all()


def test_grams_of_texts_are_whole(monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK_BYTES", 7)
    block = [b"", b"x", b"", b"ab cd\tEF gh ij kl", b"y" * 50, b"", b""]
    found = defaultdict(list)
    for numbers, pieces in language_id.pieces_of(block):
        code, sizes = language_id.grams_of(pieces)
        assert sizes.sum() == len(code)
        for i, part in zip(numbers, np.split(code, np.cumsum(sizes)[:-1]), strict=True):
            found[i] += [int(x).to_bytes(4, "big") for x in part]
    assert all(found[i] == grams(t.decode()) for i, t in enumerate(block))


def test_bit_sliced_filter_with_many_languages(spark):
    rows = [(i * 3 + k, f"w{i:03} z{i:03} {i:03}q", f"l{i:03}", "s") for i in range(90) for k in range(3)]
    table = spark.createDataFrame(rows, DOCS)
    f = language_id.learn(table)
    assert f.slots.shape[1] == 2 and f.slots.nbytes <= language_id.FILTER_BYTES
    learned = {x for i, _, x, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert f.languages == sorted(learned)
    assert all(r.lang_pred == rows[r.doc_id][2] for r in language_id.identify(table).collect() if rows[r.doc_id][2] in learned)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("digest_bytes, memtable, range_bytes", [(32, 200_000, 16 << 20), (32, 7, 16 << 20), (32, 7, 64), (1, 7, 64)])
def test_exact_dedup(docs, rows, monkeypatch, keep, digest_bytes, memtable, range_bytes):
    monkeypatch.setattr(exact_dedup, "RANGE_BYTES", range_bytes)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    got = exact_dedup.exact_dedup(docs, keep, digest_bytes, memtable).collect()
    want = Counter((i, pick((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("range_bytes", [16 << 20, 2_000])
def test_run_filters_name_what_runs_share(spark, monkeypatch, range_bytes):
    """Runs of 3,000 texts that share 1,500 with the next run: few of the other entries are merged, in one range or many."""
    monkeypatch.setattr(exact_dedup, "RANGE_BYTES", range_bytes)
    sha = lambda i: hashlib.sha256(str(i).encode()).digest()
    runs = [sorted(map(sha, range(1500 * r, 1500 * r + 3000))) for r in range(4)]
    filters = spark.createDataFrame([(bytearray(exact_dedup.run_filter(r).tobytes()),) for r in runs], "filter binary")
    shared = {w.word for w in exact_dedup.shared_words(filters, 1 + 4 * 24_000 // range_bytes).collect()}
    assert shared == set(exact_dedup._hashes([sha(i) for i in range(1500, 6000)]).tolist())
    held = [(r, bytearray(d), None, [1], 1, 0, 1, None) for r, ds in enumerate(runs) for d in ds]
    held += [(r, None, None, None, None, None, None, bytearray(exact_dedup.run_filter(ds).tobytes())) for r, ds in enumerate(runs)]
    entries = exact_dedup.shared_entries(spark.createDataFrame(held, exact_dedup.RUN)).collect()
    twice = {sha(i) for i in range(1500, 6000)}
    assert len(entries) == 12_000 and all(e.maybe for e in entries if bytes(e.digest) in twice)
    assert sum(e.maybe for e in entries) < 9_000 + 100


def test_run_filters_of_empty_runs(spark):
    assert exact_dedup.run_filter([]).size == 0
    none = spark.createDataFrame([(bytearray(b""),)], "filter binary")
    assert exact_dedup.shared_words(none, 3).count() == 0


def test_drop_copies(docs, rows):
    left = exact_dedup.drop_copies(docs, "largest")
    assert left.columns == docs.columns and Counter(t or "" for (t,) in left.select("text").collect()) == Counter({t or "" for _, t, *_ in rows})
    near = simhash.drop_near_copies(docs)
    assert near.columns == docs.columns and near.count() < len(rows)


def brute_scores(rows):
    """(id, tokens, known, base, score, sub, once) of each row, word by word from dictionaries."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: [*u(t).lower().split(), b" end"]
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v, ends = sum(c.values()), len(c), c[b" end"]
    words = {w: k for w, k in c.items() if w != b" end"}
    pieces, into = lm_scoring.load_pieces(), {}
    longest = max(map(len, pieces))
    for w, k in words.items():
        lm_scoring.expected_pieces(w.decode(), k, pieces, longest, into)
    if words:
        uses = {p: into.get(p, 0.0) + np.exp(x) for p, x in pieces.items()}
        total = sum(uses.values())
        pieces = {p: np.log(x / total) for p, x in uses.items()}
    once, twice = (sum(k == j for k in words.values()) for j in (1, 2))
    d, n_words, p_end = lm_scoring.discount(once, twice), sum(words.values()), (ends + 1) / (n + 2)

    def p(w):  # natural logs: the model's, and that of the pieces alone
        if w == b" end":
            return np.log(p_end), np.log(p_end)
        sub = np.log1p(-p_end) + lm_scoring.log_likelihood(w.decode(), pieces, longest)
        whole = np.log1p(-p_end) + np.log((c[w] - d) / n_words) if c[w] else -np.inf
        return np.logaddexp(whole, sub + np.log(d * len(words) / n_words if n_words else 1.0)), sub

    p = {w: p(w) for w in {w for _, t, *_ in rows for w in tokens(t)}}
    out = []
    for i, t, *_ in rows:
        ws = tokens(t)
        out.append((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(c[w] == 1 for w in ws), round(sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6), *(sum(p[w][k] for w in ws) / np.log(10) for k in (0, 1))))
    return sorted(out)


@pytest.mark.parametrize("head_words", [20, 100_000])
def test_lm_scoring(spark, docs, rows, head_words):
    more = [(500 + i, t, "en", "s") for i, t in enumerate(["w" * 60 + " " + "é" * 70, "日本 語 ☃ \x00x", "a " * 3000, "x" * 5000, "\x1c \x85 a\u2003b", "Ü ü \n\n\t"])]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, DOCS).select("doc_id", "text"))
    got = lm_scoring.score_texts(table, head_words=head_words).collect()
    want = brute_scores([*rows, *more])
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.n_once, round(r.base_score, 6), r.score, r.subword_score) for r in got)
    assert [x[:6] for x in have] == [x[:6] for x in want]
    assert np.allclose([x[6:] for x in have], [x[6:] for x in want], atol=1e-4)


def test_lm_scoring_without_training_documents(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(held, "some words", "en", "s"), (held, None, "en", "s")]
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scoring.score_texts(spark.createDataFrame(rows, DOCS)).collect())
    assert np.allclose(got, sorted((x[2], x[3], x[4], x[6], x[7]) for x in brute_scores(rows)), atol=1e-5)


def test_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(lm_scoring, "PIECE_BYTES", 50)
    for text in (b"", b" ", b"ab " * 100, b"x" * 500, b"x" * 120 + b" y\n" + b"z" * 60, prose(300).encode(), b"a\tb\x0bc" * 40):
        assert [w for some in lm_scoring.pieces_of(text) for w in some] == text.lower().split()


def test_lattices_of_many_words_equal_those_of_one():
    pieces = lm_scoring.load_pieces()
    lattices = lm_scoring.Lattices(pieces)
    words = [*VOCABULARY, "", "a", "é", "ünïcode", "日本語", "x" * 47, "x" * 48, "x" * 49, "the" * 40, "☃☃", "nicht", "a\x00"]
    alone = [lm_scoring.log_likelihood(w, pieces, lattices.longest) for w in words]
    assert np.allclose(lattices.log_likelihoods(words), alone, atol=1e-9)
    counts, into = np.arange(1.0, len(words) + 1), {}
    for w, c in zip(words, counts.tolist(), strict=True):
        lm_scoring.expected_pieces(w, c, pieces, lattices.longest, into)
    assert np.allclose(lattices.expected(words, counts), [into.get(p, 0.0) for p in lattices.names], atol=1e-7)
    assert lattices.numbers(np.zeros(0, np.uint64)).tolist() == []


def test_lattice_sums_all_segmentations():
    pieces = {lm_scoring.START: -1.0, lm_scoring.START + "a": -2.0, "a": -1.5, "b": -2.5, "ab": -0.7, "bb": -3.0}

    def brute(w):
        return 1.0 if not w else sum(np.exp(pieces[w[:k]]) * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces)

    for word in ("ab", "abb", "aabbab"):
        assert lm_scoring.log_likelihood(word, pieces, 3) == pytest.approx(np.log(brute(lm_scoring.START + word)))
        into = {}
        lm_scoring.expected_pieces(word, 2.0, pieces, 3, into)
        assert sum(len(p) * n for p, n in into.items()) == pytest.approx(2 * (len(word) + 1))


PAGES = [(1, "http://a b/", "<p>é</p>"), (2, None, None), (3, "u", "<p>é</p>"), (3, "u", "<p>é</p>"), (None, "", ""), (9, "v", "x\r\n\r\nWARC/1.1\r\n" * 3000)]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("archive_bytes, broadcast_rows", [(16 << 20, 1000), (10, 0)])
def test_archives(spark, version, archive_bytes, broadcast_rows):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, archive string").repartition(2)
    got = archives.archive_round_trip(pages, version, 0, archive_bytes, broadcast_rows).collect()
    want = Counter((i, len(u(h)), archives.digest(u(h))) for i, _, h in PAGES)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit" and r.page_id) == [(1, 3), (3, 3)]
    assert sum(r.record_type == "response" for r in got) == 3 and [r.refers_to for r in got if r.record_type == "revisit" and r.page_id is None] == [2]
    some = archives.archive_round_trip(pages, version, 5).collect()
    assert sum(r.record_type == "response" for r in some) == 4


def test_arc_records_are_checked():
    record = archives.arc_record("http://x/", 1, b"abc", 1, "20200101000000", "f", 0)
    fields, body = archives.parse_arc(record, 1)
    assert fields["URL"] == "http://x/" and body.endswith(b"abc")
    with pytest.raises(ValueError, match="shorter"):
        archives.parse_arc(record[:-3], 1)
    with pytest.raises(ValueError, match="fields"):
        archives.parse_arc(record, 2)
    assert archives.timestamp("2001") == "2001-01-01T00:00:00Z"


ARTICLE = "<h1>Title here</h1>" + "".join(f"<p>Paragraph {i} of the article, with words, commas and a point at its end.</p>" for i in range(6))


@pytest.mark.parametrize("name", ["comment-list", "user-comment", "commentBody", "comments_area", "related-posts", "social-share", "share-buttons", "site-notice"])
def test_named_asides_go_from_articles(name):
    junk = "".join(f"<p>Junk {i} says that this is long, with commas, and more than enough words to look like text.</p>" for i in range(8 if "omment" in name else 1))
    for page in (f"<body><article>{ARTICLE}<div class='{name}'>{junk}</div></article></body>", f"<body><div class='wrap'><article>{ARTICLE}</article><div id='{name}'>{junk}</div></div></body>"):
        text = html_text.main_text(page)
        assert "Junk" not in text and text.count("Paragraph") == 6


@pytest.mark.parametrize("name", ["comments-open", "comment-status-open", "no-comments", "post-with-comments", "has-related", "shared-ideas"])
def test_names_that_speak_of_asides_wrap_articles(name):
    assert html_text.main_text(f"<body><div class='{name}'><article>{ARTICLE}</article></div></body>").count("Paragraph") == 6


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (simhash.near_dedup(nothing), decontaminate.decontaminate(nothing, bench), quality.quality_scores(nothing, labels), mixing.mix(nothing), html_text.extract_text(pages), repeats.repeated_bytes(nothing), language_id.identify(nothing), exact_dedup.exact_dedup(nothing), lm_scoring.score_texts(nothing), archives.archive_round_trip(pages)):
        assert out.count() == 0


def test_simhash_of_pieces_equals_that_of_the_whole():
    rng = random.Random(5)
    for _ in range(300):
        text = b"".join(rng.choice([b"a", b"Bc", b" ", b"\n", b"\x0b ", "é".encode()]) for _ in range(rng.randrange(80)))
        for shingle in (1, 4, 5):
            assert {simhash.simhash(text, shingle, piece) for piece in (1, 2, 7, 1 << 20)} == {simhash.simhash(text, shingle, len(text) + 1)}


def test_drop_copies_of_a_hot_text(spark):
    texts = ["hot"] * 500 + [f"t{i // 2}" for i in range(400)] + [None, "", "alone"]
    rows = [(i % 450, t) for i, t in enumerate(texts)]
    got = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"), "largest", memtable_rows=50).collect()
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), i)
    assert sorted((r.text or "", r.doc_id) for r in got) == sorted(best.items())


def test_quality_features_of_pieces_equal_those_of_the_whole():
    rng = random.Random(6)
    for _ in range(200):
        text = b"".join(rng.choice([b"a", b"Bc", b" ", b"\n", b"\x0b ", b"7", b".", "é".encode()]) for _ in range(rng.randrange(80)))
        assert quality.style(text, 1) == quality.style(text, 5) == quality.style(text)
        whole = quality.trigrams([text])
        assert all(np.array_equal(x, whole) for x in (quality.trigrams([text], 1), quality.trigrams([text], 4), quality.trigrams([text, b"other"])[:1]))
