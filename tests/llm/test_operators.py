"""The text operators against brute force, on odd rows and on the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from bagdiv.llm import bpe, embedding_near_dup, html_extract, line_dedup, lm_score, mixing, ngram_jaccard, quality_rules, queries, token_counts, toxicity

SF = "/root/testdata/sf0.001"
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", " \t\n", "one", "one two three", BASE, BASE, BASE + " more", BASE.upper(), "a line of some length\nother", " A line of SOME length \nanother one here\nanother one here", "x" * 5000, "word " * 3000, "it's <|endoftext|> 12½ 日本 É İ Σς\x1c", "é b  c\n\n d", "tab\tand\r\nmore", BASE.replace("w30", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", None if i % 3 else f"s{i % 2}") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, source string").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def by_id(df):
    return {r[0]: r for r in df.collect()}


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(n, links):
    root = {i: i for i in n}
    for _ in n:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(str(path))
    got = by_id(token_counts.token_counts(docs, str(path), head=8))
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False))
        assert tuple(got[i]) == (i, len((t or "").encode()), n, n > 1024)
    assert token_counts.token_counts(empty, str(path)).count() == 0


def test_split_of_every_latin_code_point():
    counter = token_counts.PieceCounter(str(public_tokenizers.path("byte_bpe_50k.json")))
    for i in range(0x2B0):
        s = f"a{chr(i)}b 1{chr(i)} {chr(i)} {chr(i)}{chr(i)}"
        assert counter.split(s) == [s[a:b] for _, (a, b) in counter.tokenizer.pre_tokenizer.pre_tokenize_str(s)]


def test_bpe(docs, empty):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    got = by_id(bpe.encode(docs, path, lexicon=20))
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(empty, path).count() == 0


def test_transducer():
    words = {"".join(w): [i, i + 1] for i, w in enumerate(__import__("itertools").product("abc", "xy", ["ing", "ed", ""]))}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert all(lexicon.get(w) == ids for w, ids in words.items()) and lexicon.get("axin") is None and lexicon.get("") is None
    assert bpe.Lexicon(bpe.compile_lexicon({})).get("a") is None


def test_jaccard(docs, empty):
    got = by_id(ngram_jaccard.jaccard_components(docs))
    sets = {}
    for i, t in enumerate(TEXTS):
        w = split(lowered(t))
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = components(sets, links)
    assert {i: tuple(r) for i, r in got.items()} == {i: (i, len(sets[i]), root[i]) for i in sets}
    assert ngram_jaccard.jaccard_components(empty).count() == 0


def test_jaccard_of_random_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE_ROWS", 7)
    rng = np.random.default_rng(5)
    texts = []
    for base in range(6):
        words = [f"b{base}v{x}" for x in rng.integers(0, 500, rng.integers(20, 120))]
        texts += [" ".join(w if rng.random() > 0.02 else "new" for w in words) for _ in range(25)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = components(sets, links)
    assert {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(df).collect()} == root


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)]
    assert (ngram_jaccard.overlaps(sets[:25], sets[25:]) == [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]).all()


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    x = np.concatenate([base, np.repeat(base[:3], 30, 0) + rng.normal(size=(90, 16)) * 0.12]).astype(np.float32)
    rows = [(i, [float(v) for v in e], int(i % 2) if i % 11 else None) for i, e in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [math.nan] * 16, 0), (203, [None] * 16, 0), (204, [1.0], 0), (205, [2.0], 0), (206, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: (np.array(e, float), l) for i, e, l in rows if e and l is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    links = [(a, b) for a, (u, l) in good.items() for b, (v, m) in good.items() if a < b and l == m and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98]
    n, root = Counter(x for l in links for x in l), components([r[0] for r in rows], links)
    for tile in (4096, 5):
        got = by_id(embedding_near_dup.near_duplicates(df, tile=tile, block_dim=4))
        assert {i: tuple(r) for i, r in got.items()} == {r[0]: (r[0], n[r[0]], root[r[0]], root[r[0]] == r[0]) for r in rows}
    assert links and embedding_near_dup.near_duplicates(df.where("false")).count() == 0


def test_rotated_coordinates_depend_on_the_vector_alone():
    x = np.random.default_rng(6).normal(size=(1030, 64))
    at = embedding_near_dup.Blocks(64, 8, 0.98)
    every = at.turned(x)
    assert np.allclose(every, x / np.linalg.norm(x, axis=1)[:, None] @ at.turn)
    for lo, hi in ((0, 1), (0, 3), (5, 12), (511, 514), (1029, 1030), (3, 1030)):
        assert (at.turned(x[lo:hi]) == every[lo:hi]).all()


def test_embeddings_that_are_copies_count_once(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 64)).astype(np.float32)
    of = np.append(np.arange(700), np.append(np.repeat(np.arange(100), 2), np.repeat(600, 40)))
    scale = np.append(np.ones(700), rng.choice([1, 1, 3, 0.7], 240))
    put = rng.permutation(len(of))
    rows = [(i, [float(v) for v in x[of[k]] * np.float32(scale[k])], 0) for i, k in enumerate(put)]
    members = defaultdict(list)
    for i, k in enumerate(put):
        members[of[k]].append(i)
    got = by_id(embedding_near_dup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tile=64))
    for same in members.values():
        assert all(tuple(got[i])[1:] == (len(same) - 1, min(same), i == min(same)) for i in same)


def test_lines(docs, empty):
    got = by_id(line_dedup.line_dedup(docs))
    key = lambda x: lowered(x.strip(" \t\n\r\x0b\x0c"))
    held = defaultdict(set)
    for i, t in enumerate(TEXTS):
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    for i, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
        assert got[i].text == ("\n".join(kept) if t is not None else None)
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_index_can_be_undone(docs):
    one, two = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    was = line_dedup.LineIndex.of(one)
    both = was.insert(two)
    want = sorted(map(tuple, line_dedup.LineIndex.of(docs).shared().collect()))
    assert sorted(map(tuple, both.shared().collect())) == want
    back = both.delete(two)
    assert sorted(map(tuple, back.counts().collect())) == sorted(map(tuple, was.counts().collect()))
    marks = lambda i: Counter(m for r in i.filters.collect() for m in np.frombuffer(bytes(r.filter), np.uint16) if m)
    assert marks(back) == marks(was)


def test_cuckoo_filter():
    keys = [(int(a), int(b)) for a, b in np.random.default_rng(0).integers(-(2**63), 2**63, (3000, 2))]
    f = line_dedup.filled(keys)
    assert all(k in f for k in keys) and f.contains(*np.array(keys).T).all()
    assert all(f.delete(*k) for k in keys) and not f.table.any()


def lm_by_hand(texts, out):
    """(n_tokens, n_known, N, base_score, score) of each text, by an automaton of dictionaries that reads word by word."""
    words = [lm_score.words(t) for t in texts]
    seen = Counter()
    for ws in (ws for ws, o in zip(words, out) if not o):
        for k in (1, 2, 3):
            seen.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    c = {g[0]: n for g, n in seen.items() if len(g) == 1}
    total, kinds = sum(c.values()), len(c)
    once, twice = (sum(n == k for n in c.values()) for k in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05
    follow, times = Counter(), Counter()
    for g, n in seen.items():
        follow[g[:-1]] += 1
        times[g[:-1]] += n

    def chance(history, w):
        if not history:
            return (c[w] - d if w in c else d * kinds) / total if total else 1.0
        lower = chance(history[1:], w)
        if not times[history]:
            return lower
        return (max(seen[*history, w] - lm_score.DISCOUNT, 0) + lm_score.DISCOUNT * follow[history] * lower) / times[history]

    return [(len(ws), sum(w in c for w in ws), total, sum(math.log10((c.get(w, 0) + 1) / (total + kinds + 1)) for w in ws), sum(math.log10(chance(tuple(ws[max(0, i - 2) : i]), w)) for i, w in enumerate(ws))) for ws in words]


def test_lm(docs, empty):
    held = lm_score.held_out_fold(7, 2)
    got = by_id(lm_score.score(docs, held))
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))]
    for i, want in enumerate(lm_by_hand(TEXTS, out)):
        assert got[i].held_out == out[i] and tuple(got[i])[2:] == pytest.approx(want)
    assert lm_score.score(empty, held).count() == 0
    assert all(r.score == r.base_score == 0 for r in lm_score.score(docs, F.lit(True)).collect())


def test_lm_holds_every_pair_and_triple_of_words(spark):
    rng = np.random.default_rng(8)
    texts = [None, "", "One", *(" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 40)) % 4000) for _ in range(300))]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    want = lm_by_hand(texts, out)
    # In one group, and in many; with hot states whole, and dealt to several owners.
    for how in ({}, {"group_bytes": 4000}):
        got = by_id(lm_score.score(df, lm_score.held_out_fold(7, 2), **how))
        assert [tuple(got[i])[2:] == pytest.approx(w) for i, w in enumerate(want)] == [True] * len(texts)


@pytest.mark.parametrize("most,ranked", [(7, 100), (1 << 16, 3)])
def test_lm_states_of_several_owners(spark, monkeypatch, most, ranked):
    texts = [" ".join(["the", f"w{i % 9}", "the", f"v{i}"]) for i in range(200)]
    u, size = lm_score.count_words(spark.createDataFrame([(t, False) for t in texts], "text string, held_out boolean"))
    hot = {int(lm_score.hashed([b"the"])[0]): 5, int(lm_score.hashed([b"w3"])[0]): 2}
    monkeypatch.setattr(lm_score, "count_words", lambda *a: (lm_score.Unigrams(u.total, u.distinct, u.discount, u.ends, hot, most, u.frequent[:ranked], u.places[:ranked]), size))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = by_id(lm_score.score(df, F.lit(False), group_bytes=1000))
    assert [tuple(got[i])[2:] == pytest.approx(w) for i, w in enumerate(lm_by_hand(texts, [False] * 200))] == [True] * 200


def test_lm_bundles_hold_all_rows(monkeypatch):
    """Rows dealt in several rounds come back by group, null ids and texts among them."""
    import pyarrow as pa

    rows = [(i % 3, None if i % 5 == 0 else i, None if i % 7 == 0 else f"text {i}" * (i % 4), i % 2 == 0) for i in range(100)]
    schema = pa.schema([("group", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("held_out", pa.bool_())])
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
    for limit in (0, 1 << 20):
        monkeypatch.setattr(lm_score, "DEALT_BYTES", limit)
        out = pa.Table.from_batches([*lm_score._bundles(iter(table.to_batches(max_chunksize=9)))])
        assert (out.num_rows > 3) == (limit == 0)
        for g in range(3):
            got = lm_score._docs(out.filter(pa.array([x == g for x in out.column("group").to_pylist()])))
            assert [tuple(r.values()) for r in got.to_pylist()] == [r[1:] for r in rows if r[0] == g]
    assert not [*lm_score._bundles(iter([]))]


@pytest.mark.parametrize("x", [[], [0], [1, 2**40, 7], [2**63 - 1] * 3])
def test_lm_planes(x):
    assert lm_score.from_planes(lm_score.planes(np.array(x, np.int64))).tolist() == x


def test_lm_reads_a_long_text(spark):
    """A text far larger than a group, beside short ones."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 200_000) % 5000), "w1 w2 w3", "", None]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = by_id(lm_score.score(df, F.col("doc_id") == 1, group_bytes=1 << 16))
    assert [tuple(got[i])[2:] == pytest.approx(w) for i, w in enumerate(lm_by_hand(texts, [False, True, False, False]))] == [True] * 4


def test_lm_of_repeated_and_null_doc_ids(spark):
    rows = [(5, "a b c"), (5, "a b c"), (None, "a b d"), (None, None), (5, "c b a")]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), lm_score.held_out_fold(7, 2)).collect()
    want = lm_by_hand([t for _, t in rows], [False] * 5)
    key = lambda r: tuple(round(x, 6) for x in r)
    assert zlib.crc32(b"5") % 7 != 2 and sorted(key(tuple(r)[2:]) for r in got) == sorted(map(key, want))


def test_lm_probabilities_sum_to_one():
    import pyarrow as pa

    trained = ["a b a c", "b a", "a b b", "c", "a b a b"]
    names = ["a", "b", "c", "zz"]
    # Every word that may follow any two, in texts that aren't learned from.
    asked = [f"{x} {y} {z}" for x in names for y in names for z in names] + [f"{x} {y}" for x in names for y in names] + names
    learned = np.append(np.ones(len(trained)), np.zeros(len(asked)))
    r = lm_score.Reading(pa.array(trained + asked), learned, lm_score.Unigrams(0, 0, 0.5))
    total = np.bincount(r.token, learned[r.text], len(r.words)).astype(np.int64)
    r.u = lm_score.Unigrams(int(total.sum()), int((total > 0).sum()), 0.5, len(trained))
    r.deepen()
    # No other group has any pair, so nobody is asked.
    assert not len(r.triples(r.times, np.zeros(len(r.times), bool))[1])
    p = 10 ** lm_score.Automaton.of(r, total, np.bincount(r.before, r.times > 0, len(r.words)), r.times, np.bincount(r.history, r.three > 0, len(r.times)), r.three).read(r)
    begin = np.cumsum(r.size) - r.size
    place = {t: int(begin[len(trained) + i]) for i, t in enumerate(asked)}
    for x in names:
        for y in names:
            assert sum(p[place[f"{x} {y} {z}"] + 2] for z in names) + p[place[f"{x} {y}"] + 2] == pytest.approx(1)
        assert sum(p[place[f"{x} {y}"] + 1] for y in names) + p[place[x] + 1] == pytest.approx(1)
    assert sum(p[place[x]] for x in names) + 10 ** r.u.log10(len(trained)) == pytest.approx(1)


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.quality(docs, labels))
    for i, t in enumerate(TEXTS):
        w, lines = split(t), (t or "").split("\n")
        full = [x for x in lines if split(x)]
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        repeat = {j + d for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for d in range(5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), len(repeat))
        assert tuple(got[i])[1:6] == want and got[i].base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))
    assert quality_rules.quality(empty, labels).count() == 0
    assert quality_rules.filtered(docs, labels).columns == docs.columns


def test_rules_find_a_planted_conjunction():
    x = np.random.default_rng(0).random((900, len(quality_rules.RATIOS)))
    bad = (x[:, 1] > 0.6) & (x[:, 5] < 0.4)
    rules = quality_rules.learn(x, bad)
    found = np.any([quality_rules.covered(r, x) for r in rules], axis=0)
    assert (found == bad).mean() > 0.97


def test_toxicity(docs, empty, spark):
    assert toxicity.fold("Stup1d $tupid ïdiot i-d-i-o-t sсum loooser!! 1984") == " stupid stupid idiot idiot scum loser 1984 "
    rng = np.random.default_rng(1)
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 50, 30)), *(["moron"] if i % 4 == 0 else [])][:: 1 if i % 8 else -1]) for i in range(200)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    fold = lm_score.held_out_fold(5, 0)
    got = toxicity.toxicity(df, labels, fold).where("held_out").collect()
    assert got and all(r.predicted == (r.doc_id % 4 == 0) for r in got)
    assert toxicity.toxicity(docs, labels.where("false"), fold).count() == len(TEXTS)
    assert toxicity.toxicity(empty, labels, fold).count() == 0


def test_html(spark):
    page = '<html><body><nav><a href="/">Menu</a></nav><div class="cookie-bar">We use cookies</div><article><h1>T &amp; U</h1><p><b>One\n two<br>three<p>Four<script>x="</p>"</script></p><div class="comments"><p>Nice</p></div></article><footer>foot'
    rows = [(i, "https://www.a.example/" + str(i), page) for i in range(3)] + [(3, None, None), (4, "https://a.example/x", ""), (5, "x", "plain"), (6, "https://a.example/y", "<p>a<div")]
    got = by_id(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert [got[i].text for i in range(7)] == ["T & U\n\nOne two three\n\nFour"] * 3 + ["", "", "plain", "a"]
    for hosts in (100_000, 0):
        assert html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_hosts=hosts).count() == 7


def test_html_text_after_letters_that_grow_in_lower_case():
    text = lambda source: html_extract.main_text(html_extract.parse(source), None)
    assert text("<head><title>İstanbul</title></head><body><p>Hello</p></body>") == "Hello"
    assert text("<p>İİİİ</p><script>x</SCRIPT><p>Hello</p>") == "İİİİ\n\nHello"


@pytest.mark.parametrize(
    "source, want",
    [
        ("<div class='content has-sidebar'><p>The whole article</p></div>", "The whole article"),
        ("<main class='no-sidebar'><p>The whole article</p></main>", "The whole article"),
        ("<article class='post comments-open'><p>The whole article</p></article>", "The whole article"),
        ("<div id='search-results-article'><p>The whole article</p></div><div class='ads'>Buy</div>", "The whole article"),
        ("<div class='notice'><div id='related'><p>The whole article", "The whole article"),
        ("<article><header class='entry-header'><h1>Title</h1></header><p>Body of it</p><div class='comments'>More letters than the body has</div></article>", "Title\n\nBody of it"),
        ("<header>Site</header><div class='sidebar'>Side</div><div><p>The whole article</p></div>", "The whole article"),
        ("<p>As <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "As x=1 holds"),
        ("<div class='widget' style='display: none'>Hidden, of many letters</div><p>Shown</p>", "Shown"),
    ],
)
def test_html_keeps_articles_with_names_of_boilerplate(source, want):
    assert html_extract.main_text(html_extract.parse(f"<html><body>{source}"), None) == want


ODD = [(1, "a b c d e f g h i", "x"), (1, "a b c d e f g h i", "x"), (None, "one line of text\nzz", None), (7, "one line of text\nyy", "x"), (7, None, "y"), (None, "one line of text\nzz", None), (9, "", "y"), (9, "same words here now", "y"), (9, "same words here too", "y"), (3, "one line of text\nww", "x"), (3, "another line of text", "z"), (2, "another line of text", None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, null ids, and columns with the names that operators use."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for name in ("gone", "Gone_", "_times", "_round", "times", "alike", "name", "row", "nth", "n_lines", "size", "mark", "rep", "component", "own0", "n_words", "kept", "group"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df.cache()


def rows_of(df, *names):
    return Counter(map(tuple, df.select(*names).collect()))


def test_repeated_rows_of_token_counts_and_bpe(odd):
    for name, run in ((queries.BYTE_BPE, lambda d, p: token_counts.token_counts(d, p, head=3)), (queries.WORD_BPE, lambda d, p: bpe.encode(d, p))):
        path = str(public_tokenizers.path(name))
        library = Tokenizer.from_file(path)
        assert rows_of(run(odd, path), "doc_id", "n_tokens") == Counter((i, len(library.encode(t or "", add_special_tokens=False))) for i, t, _ in ODD)


def test_repeated_rows_of_quality_and_toxicity(odd, spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (9, 1, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert rows_of(quality_rules.quality(odd, labels), "doc_id", "n_words") == Counter((i, len(split(t))) for i, t, _ in ODD)
    assert quality_rules.filtered(odd, labels).columns == odd.columns
    got = toxicity.toxicity(odd, labels, F.lit(False))
    assert rows_of(got, "doc_id") == Counter((i,) for i, _, _ in ODD)


@pytest.mark.parametrize("filter_bytes", [1 << 26, 0])
def test_repeated_rows_of_lines(odd, filter_bytes):
    """A line stays in all rows of the smallest doc_id that holds it; with filters in a broadcast, and in tasks of their shards."""
    got = line_dedup.without_repeated_lines(odd, filter_bytes=filter_bytes)
    held = defaultdict(set)
    for i, t, _ in ODD:
        for x in (t or "").split("\n"):
            held[x] |= {i} - {None}
    gone = lambda i, x: len(x) >= 10 and i is not None and min(held[x]) < i
    want = [(i, t and "\n".join(x for x in t.split("\n") if not gone(i, x)), s, "own n_lines", "own Gone_") for i, t, s in ODD]
    assert got.columns == odd.columns and rows_of(got, "doc_id", "text", "source", "n_lines", "Gone_") == Counter(want)


@pytest.mark.parametrize("filter_bytes", [1 << 26, 0])
def test_lines_of_many_shards(spark, monkeypatch, filter_bytes):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    monkeypatch.setattr(line_dedup, "TASK_LINES", 20)
    rng = np.random.default_rng(3)
    texts = ["\n".join([f"this is line {x}" for x in rng.zipf(1.2, 12) % 300] + ["the line that all have"]) for _ in range(120)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    owner = {}
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            owner.setdefault(x, i)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(df, filter_bytes=filter_bytes).collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if owner[x] == i) for i, t in enumerate(texts)}


def test_repeated_rows_of_jaccard(odd, spark):
    got = ngram_jaccard.jaccard_components(odd)
    n = lambda t: len({tuple(split(t)[j : j + 4]) for j in range(max(1, len(split(t)) - 3))}) if split(t) else 0
    near = {3: 2, None: None}
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == Counter((i, n(t), near.get(i, i)) for i, t, _ in ODD)
    kept = ngram_jaccard.without_near_copies(odd)
    assert kept.columns == odd.columns and rows_of(kept, "doc_id", "text") == Counter((i, t) for i, t, _ in ODD if i != 3)
    # Documents 1 and 2 link through rows of document 3 that have nothing in common.
    rows = [(1, "a b c d e"), (3, "a b c d e"), (3, "v w x y z"), (2, "v w x y z"), (4, "q")]
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_jaccard_tiles_of_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE_ROWS", 4)
    rng = np.random.default_rng(9)
    words = [f"v{x}" for x in range(200)]
    texts = [" ".join(words[: 200 - rng.integers(0, 60)] + [f"own{i}"]) for i in range(60)]
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = ngram_jaccard.jaccard_components(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == components(sets, links)


def test_repeated_rows_of_embeddings(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (4, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (6, [1e-200, 1e-200], 2), (7, [1e200, 1e200], 2), (8, [math.inf, 0.0], 2), (9, [0.0, 0.0], 2), (10, [0.0, 0.0], 2), (2, [0.0, 1.0], 1)]
    got = embedding_near_dup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("copies", F.lit("x")))
    want = [(5, 2, 4, False), (5, 2, 4, False), (4, 2, 4, True), (None, 0, None, True), (6, 1, 6, True), (7, 1, 6, False), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (2, 0, 2, True)]
    assert rows_of(got, *got.columns) == Counter(want)


def test_repeated_rows_of_the_mix(odd):
    got = mixing.mix(odd).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(split(t))) for i, t, _ in ODD)
    assert all(r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0) for r in got)
    total = sum(r["size"] for r in got)
    assert 0 < sum(r.taken for r in got) <= total
    copies = mixing.mixed(odd)
    assert copies.columns == odd.columns and rows_of(copies.withColumn("n", F.regexp_count("text", F.lit(r"\S+"))), "doc_id", "n") == Counter({k: n for k, n in sum((Counter({(r.doc_id, r["size"]): r.taken // max(1, r["size"])}) for r in got), Counter()).items() if n})
    # Ties: equal words, sources of equal size; the same twice.
    assert Counter(map(tuple, mixing.mix(odd).collect())) == Counter(map(tuple, got))


def test_pipeline_stages_on_odd_and_empty_tables(odd, tmp_path, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd.withColumn("n_chars", F.length("text")), odd.where("false").withColumn("n_chars", F.length("text"))):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
            stage(spark, docs, str(tmp_path)).count()
    odd.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def html_page(rng, n):
    """A page with a known article, and menus, notices, adverts, comments and forms around and within it."""
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    paras = [text(rng.integers(20, 60)) for _ in range(rng.integers(2, 7))]
    junk = ['<div class="sidebar"><ul><li><a href="#">{0}</a></li></ul></div>', '<form action="x"><label>{0}</label><input name="q"></form>', '<div class="ad-slot">{0}</div>', "<script>var x = '{0} <p>';</script>", "<!-- {0} <p>no</p> -->", '<style>p::after {{content: "{0}"}}</style>', '<aside><p>{0}</p></aside>', '<section id="comments"><p>{0}</p></section>']
    inside = [rng.choice(junk).format(text(4)) if rng.random() < 0.4 else "" for _ in paras]
    spans = ['{0}', '<b>{0}</b>', '<a href="/x">{0}</a>', '<span class="ad">buy now</span>{0}', "{0}<span hidden> gone</span>"]
    shown = [f"<p>{' '.join(rng.choice(spans).format(w) if rng.random() < 0.1 else w for w in p.split())}</p>{j}" for p, j in zip(paras, inside)]
    body = f'<header><nav><a href="/">{text(3)}</a></nav></header><div class="cookie-banner">{text(5)}</div><div class="page has-sidebar"><div class="content c{n} wide two three four five"><h1>{text(4)}</h1>' + "\n".join(shown) + f'</div><div class="sidebar">{text(12)}</div></div><footer>{text(6)}</footer>'
    title = body.split("<h1>")[1].split("</h1>")[0]
    return f"<!doctype html><html><head><title>{text(3)}</title></head><body>{body}</body></html>", "\n\n".join([title, *paras])


def test_html_of_made_up_pages(spark):
    rng = np.random.default_rng(12)
    pages = [html_page(rng, i) for i in range(80)]
    df = spark.createDataFrame([(i, f"http://h{i % 5}.example/{i}", p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string")
    got = by_id(html_extract.extract(df))
    assert [got[i].text for i in range(80)] == [want for _, want in pages]
    assert html_extract.extract(df.where("false")).count() == 0


def test_html_long_page(spark):
    page = "<article>" + "".join(f"<p>line {i} of a long page</p>" for i in range(20_000)) + "</article>"
    row = html_extract.extract(spark.createDataFrame([(1, "http://a.example", page), (1, "http://a.example", page)], "page_id long, url string, html string")).collect()
    assert len(row) == 2 and all(r.text == "\n\n".join(f"line {i} of a long page" for i in range(20_000)) and r.n_chars == len(r.text) for r in row)


def test_quality_verdicts_equal_the_rules(spark):
    """kept, against the learned rules applied one by one to statistics that Python counts."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels)
    stats = {r.doc_id: r.asDict() for r in quality_rules.statistics(docs).collect()}
    for r in quality_rules.quality(docs, labels).collect():
        x = stats[r.doc_id]
        value = lambda c: float(x[quality_rules.RATIOS[c.name][0]]) / (1 if quality_rules.RATIOS[c.name][1] is None else max(1, x[quality_rules.RATIOS[c.name][1]]))
        rejected = any(all((value(c) >= c.at) == c.above for c in rule) for rule in rules)
        assert r.kept == (not r.base_failed and not rejected)


def test_toxicity_scores_equal_the_lexicon(spark):
    """Scores, against the weights of all entries found by plain search; and the held-out labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = lm_score.held_out_fold(5, 0)
    lexicon = toxicity.fit(docs, labels, fold)
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 10 = 0").collect()}
    got = by_id(toxicity.toxicity(docs, labels, fold))
    for i, t in texts.items():
        f = toxicity.fold(t)
        raw = sum(w * len(re.findall(f"(?={re.escape(k)})", f)) for k, w in (lexicon.weights | lexicon.exceptions).items())
        z = lexicon.scale * raw / max(1, f.count(" ") - 1) ** lexicon.power + lexicon.shift
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))
    told = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    judged = [(told[i], r.predicted) for i, r in got.items() if r.held_out and i in told]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_toxicity_keeps_to_its_bytes(spark):
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") * 20) for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    lexicon = toxicity.fit(docs, labels, F.lit(False), text_bytes=0)
    assert not lexicon.weights


def test_mix(docs, empty):
    got = by_id(mixing.mix(docs))
    assert all(r.size == len(split(TEXTS[i])) and r.taken <= 3 * r.size for i, r in got.items())
    assert sum(r.taken for r in got.values()) <= sum(r.size for r in got.values())
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("name", [*queries.oracle_sql()])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(con.execute(f"select {', '.join(names)} from ({queries.oracle_sql()[name]})").fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        was, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == was.columns
    rows = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False))) for r in docs.collect())
