"""The text operators against brute force on small tables, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import io
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from mediamill.llm import bpe, decontaminate, fingerprints, html_extract, language_id, minhash_dedup, queries, sst, substring_dedup, token_counts, toxicity  # noqa: E402
from mediamill.llm.components import components  # noqa: E402
from mediamill.llm.dom import Page  # noqa: E402
from mediamill.llm.lexicon import Lexicon, build  # noqa: E402
from mediamill.llm.textkit import ALNUM, SPACED, Words, slices  # noqa: E402
from mediamill.llm.wordbpe import ChunkEncoder  # noqa: E402

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n\t", "one", "Ünïcode wörds ñ 日本語 😀 ½ ²x İ ΑΣ Σ", "a\x1cb <|endoftext|> <s> ▁x\x00y", "it's O'RE don't 123,456 ﬁ", "x" * 3000, "word " * 400]


def rows(spark, texts, ids=None, **more):
    data = [(i if ids is None else ids[i], t, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, id string, n_words int")


def prose(rng, n, words=60):
    vocabulary = [f"w{i}" for i in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# --- kernels of text ------------------------------------------------------------


@pytest.mark.parametrize(("inside", "pattern", "lower"), [(SPACED, "[^\x20\x09-\x0d]+", False), (ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", True)])
def test_words_are_those_of_the_pattern(inside, pattern, lower):
    texts = [t or "" for t in ODD] + ["end", "start", ""]
    seen = {}
    for lo, hi, buf, off in slices(pa.array(texts), 50):
        w = Words(buf, off, inside, lower)
        for r in range(hi - lo):
            want = re.findall(pattern, texts[lo + r].translate(LOW) if lower else texts[lo + r])
            a, b = w.first[r], w.first[r + 1]
            got = [buf[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)]
            assert [g.translate(LOW) if lower else g for g in got] == want
            for g, h in zip(want, w.hash[a:b].tolist(), strict=True):
                assert seen.setdefault(g, h) == h
    assert len(set(seen.values())) == len(seen)


# --- 1 -----------------------------------------------------------------------------


def brute_repeats(data, length=20):
    seen, out = {}, {}
    for i, t in sorted(data):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = set()
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if k in seen:
                gone.update(range(p, p + length))
            else:
                seen[k] = (i, p)
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    passages = [prose(rng, n, 500) for n in (20, 25, 60, 19)]
    texts = list(ODD)
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 40), 500) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        texts.append(" \n".join(parts))
    texts += [texts[-1]] * 5 + ["aa bb " * 40]
    want = brute_repeats(list(enumerate(texts)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.find_repeats(rows(spark, texts)).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000
    whole = {r.rest.doc_id: (r.kept, r.rest.id) for r in substring_dedup.find_repeats(rows(spark, texts), rest=True, whole=True).collect()}
    assert all(whole[i] == ((t if not want[i][1] else want[i][2]), "clash") for i, t in enumerate(texts))


def test_substring_dedup_spans_and_odd_keys(spark):
    a = prose(random.Random(2), 30, 900)
    got = substring_dedup.find_repeats(rows(spark, [a, "x " + a + " y"])).orderBy("doc_id").collect()
    assert [(s.first, s.words) for s in got[1].spans] == [(1, 30)] and got[1].kept == "x y"
    again = substring_dedup.find_repeats(rows(spark, [a, a, a + " z", a], [5, 5, 5, None])).collect()
    assert len(again) == 4 and sorted(r.n_removed for r in again) == [0, 30, 30, 30]
    odd = substring_dedup.find_repeats(rows(spark, [a, a + " z", "q"], [5, 5, -(1 << 60)]))
    assert dict(odd.dtypes)["doc_id"] == "bigint" and sorted((r.doc_id, r.n_words) for r in odd.collect()) == [(-(1 << 60), 1), (5, 30), (5, 31)]
    assert substring_dedup.find_repeats(rows(spark, ["a"]).limit(0)).count() == 0


# --- 2 -----------------------------------------------------------------------------


def test_maximal_segments_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.gauss(-0.2, 1.0) for _ in range(rng.randint(1, 25))]
        run = np.concatenate([[0], np.cumsum(s)])

        def recurse(lo, hi, run=run):
            best = max(((run[b] - run[a], a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            return [*recurse(lo, best[1]), best[1:], *recurse(best[2], hi)]

        assert toxicity.maximal([i for i, x in enumerate(s) if x > 0], run) == recurse(0, len(s))


def test_maximal_segments_take_linear_time():
    def seconds(n):
        s = np.tile([2.0, -1.5, -1.5], n)
        run = np.concatenate([[0], np.cumsum(s)])
        start = time.perf_counter()
        assert len(toxicity.maximal(range(0, 3 * n, 3), run)) == n
        return time.perf_counter() - start

    # ten times the length, the best of some runs each: far below the hundredfold of a quadratic scan
    assert min(seconds(200_000) for _ in range(3)) < 30 * max(min(seconds(20_000) for _ in range(5)), 0.005)


def test_toxicity_learns_words_and_prefixes(spark):
    rng = random.Random(4)
    bad = ["nasty", "vile", *(f"zlurp{x}" for x in ("a", "bo", "cid", "doff"))]
    texts, toxic = [], []
    for i in range(500):
        w = prose(rng, rng.randint(30, 120), 300).split()
        y = i % 8 == 0
        if y:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        toxic.append(int(y))
    texts += [None, ""]
    docs = rows(spark, texts)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] + [(1, 0, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, lexicon).withColumn("held", toxicity.is_held_out(F.col("doc_id"))).collect()}
    assert all(got[i].predicted == y for i, y in enumerate(toxic))
    assert all(got[i].held == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(500))
    assert got[500].predicted == got[501].predicted == 0 and 0 <= got[500].score <= 1
    assert got[0].passages and not got[1].passages and got[0].id == "clash"
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).where("predicted = 1").count() == 0


# --- 3 -----------------------------------------------------------------------------


def brute_near(data):
    sets = {}
    for i, t in data:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = list(ODD) + ["One two three", "one TWO three", "one two"]
    for _ in range(12):
        base = prose(rng, rng.randint(20, 200), 4000).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
            texts.append(" ".join(w))
    order = list(range(len(texts)))
    rng.shuffle(order)
    want = brute_near([(order[i], t) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(rows(spark, texts, order)).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(texts) - 20


def test_a_group_of_mostly_unlike_copies(spark):
    """Copies at all distances of one text: few are alike enough, and all that are must be found."""
    rng = random.Random(6)
    base = prose(rng, 120, 5000).split()
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 12):
            w[rng.randrange(len(w))] = f"v{rng.randrange(99999)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    want = brute_near(list(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(rows(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_of_odd_rows(spark):
    got = minhash_dedup.near_duplicates(rows(spark, ["a b", "a b", "c", None], [3, None, 3, None])).collect()
    assert len(got) == 4 and sorted((r.doc_id, r.component_id) for r in got if r.n_shingles and r.doc_id) == [(3, 3), (3, 3)]
    long = prose(random.Random(8), 40, 900)
    data = [(5, long), (5, "other text of five words more"), (1, long + " end"), (None, long), (None, "nobody else has this one"), (7, ""), (7, long)]
    got = minhash_dedup.near_duplicates(rows(spark, [t for _, t in data], [i for i, _ in data]), detail=True)
    named = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    assert named == {(5, 36, 1, False), (5, 2, 5, True), (1, 37, 1, True), (None, 36, 1, True), (None, 1, None, True), (7, 0, 7, True), (7, 36, 1, False)}
    assert len({r.group for r in got.collect() if r.component_id == 1}) == 1
    assert minhash_dedup.near_duplicates(rows(spark, ["a"]).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


# --- 4 and 6 -----------------------------------------------------------------------------


def test_language_evidence(spark):
    rng = random.Random(8)
    make = {"aa": lambda: " ".join(rng.choice(("lorem", "ipsum", "dolor", "amet")) for _ in range(60)), "bb": lambda: " ".join(rng.choice(("kivi", "talo", "meri", "puu")) for _ in range(60))}
    docs = spark.createDataFrame([(i, k, make[k]()) for i in range(40) for k in ("aa", "bb")], "doc_id long, lang string, text string")
    page = lambda lang, text: f'<html lang="{lang}-XX"><head><title>x</title></head><body><p>{text}</p></body></html>'
    data = [(i, f"http://h{i % 3}.one.aa/p", page("aa", make["aa"]())) for i in range(30)] + [(100 + i, "http://x.two.bb/p", page("bb", make["bb"]())) for i in range(30)]
    data += [(200, "http://x.two.bb/q", page("bb", "")), (201, "http://h1.one.aa/q", None), (202, None, ""), (202, None, "")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {}
    for r in language_id.identify(pages, language_id.fit(docs)).collect():
        got.setdefault(r.page_id, []).append(r)
    assert all(got[i][0].lang == "aa" for i in range(30)) and all(got[100 + i][0].lang == "bb" for i in range(30))
    assert got[200][0].lang == "bb" and got[201][0].lang == "aa" and len(got[202]) == 2
    assert all(0 < r.probability <= 1.0 + 1e-9 for v in got.values() for r in v)
    assert language_id.address("https://u@WWW.a.example.Org:80/x") == ("org", "example.org", "www.a.example.org") and language_id.address("nothing") == ("", "", "")


def test_language_evidence_by_the_formula(spark):
    """Every page's posterior worked out from its texts and from all other pages, with plain sums."""
    rng = random.Random(21)
    letters = {"aa": "abcdefgh ", "bb": "efghijkl ", "cc": "ijklabmn "}
    make = {k: (lambda v=v: "".join(rng.choice(v) for _ in range(rng.randint(20, 120)))) for k, v in letters.items()}
    training = [(i, make[k](), k) for i, k in enumerate(["aa", "bb", "cc"] * 8)] + [(99, "", "aa"), (98, None, "bb")]
    docs = spark.createDataFrame(training, "doc_id long, text string, lang string")
    data = []
    for i in range(60):
        k = rng.choice(list(letters))
        text = make[k]() if rng.random() < 0.8 else rng.choice(("", "ef", "ijkl"))
        tag = rng.choice((f' lang="{k}"', ' lang="aa-XX"', ""))
        data.append((i // 2, f"http://h{rng.randint(0, 3)}.d{rng.randint(0, 2)}.{rng.choice(('aa', 'bb'))}/x" if rng.random() < 0.9 else None, f"<html{tag}><body>{text}</body></html>"))
    data += [(None, None, None), (7, "http://h0.d0.aa/", "")]
    pages = spark.createDataFrame([(*r, "clash", 1.0, "x") for r in data], "page_id long, url string, html string, lang string, probability double, host string")
    got = sorted((str(r.page_id), str(r.url), round(r.probability, 3), r.lang, r.declared, r.host) for r in language_id.identify(pages, language_id.fit(docs)).collect())

    def buckets(text):
        raw = (text or "").lower().encode()
        return [(int.from_bytes(raw[i : i + 4], "little") * 0x9E3779B97F4A7C15 % (1 << 64)) >> 49 for i in range(len(raw) - 3)]

    names = sorted(letters)
    counts = {k: np.full(1 << 15, 0.5) for k in names}
    for _, text, k in training:
        np.add.at(counts[k], buckets(text), 1)
    table = {k: np.log(v / v.sum()) for k, v in counts.items()}
    log, groups = [], []
    for _, url, html in data:
        b = buckets(language_id.visible(html))
        log.append(np.array([table[k][b].sum() / 4 * 64 / (64 + len(b)) for k in names]))
        groups.append((language_id.declared(html), *language_id.address(url)))
    own = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in log]
    want = []
    for i, (page, url, _) in enumerate(data):
        others = [sum((own[j] for j in range(len(data)) if j != i and groups[j][g] == groups[i][g]), np.zeros(3)) for g in range(4)]
        everywhere = sum(own[j] for j in range(len(data)) if j != i)
        prior = (everywhere + 1 / 3) / (everywhere.sum() + 1)
        for n in (others[2], others[3]):
            prior = (n + 8 * prior) / (n.sum() + 8)
        total = log[i] + np.log(prior)
        for n in (others[0], others[1]):
            rate = (n.sum() + 0.5) / (everywhere.sum() + 1)
            total = total + np.log((n + 8 * rate) / (everywhere + 8))
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        want.append((str(page), str(url), round(float(p.max()), 3), names[int(p.argmax())], groups[i][0], groups[i][3]))
    assert [(a, b, *rest) for a, b, _, *rest in got] == [(a, b, *rest) for a, b, _, *rest in sorted(want)]
    assert all(abs(x[2] - y[2]) <= 0.002 for x, y in zip(got, sorted(want), strict=True))
    assert language_id.identify(pages.limit(0), language_id.fit(docs.limit(0))).count() == 0


def test_pages_are_read_as_browsers_do():
    p = Page("<p>a<b>b</b>c<p>d &amp; e<br>f<ul><li>x<li>y</ul><script>var t='</p>'</script><!-- <p>no --><td>t &am")
    assert p.content([True] * len(p.nodes)) == "abc d & e f x y t &am"
    assert Page("").content([True]) == "" and Page("<").content([True]) == "<" and Page("text <p").content([True]) == "text"


def test_unclosed_elements_take_linear_time():
    start = time.perf_counter()
    assert len(Page("<div>" * 200_000).nodes) == 200_001
    page = Page("<li><p>" * 70_000 + "</ul>" * 70_000 + "end")
    assert time.perf_counter() - start < 10 and page.content([True] * len(page.nodes)) == "end"


HAND_LABELLED = [
    (
        '<!DOCTYPE html><html lang=en><head><title>Rye bread</title><style>p{}</style></head><body>\n<header class="site-header"><a href="/">Bakery News</a><nav><ul><li><a href=/a>Home</a><li><a href=/b>Recipes</a><li><a href=/c>About us</a></ul></nav></header>\n<main><article class="post"><h1>How to bake rye bread</h1><p>Rye flour takes up more water than wheat flour, so the dough stays soft &amp; sticky. Leave it to rest for an hour, then shape it with wet hands.</p>\n<p>Bake the loaf in a very hot oven for ten minutes, turn the heat down, and give it another fifty. It is done when it sounds hollow.</p><ul><li>500 g of rye flour</li><li>400 ml of water</li></ul></article></main>\n<aside class="sidebar"><h3>Popular</h3><ul><li><a href=/1>Ten cakes</a></li><li><a href=/2>Best ovens</a></li></ul></aside>\n<div id="cookie-notice">We use cookies. <button>Accept</button></div><footer>&copy; 2024 Bakery News. All rights reserved.</footer></body></html>',
        'How to bake rye bread Rye flour takes up more water than wheat flour, so the dough stays soft & sticky. Leave it to rest for an hour, then shape it with wet hands. Bake the loaf in a very hot oven for ten minutes, turn the heat down, and give it another fifty. It is done when it sounds hollow. 500 g of rye flour 400 ml of water',
    ),
    (
        '<html><body><div id="menu"><a href="x">Start</a> | <a href="y">Archive</a> | <a href="z">Contact</a></div>\n<div class="content"><div class="article-body"><h2>The bridge opens at last</h2><p>After four years of work, the new bridge over the river was opened on Monday by the mayor, who thanked the builders for their patience.</p><blockquote>It is longer than the old one, and far safer, said one of them.</blockquote><p>Traffic will be let across from Thursday on; until then, only walkers may use it.</p></div>\n<div class="comments"><h3>Comments</h3><div class="comment"><b>joe</b> Finally! About time, it was.</div><div class="comment"><b>ann</b> Nice bridge, I walked over it.</div><form><textarea></textarea><input type=submit></form></div></div>\n<div class="ad-banner">Buy now: cheap tyres, <a href=q>click here</a></div></body></html>',
        'The bridge opens at last After four years of work, the new bridge over the river was opened on Monday by the mayor, who thanked the builders for their patience. It is longer than the old one, and far safer, said one of them. Traffic will be let across from Thursday on; until then, only walkers may use it.',
    ),
    (
        '<body><nav class=top><a href=1>One</a><a href=2>Two</a></nav><section class="story"><h1>Notes on a small garden</h1><p>Beans need poles, and peas need nets. Sow both in April, a hand apart, and water them in the evening, never at noon.</p><script>var x = "<p>not text</p>";</script><table><tr><th>Month</th><td>Work</td></tr><tr><th>May</th><td>Thin the carrots out</td></tr></table><p>In June, the first lettuce is ready; cut it before it bolts.</p></section><footer><p>Imprint</p><p>Privacy</p></footer></body>',
        'Notes on a small garden Beans need poles, and peas need nets. Sow both in April, a hand apart, and water them in the evening, never at noon. Month Work May Thin the carrots out In June, the first lettuce is ready; cut it before it bolts.',
    ),
]


@pytest.mark.parametrize(("source", "text"), HAND_LABELLED)
def test_extraction_on_hand_labelled_pages(source, text):
    assert html_extract.main_texts([source]) == [text]


def test_extraction_on_pages_not_trained_on(spark):
    exact = total = 0
    for i in range(150):
        source, labels = html_extract.compose(10**9 + 7 * i)
        page = Page(source)
        want = page.content(np.array([1, *labels]) > 0)
        total += 1
        exact += html_extract.main_texts([source])[0] == want
    assert exact / total > 0.85
    data = [(1, "u", "<nav><a href=x>menu</a></nav><article><h1>T</h1><p>Some text, here. And more of it, for length.</p></article><footer>&copy; foot</footer>"), (2, None, None), (None, "u", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[1] == ("T Some text, here. And more of it, for length.", 46) and got[2] == got[None] == ("", 0)


# --- 5, 8, 9 -------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [*ODD, "  two  spaces\n\nand lines \n", "\r\ttabs;\r", prose(random.Random(9), 5000)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(rows(spark, texts), PIECE).collect()}
    want = {i: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in enumerate(texts)}
    assert got == want


def test_small_caches_change_nothing():
    texts = [prose(random.Random(i), 200, 3000) for i in range(20)]
    few, many = ChunkEncoder(WORD, cache=50), ChunkEncoder(WORD)
    assert [few.encode([t])[0] for t in texts] == many.encode(texts)
    a, b = token_counts.PieceCounter(PIECE, cache=40), token_counts.PieceCounter(PIECE)
    assert [a.counts([t])[0] for t in texts] == b.counts(texts)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    texts = [*ODD, prose(random.Random(10), 300), "Hello, world... 'Tis; don't! 3.14 a_b"]
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = {r.doc_id: r for r in bpe.round_trip(rows(spark, texts), WORD).collect()}
    for i, x in enumerate(ids):
        assert got[i].n_tokens == len(x) and got[i].ids_sha256 == hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()
    real = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(rows(spark, texts), WORD), WORD).collect()}
    assert all(real[i] == (np.array(x, "<u4").tobytes(), library.decode(x, skip_special_tokens=False)) for i, x in enumerate(ids))


def test_lexicon_accepts_its_words_alone():
    rng = random.Random(11)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))).encode(): [rng.randrange(9000) for _ in range(rng.randint(1, 3))] for _ in range(800)}
    words = {w: i for w, i in words.items() if len(w) <= 32}
    lex = Lexicon(np.frombuffer(build(words), dtype=np.uint8))
    others = [w + b"a" for w in words if w + b"a" not in words] + [b"", b"zz", b"a" * 40]
    assert [np.frombuffer(lex.ids_of(int(n)), "<u4").tolist() for n in lex.numbers(list(words))] == list(words.values())
    assert (lex.numbers(others) == -1).all()
    plain = build({bytes([97 + i]) + b"ending": [i] for i in range(20)})
    assert len(Lexicon(np.frombuffer(plain, np.uint8)).final) < 12  # the shared suffix is there once
    assert (Lexicon(np.frombuffer(build({}), np.uint8)).numbers([b"a"]) == -1).all()


def test_token_shards(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    texts = [*ODD, *(prose(random.Random(i), 50) for i in range(40))]
    ids = [1000 - 3 * i for i in range(len(texts))]
    ids[3] = None
    docs = rows(spark, texts, ids)
    manifest = sst.write_tokens(docs, WORD, 2)
    got = sst.read_tokens(spark, manifest, digest=True).collect()
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    start, want = 0, []
    for i in order:
        x = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        want.append((ids[i], start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    for i in (0, 5, 20):
        assert sst.lookup(manifest, ids[i]) == [np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()]
    assert sst.lookup(manifest, 12345) == [] and sst.lookup(manifest, None)
    assert sst.token_table(docs.limit(0), WORD).count() == 0
    big = rows(spark, [prose(random.Random(i), 20_000) for i in range(12)], list(range(12))).coalesce(1)
    one, many = sst.write_tokens(big, WORD, 2), sst.write_tokens(big, WORD, 2, most=1)
    assert len(many) >= 6 > len(one) and len({r["path"] for r in many}) == len(many) and sst.lookup(many, 7) == sst.lookup(one, 7) != []
    assert sorted(tuple(r) for r in sst.read_tokens(spark, many, digest=True).collect()) == sorted(tuple(r) for r in sst.read_tokens(spark, one, digest=True).collect())
    again = rows(spark, ["one"] * 30 + ["two"] * 10, [4] * 30 + [None] * 10)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in sst.token_table(again, WORD).collect()) == [(0, 2)] * 10 + [(4, 2)] * 30


def test_table_format(tmp_path):
    path = tmp_path / "a.sst"
    file = path.open("wb")
    w = sst.Writer(file)
    entries = [(sst.key_of(i // 2 - 500), bytes([i % 251]) * (i % 400)) for i in range(3000)]
    for k, v in entries:
        w.add(k, v)
        assert len(w.block) < 2 * sst.BLOCK
    w.finish()
    file.close()
    r = sst.Reader(str(path))
    assert list(r.scan()) == entries and len(r.where) > 3
    assert r.get(sst.key_of(-500)) == [b"", bytes([1])] and r.get(sst.key_of(10**6)) == []
    assert sum(bool(r.get(sst.key_of(i))) for i in range(5000, 6000)) == 0
    assert all(sst.value_of(sst.key_of(v)) == v for v in (None, 0, -1, 2**63 - 1, -(2**63)))
    data = bytearray(path.read_bytes())
    data[100] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        list(sst.Reader(str(path)).scan())
    with pytest.raises(ValueError, match="order"):
        w = sst.Writer(io.BytesIO())
        w.add(b"b", b"")
        w.add(b"a", b"")


# --- 7 and 10 ---------------------------------------------------------------------------------


def brute_sketch(text, known):
    """Hashes of a text's shingles, each made by itself, and those that a sketch keeps."""
    raw = text.encode()
    shingles = {raw[i : i + 16] for i in range(max(1, len(raw) - 15))} if raw else set()
    new = [x for x in shingles if x not in known]
    if new:
        alone = fingerprints.Sketches(pa.array(new, pa.binary()))
        known.update({x: int(alone.of(i)[0]) for i, x in enumerate(new)})
    every = sorted({known[x] for x in shingles})
    return [h for i, h in enumerate(every) if i < 16 or h < 1 << 32]


def brute_likeness(a, b, same):
    below = [{h for h in x if h < 1 << 32} for x in (a, b)]
    both = below[0] | below[1]
    if len(both) < 16:
        both = set(sorted({*a, *b})[:16])
    return len(both & set(a) & set(b)) / len(both) if both else float(same)


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(12)
    texts = [*ODD, *(prose(rng, 150, 900) for _ in range(30)), *(prose(rng, 6, 50) for _ in range(60))]
    texts += [texts[-1], texts[-2] + " tail", prose(rng, 4000, 9000)]
    ids = rng.sample(range(-50, 500), len(texts))
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(rows(spark, texts, ids)).collect()}
    order = sorted(zip(ids, (t or "" for t in texts), strict=True), reverse=True)
    known: dict = {}
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        own, edited, following = (brute_sketch(x, known) for x in (t, e, n))
        assert fingerprints.parse(r.fingerprint) == own and fingerprints.parse(r.edited_fingerprint) == edited
        assert r.near_edited == pytest.approx(brute_likeness(own, edited, t == e))
        assert r.near_next == pytest.approx(brute_likeness(own, following, t == n))
    by_text: dict = {}
    for i, t in order:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert len(set(by_text.values())) == len(by_text)
    one = fingerprints.compare_with_edits(rows(spark, ["abc def"])).first()
    assert one.near_next == 1.0 and fingerprints.compare_with_edits(rows(spark, ["a"]).limit(0)).count() == 0
    again = fingerprints.compare_with_edits(rows(spark, ["b", "a", "b", None], [1, 1, 1, None])).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in again) == [(0, 0), (1, 1), (1, 1), (1, 1)]


def test_sketches_merge_into_that_of_the_whole():
    rng = random.Random(15)
    for size in (3, 40, 4000):
        one, two = prose(rng, size, 9000), prose(rng, size, 9000)
        parts = fingerprints.Sketches(pa.array([one, two])).strings()
        known: dict = {}
        every = sorted({*(h for t in (one, two) for h in _all_hashes(t, known))})
        assert fingerprints.parse(fingerprints.merge(*parts)) == [h for i, h in enumerate(every) if i < 16 or h < 1 << 32]


def _all_hashes(text, known):
    brute_sketch(text, known)
    raw = text.encode()
    return {known[raw[i : i + 16]] for i in range(max(1, len(raw) - 15))}


def test_containment_of_very_unequal_texts(spark):
    rng = random.Random(13)
    part = prose(rng, 200, 9000)
    whole = prose(rng, 20_000, 9000) + " " + part
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(rows(spark, [part, whole, prose(rng, 200, 9000) + " z"])).collect()}
    assert fingerprints.containment(got[0], got[1]) > 0.95 and fingerprints.containment(got[2], got[1]) < 0.4
    assert fingerprints.containment(got[1], fingerprints.merge(got[0], got[1])) == 1.0


def brute_overlaps(docs, items, size=8):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in items:
        w = pattern.findall((t or "").translate(LOW))
        k = min(len(w), size)
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w = pattern.findall((t or "").translate(LOW))
        hit, names = set(), set()
        for k in {len(g) for g in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    names |= windows[tuple(w[p : p + k])]
        out[i] = (len(w), len(hit), sorted(names), len(names) >= 2)
    return out


@pytest.mark.parametrize("most", [10**6, 300])
def test_overlaps_equal_brute_force(spark, most):
    rng = random.Random(14)
    items = [(i, prose(rng, rng.choice((1, 3, 7, 8, 9, 30)), 80)) for i in range(25)] + [(25, None), (26, "..."), (27, "Ünï CODE x"), (28, prose(rng, 900, 80)), (29, "y" * 3000)]
    texts = [*ODD, items[-2][1][1000:2500], items[-2][1].upper(), "a " + items[-1][1] + " b"]
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 30), 80)]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(items)[1] or "", prose(rng, 5, 80)]
        texts.append(", ".join(parts).upper() if rng.random() < 0.5 else "; ".join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.find_overlaps(rows(spark, texts), bench, most_windows=most).collect()}
    assert got == brute_overlaps(list(enumerate(texts)), items)
    empty = decontaminate.find_overlaps(rows(spark, texts), bench.limit(0), rest=True, clean_text=True).collect()
    assert all(r.n_hit == 0 and r.clean == texts[r.doc_id] and r.rest.n_words == 7 for r in empty)


def test_hit_words_are_taken_out(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    got = decontaminate.find_overlaps(rows(spark, [f"before {item}, after"]), spark.createDataFrame([(1, item)], "item_id long, text string"), clean_text=True).first()
    assert got.clean == "before , after" and got.n_hit == 8 and not got.contaminated


@pytest.mark.parametrize("name", ["toxicity", "language", "counts", "extraction", "fingerprints", "shards", "bpe", "overlaps", "near", "repeats"])
def test_odd_tables(spark, name):
    """Empty tables, equal rows, a text of 380,000 characters and columns named like the operator's own."""
    long = "word and " * 40_000 + "x" * 20_000
    docs = rows(spark, ["one two", "one two", None, "", long], [1, 1, 2, 3, 4]).withColumns({"lang": F.lit("en"), "text_hash": F.lit("c"), "n_tokens": F.lit("c"), "kept": F.lit("c"), "url": F.lit("http://a.b/"), "hash": F.lit("c"), "rest": F.lit("c"), "own": F.lit("c"), "key": F.lit("c"), "place": F.lit("c")})
    bench = spark.createDataFrame([(1, "one two"), (1, "one two")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    run = {
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "language": lambda d: language_id.identify(d.withColumnRenamed("text", "html").withColumnRenamed("doc_id", "page_id"), language_id.fit(docs)),
        "counts": lambda d: token_counts.count_tokens(d, PIECE),
        "extraction": lambda d: html_extract.extract(d.withColumnRenamed("text", "html").withColumnRenamed("doc_id", "page_id")),
        "fingerprints": fingerprints.compare_with_edits,
        "shards": lambda d: sst.token_table(d, WORD),
        "bpe": lambda d: bpe.round_trip(d, WORD),
        "overlaps": lambda d: decontaminate.find_overlaps(d, bench),
        "near": minhash_dedup.near_duplicates,
        "repeats": substring_dedup.find_repeats,
    }[name]
    got = run(docs).collect()
    ids = [r["page_id"] if "page_id" in r.__fields__ else r["doc_id"] for r in got]
    assert sorted(ids) == [1, 1, 2, 3, 4]
    one = [tuple(x for k, x in r.asDict().items() if k not in ("start", "edited_sha256", "edited_fingerprint", "near_edited", "near_next")) for r, i in zip(got, ids, strict=True) if i == 1]
    assert one[0] == one[1]
    assert run(docs.limit(0)).count() == 0


# --- the queries and the pipeline -------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the generated tables are not here")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, DATA), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(want.select(*columns).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the generated tables are not here")
def test_pipeline_equals_brute_force_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.written(corpus_pipeline.drop_toxic(spark, docs, DATA), "test")
    assert kept.columns == columns and 0 < kept.count() <= docs.count()
    near = corpus_pipeline.written(corpus_pipeline.drop_near_copies(spark, kept, DATA), "test")
    want = brute_near([(r.doc_id, r.text) for r in kept.collect()])
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in want.items() if c == i} and near.columns == columns
    cut = corpus_pipeline.written(corpus_pipeline.cut_repeats(spark, near, DATA), "test")
    before = {r.doc_id: r.text for r in near.collect()}
    brute = brute_repeats(list(before.items()))
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts == {i: (before[i] if not n else t) for i, (_, n, t) in brute.items()} and cut.columns == columns
    assert all(r.n_chars == len(r.text or "") for r in cut.collect() if brute[r.doc_id][1])
    clean = corpus_pipeline.written(corpus_pipeline.drop_leaks(spark, cut, DATA), "test")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = brute_overlaps(list(texts.items()), items)
    assert {r.doc_id for r in clean.collect()} == {i for i, v in leaks.items() if not v[3]} and clean.columns == columns
    assert all(r.text == texts[r.doc_id] for r in clean.collect() if not leaks[r.doc_id][1])
    last = corpus_pipeline.encode(spark, clean, DATA)
    assert last.count() == clean.count()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages_keep_odd_rows_and_columns(spark, tmp_path):
    """Repeated and null identifiers, null texts, equal rows and columns named like an operator's."""
    import corpus_pipeline

    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    data = [
        (5, "a b c"), (5, "other text"), (1, "a b c"), (5, "other text"), (None, "a b c"), (None, "only here"), (None, None), (7, None), (7, ""), (8, " ")
    ]
    fields = [(i, t, None, "s", len(t or ""), 42.0, 9, ["x"], "rest", -1, "k", 3) for i, t in data]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, passages array<string>, rest string, n_words int, `id` string, `group` int"
    docs = spark.createDataFrame(fields, kind)

    def texts(df):
        assert df.columns == docs.columns and all((r.score, r.predicted, r.passages, r.rest, r.n_words, r.id, r.group) == (42.0, 9, ["x"], "rest", -1, "k", 3) for r in df.collect())
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    assert texts(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))) == sorted(data, key=str)
    near = [(1, "a b c"), (5, "other text"), (None, "only here"), (None, None), (7, None), (7, ""), (8, " ")]
    assert texts(corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))) == sorted(near, key=str)
    assert texts(corpus_pipeline.cut_repeats(spark, docs, str(tmp_path))) == sorted(data, key=str)
    assert texts(corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))) == sorted(data, key=str)
    assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == len(data)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
