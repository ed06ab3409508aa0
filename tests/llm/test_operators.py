import hashlib
import math
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.llm import hilbert_ann, html_text, language_id, lattice_dedup, license_scan, maxent_lm, warc
from strandloom.llm.common import Scratch, connected_components


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string, v int")


def odd_vectors(dim):
    z = [0.0] * dim
    return [(900, None, "x", 1), (901, z, "x", 1), (902, [float("nan")] * dim, "x", 1), (903, [1.0] * (dim - 1) + [float("inf")], "x", 1), (904, [None] + [1.0] * (dim - 1), "x", 1), (905, [], "x", 1), (906, [1.0, 2.0], "x", 1), (None, [1.0] * dim, "x", 1)]


def unit_rows(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return [(i, [float(y) for y in r], "x", 1) for i, r in enumerate(x)]


def test_nearest_neighbours(spark):
    rows = unit_rows(120, 12, 1)
    rows += [(200 + i, rows[3][1], "x", 1) for i in range(40)]  # copies of one vector
    got = hilbert_ann.nearest(vectors(spark, rows + odd_vectors(12)), Scratch(spark, "t"), F.col("vec_id") % 10 == 0, k=5, reach=1.0).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    want = set()
    for q in range(len(ids)):
        if ids[q] % 10 == 0:
            d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            d[q] = np.inf
            for rank, j in enumerate(np.lexsort((ids, d))[:5], 1):
                want.add((int(ids[q]), rank, int(ids[j]), round(float(d[j]), 9)))
    assert {(g.query_id, g.rank, g.id, round(g.score, 9)) for g in got} == want
    assert hilbert_ann.nearest(vectors(spark, []), Scratch(spark, "t"), F.lit(True)).count() == 0
    two = vectors(spark, rows[:2])
    assert hilbert_ann.nearest(two, Scratch(spark, "t"), F.lit(True)).count() == 2


def test_nearest_neighbours_of_near_copies(spark):
    """Half of the rows share one place on the curve: the rows on either side of it find them."""
    x = np.concatenate([1e-6 * np.arange(600), [-0.3, 0.3], np.linspace(1, 3, 300), np.linspace(-3, -1, 300)])
    rows = [(i, [float(y)], "x", 1) for i, y in enumerate(x + 0.01)]
    got = hilbert_ann.nearest(vectors(spark, rows), Scratch(spark, "t"), F.col("vec_id").isin(600, 601), k=5, curves=1).collect()
    assert {g.id for g in got if g.query_id == 600} == set(range(5)) and {g.id for g in got if g.query_id == 601} == set(range(595, 600))


def test_cells_of_a_hot_place():
    keys = np.concatenate([np.full(4000, 7), np.arange(100, 8100)])
    cuts = np.array(sorted(keys)[len(keys) // 16 :: len(keys) // 16][:15])
    own, first, last = hilbert_ann.cells_of(cuts, keys, hilbert_ann.mix(np.arange(len(keys)).astype(np.uint64)))
    assert np.bincount(own, minlength=16).max() <= 2 * len(keys) / 16 and (own >= first).all() and (own <= last).all()
    assert np.bincount(own, minlength=16).min() > 0


def test_lattice_links(spark):
    rng = np.random.default_rng(2)
    rows = unit_rows(60, 16, 3)
    for i in range(50):
        base = np.array(rows[i % 4][1])
        rows.append((100 + i, [float(y) for y in (base + rng.normal(size=16) * 0.02).astype(np.float32)], "x", 1))
    rows += [(300 + i, rows[1][1], "x", 1) for i in range(5)]
    got = {g.id: g for g in lattice_dedup.near_duplicates(vectors(spark, rows + odd_vectors(16)), Scratch(spark, "t"), square=8).collect() if g.id is not None}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    ids = np.array([r[0] for r in rows])
    root = lattice_dedup._components(*np.nonzero(close), len(ids))
    for i, k in enumerate(ids.tolist()):
        assert (got[k].n_links, got[k].component, got[k].kept) == (close[i].sum(), min(ids[root == root[i]]), k == min(ids[root == root[i]]))
    assert all((got[k].n_links, got[k].component, got[k].kept) == (0, k, True) for k in range(900, 907))
    assert lattice_dedup.near_duplicates(vectors(spark, []), Scratch(spark, "t")).count() == 0


def test_lattice_recall_at_three_blocks(spark):
    """Pairs at the threshold are found as often with the three blocks of large tables as with two."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        a, z = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        z -= (z @ a) * a
        b = 0.951 * a + math.sqrt(1 - 0.951**2) * z / np.linalg.norm(z)
        rows += [(2 * i, [float(y) for y in a], "x", 1), (2 * i + 1, [float(y) for y in b], "x", 1)]
    got = lattice_dedup.near_duplicates(vectors(spark, rows), Scratch(spark, "t"), blocks=3)
    assert got.where("n_links > 0").count() >= 2 * 0.96 * 300


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = connected_components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c").collect()
    assert {(g.node, g.component) for g in got} == {(i, find(i)) for i in root}


def test_warc_round_trip(spark):
    bodies = ["", "same", "same", "é" * 3000, None, "same", "<p>x</p>\r\n\r\n"]
    rows = [(i, f"http://h/{i}\r\nX: y%" if i else None, b, "x") for i, b in enumerate(bodies)] + [(None, None, "same", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")
    scratch = Scratch(spark, "t")
    folder = scratch.path("a")
    index = scratch.table(warc.write_archives(pages, folder, frame_bytes=100, bundle_bytes=300), "index")
    got = {x.record_id: x for x in warc.read_archives(index, folder).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, url, b, _ in rows:
        x, body = got[f"urn:page:{'null' if i is None else i}"], (b or "").encode()
        assert (x.url, x.payload_bytes, x.payload_digest) == (url, len(body), warc.sha1_base32(body))
        refers = first.get(body)
        first.setdefault(body, f"urn:page:{i}")
        assert (x.record_type, x.refers_to) == (("revisit", refers) if refers else ("response", None))
        assert x.payload is None if refers else bytes(x.payload) == body
    assert len(hashlib.sha1(b"").hexdigest()) == 40
    some = warc.fetch_records(index, folder, spark.createDataFrame([("urn:page:3",)], "record_id string")).collect()
    assert len(some) == 1 and bytes(some[0].payload) == ("é" * 3000).encode()
    empty = scratch.table(warc.write_archives(pages.limit(0), scratch.path("b")), "none")
    assert warc.read_archives(empty, scratch.path("b")).count() == 0


def test_suffix_automaton_and_parsing():
    rng = random.Random(1)
    s = [rng.randrange(3) for _ in range(60)]
    a = language_id.SuffixAutomaton(s)
    have = {tuple(s[i:j]) for i in range(60) for j in range(i, 61)}
    for n in range(1, 7):
        for _ in range(50):
            w = [rng.randrange(3) for _ in range(n)]
            state = 0
            for c in w:
                state = a.next[state].get(c)
                if state is None:
                    break
            assert (state is not None) == (tuple(w) in have)
    samples = {"x": ["abc abd abe"], "y": ["qrs qrt"]}
    texts = ["abc qzs", "", "123 !!", "ABC" * 40, "q" * 30]
    more = ["".join(rng.choices("abcdeqrst ", k=rng.randint(1, 90))) for _ in range(60)] + ["abc abd abe" * 9, "abqrab" * 20]
    for block in (3, 8, 256):
        model = language_id.LanguageModel(samples, symbols=16, block=block)
        phrases, _, n_letters = model.phrases(texts + more)
        for k in range(2):
            table = model.tables[k].reshape(-1, 16)
            for i, t in enumerate(texts + more):
                sym, _ = model.fold([t])
                state, count = 0, int(len(sym) > 0)
                for c in sym:
                    if table[state, c] < 0:
                        count += 1
                        state = max(table[0, c], 0) // 16
                    else:
                        state = table[state, c] // 16
                assert phrases[k, i] == count
    n_letters = n_letters[:5]
    assert n_letters.tolist() == [6, 0, 0, 120, 30]
    langs, score = model.predict(texts)
    assert langs[1:4] == ["und", "und", "x"] and langs[4] == "y" and score[1] == 0 and (score <= 1).all()


def test_language_columns(spark):
    rows = [(i, t, lang, "old", 9) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("", None), ("the dog", None)] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    model = language_id.train(df)
    got = language_id.identify(df, model).collect()
    assert len(got) == len(rows) and all(x.lang_pred == "und" and x.score == 0 for x in got if not x.text)
    assert all(x.lang_pred == "en" for x in got if x.text == "the dog")
    assert language_id.identify(df.limit(0), model).count() == 0
    none = language_id.train(df.where("lang IS NULL"))
    assert {x.lang_pred for x in language_id.identify(df, none).collect()} == {"und"}


def test_language_model_base(spark):
    texts = ["The cat. The CAT", None, "", "a b\tc\x0bd", "the the the", "x" * 500] * 4
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, "a b\tc\x0bd")], "doc_id long, text string")
    scratch = Scratch(spark, "t")
    learn = docs.where("doc_id % 3 <> 0")
    counts = scratch.table(maxent_lm.count_words(learn), "c")
    model, n, v = maxent_lm.train(learn, counts, head=3, rounds=2)
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\0"]
    c = Counter(w for i, t in enumerate(texts) if i % 3 for w in tok(t))
    assert (n, v) == (sum(c.values()), len(c))
    for x in maxent_lm.score(docs, model, counts, n, v, ["doc_id"]).collect():
        words = tok(texts[x.doc_id])
        assert x.n_tokens == len(words) and x.n_known == sum(c[w] > 0 for w in words)
        assert abs(x.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)) < 1e-9
        assert x.score < 0


def test_language_model_is_a_distribution(spark):
    """In any context, the probabilities of all known words and of one unknown word a member make one."""
    rng = random.Random(4)
    vocabulary = [f"{rng.choice('abcdefgh')}{i}{rng.choice(['en', 'er', 'ing', 'st', 'x'])}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(400)], k=80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = Scratch(spark, "t").table(maxent_lm.count_words(docs), "c")
    model, n, v = maxent_lm.train(docs, counts, head=200)
    known = sorted({w for t in texts for w in t.split()})
    ends = [f"{'q' * 9}{i}{t}" for i in range(300) for t in ("en", "er", "ng", "st")]  # words never seen

    def log10(context, words):
        t = maxent_lm.tokens_of(*maxent_lm_buffers([f"{context} {w}" for w in words]))
        leaf, _, p_class, _, p_member = model.predict(t)
        at = np.flatnonzero(np.diff(t.doc, append=len(words)) != 0) - 1  # the last word of each text
        return leaf[at], np.log10(p_class[at, leaf[at] // 16].astype(float) * p_member[at, leaf[at] % 16])

    c = Counter(w for t in texts for w in t.split())
    for context in ("", known[0], f"{known[3]} {known[7]}"):
        leaf, lp = log10(context, known)
        total = sum(10 ** (p - model.log_share[m]) * (c[w] + 1) for w, m, p in zip(known, leaf, lp, strict=True))
        t = maxent_lm.tokens_of(*maxent_lm_buffers([context]))  # the end token
        leaf, _, p_class, _, p_member = model.predict(t)
        total += float(p_class[-1, leaf[-1] // 16] * p_member[-1, leaf[-1] % 16]) * (len(texts) + 1) / 10 ** model.log_share[0]
        # members keep one share for words never seen; those without any known word are such a share alone
        q = maxent_lm.tokens_of(*maxent_lm_buffers([f"{context} {w}" for w in ends]))
        leaf, _, p_class, _, p_member = model.predict(q)
        at = np.flatnonzero(np.diff(q.doc, append=len(ends)) != 0) - 1
        every = (p_class[at[0]][:, None] * model.softmax(model.log_member, member_rows(model, q, at[0]))).reshape(-1)
        total += sum(every[m] / 10 ** model.log_share[m] for m in range(maxent_lm.HEADS, maxent_lm.LEAVES))
        total += sum(every[m] for m in range(1, maxent_lm.HEADS) if 10 ** model.log_share[m] <= 1.0)
        assert abs(total - 1) < 1e-3, (context, total)
    scored = maxent_lm.score(docs, model, counts, n, v, ["doc_id"])
    assert scored.where("score <= base_score").count() < 30  # it learns


def maxent_lm_buffers(texts):
    from strandloom.llm.common import text_buffers

    return text_buffers(pa.array(texts))


def member_rows(model, t, i):
    """Rows of weights of the members of all classes, in the context of token i."""
    one = maxent_lm.Tokens(*(np.repeat(x[i : i + 1], 16) for x in (t.words, t.tails, t.doc, t.before, t.before2)), 1)
    return model.rows_of(one, np.arange(16))[1]


def test_main_text(spark):
    page = lambda body: f"<html><head><title>t</title></head><body><nav><a href='/'>menu</a></nav>{body}<footer>&copy; f</footer></body></html>"
    rows = [(i, "http://h.example/x", page(f"<div class='post-{i}'><h1>A &amp; b {i}</h1><p>Long  enough\n text {i}<br>more<p>next</div><div class='comments'>c</div>"), "x") for i in range(5)]
    rows += [(10, "http://h.example/y", page("<div class='post-9'>s</div><div class='box'>much longer text than the post has, by far</div>"), "x"), (11, None, None, "x"), (12, "no url", "<p>a<b>b", "x"), (13, "http://h.example/z", page("<section>only</section>"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {x.page_id: x.text for x in html_text.main_text(df).collect()}
    assert got[0] == "A & b 0\n\nLong enough text 0 more\n\nnext"
    assert got[10] == "s" and got[11] == "" and got[12] == "ab" and got[13] == "only"
    assert html_text.main_text(df.limit(0)).count() == 0


def test_main_text_keeps_what_is_beside_the_largest_container():
    text = lambda body: (lambda p: p.text(p.best()[0]))(html_text.Page(f"<body><nav><a href='/'>menu</a></nav>{body}<footer>f</footer></body>"))
    long = "long text of the body " * 20
    assert text(f"<article><h1>Title</h1><p>Standfirst</p><div class='body'>{long}</div></article>") == f"Title\n\nStandfirst\n\n{long.strip()}"
    assert text(f"<div class='post'><h1><a href='/x'>Title</a></h1><div class='body'>{long}</div></div>") == f"Title\n\n{long.strip()}"
    assert text(f"<section class='a'>{'one ' * 65}</section><section class='b'>{'two ' * 35}</section>") == f"{('one ' * 65).strip()}\n\n{('two ' * 35).strip()}"
    assert text(f"<article><p>Before</p><table><tr><td>{long}</td></tr></table></article>") == f"Before\n\n{long.strip()}"
    assert text(f"<div class='list'><a href='/a'>One</a> | <a href='/b'>Another page</a></div><div class='post'>{long}</div>") == long.strip()


def test_main_text_by_names_of_elements():
    text = lambda body: (lambda p: p.text(p.best()[0]))(html_text.Page(f"<body><nav class='top'><a href='/'>menu</a></nav>{body}<footer>f</footer></body>"))
    long = ("long text of the body " * 20).strip()
    for name in ("content no-sidebar", "wrap has-menu", "content-sidebar-wrap", "layout-with-sidebar"):
        assert text(f"<div class='{name}'><p>{long}</p></div>") == long, name
    assert text(f"<form id='aspnet'><div class='post'><h1>T</h1><p>{long}</p></div></form>") == f"T\n\n{long}"
    assert text(f"<article><p>{long}</p><p class='advert'>Buy now<p>More</article>") == f"{long}\n\nMore"
    assert text(f"<article><p>{long} <span class='share'>Share <b>it</b></span>end</p></article>") == f"{long} end"
    assert text(f"<article><p>{long}</p></article><div class='comments-container'>{'comment ' * 200}</div>") == long
    assert text(f"<div class='post'><p>{long}</p></div><form><p>Search</p><input name='q'></form>") == long
    assert text(f"<div class='site-footer'>x</div><div class='post'><p>{long}</p><li class='related'>r</li></div>") == long
    assert text("<div class='post'><p>a</p></div><span class='ad'>never closed") == "a"


def test_licences(spark):
    mit = license_scan.KNOWN[0][1]
    texts = [mit, "Copyright (c) 2020 A\n\n" + mit.upper(), mit.replace("sublicense", "sub-licence").replace(",", " ;"), mit + " and more", "", None, "Copyright 1", "...", "Released under the MIT Licence"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    got = {x.doc_id: x.license_id for x in license_scan.license_scan(df).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: None, 8: "MIT"}
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_wrapped_licences(spark):
    """Known texts match at any width of their lines, with a notice in front."""
    rows = []
    for licence, text in license_scan.KNOWN:
        for width in range(40, 100, 3):
            wrapped = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
            rows += [(licence, wrapped), (licence, f"Copyright (c) 2020, A Name\nAll rights reserved.\n\n{wrapped}"), (licence, f"Copyright A Name\n\n{wrapped}")]
    df = spark.createDataFrame([(i, t, want) for i, (want, t) in enumerate(rows)], "doc_id long, text string, want string")
    got = license_scan.license_scan(df, keep=("doc_id", "want"))
    assert got.where("license_id IS NULL OR license_id <> want").count() == 0


def test_terms_are_no_notices(spark):
    licence, mit = license_scan.KNOWN[0]
    terms = ["(c) You owe the author 10 % of all income.", "Copyright 2020 X. Commercial use is forbidden.", "Copyright 2020 Example Group. Commercial redistribution costs extra.", "copyrighted works may not be used", "Copyright (c) 2020 A, all copies must be paid", "Copyright " + "word " * 40]
    notices = ["Copyright (c) 2019-2021 Jane Q. Doe <jane@example.org>", "# (C) 2020 Example Inc. and others. All rights reserved.", "\u00a9 The Regents of a University\nAll Rights Reserved.", "Copyright: 2001, 2003 by A. B. Name, Ltd.", "Copyright <YEAR> <COPYRIGHT HOLDER>"]
    rows = [(i, None, f"{mit}\n{t}") for i, t in enumerate(terms)] + [(10 + i, licence, f"{t}\n\n{mit}") for i, t in enumerate(notices)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, want string, text string"), keep=("doc_id", "want"))
    assert got.where("NOT (license_id <=> want)").collect() == []
