"""Operators 4, 5, 7, 9, 10 and the pipeline on small and skewed tables, against plain Python."""

import hashlib
import io
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.llm import ann, html_extract, jaccard, sharding, shingles, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    sets = [(i, plain_set(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, u in sets[:k]:
            if s and u and 100 * len(s & u) >= 80 * len(s | u):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def corpus(seed, n=260):
    """Copies, near copies of one base that are not all near each other, shared passages, short and odd texts."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(4000)]
    base = r.choices(vocab, k=60)
    passage = r.choices(vocab, k=40)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "A B C D"), (7, "a b c d e"), (8, "a b c d e f"), (None, "a b c d e f"), (9, "x " * 500)]
    for i in range(10, n):
        kind = r.randrange(6)
        if kind == 0:
            w = base[:]
        elif kind < 3:
            w = base[:]
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
        elif kind == 3:
            w = r.choices(vocab, k=20) + passage + r.choices(vocab, k=r.randint(0, 30))
        elif kind == 4:
            w = r.choices(vocab, k=r.randint(5, 14))
            rows.append((i + 1000, " ".join([*w, "tail"])))
        else:
            w = r.choices(vocab, k=r.randint(1, 90))
        rows.append((i, " ".join(w)))
    return [*rows, rows[-1]]


@pytest.mark.parametrize("light", [None, 0, 96, "hot"])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, light):
    if light == "hot":  # every key counts as hot, nothing is small enough to broadcast, and the table is of few counters
        for name, value in (("HOT_LIST", 1), ("BROADCAST_KEYS", -1), ("BROADCAST_IDS", -1), ("MOST_BITS", 8), ("LEAST_BITS", 8)):
            monkeypatch.setattr(jaccard, name, value)
        light = None
    elif light is not None:
        monkeypatch.setattr(jaccard, "BOUNDARIES", (light,))
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 700)
    rows = corpus(5 if light is None else light)
    want = plain_components(rows)
    got = jaccard.join(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.component_id == want[r.doc_id]
    sizes = {i: len(plain_set(t)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)


def test_size_buckets_hold_all_that_links():
    for n in [*range(1, 3000), 10**6, 10**8]:
        own, far = (sum(b <= x for b in jaccard.BUCKETS) for x in (n, 5 * n // 4))
        assert far - own <= 1


def test_levels_are_in_the_order_of_counts():
    counts = np.arange(0, 5000, dtype=np.int64)
    got = jaccard.levels(counts).astype(int)
    assert got[0] == 0 and got[1] == 1 and (np.diff(got) >= 0).all() and jaccard.levels(np.array([2**31 - 1]))[0] < 255


def test_jaccard_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(empty).count() == 0
    one = jaccard.join(spark.createDataFrame([(7, "a b")], "doc_id long, text string")).first()
    assert tuple(one) == (7, 1, 7)


def test_shingles_of_a_text_in_blocks(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{k % 97}é" for k in range(5000))
    whole = next(shingles.shingle_sets(pa.array([text])))
    monkeypatch.setattr(shingles, "BLOCK", 100)
    assert np.array_equal(next(shingles.shingle_sets(pa.array([text]))), whole) and len(whole) == len(plain_set(text))


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 60 + "</p>"
    rows = [(5, "http://a/", long), (2, "http://b/", long), (9, None, long), (2, "http://b/", long), (1, "u", "short"), (3, "v", "short"), (4, "w", None), (None, "x", long), (8, "y", "z" * 100), (7, "y", "z" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.new_path(spark, "warc-test")
    warc.write(pages, folder)
    got = warc.read(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = next((h or "") for p, u, h in rows if p == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        first = 2 if r.payload_bytes == len(long.encode()) else 7 if payload[:1] == b"z" else None
        revisit = first is not None and r.page_id != first
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
        assert r.payload == (None if revisit else payload)
    fs, base = warc.arrow_fs(folder)
    name = spark.read.parquet(f"{folder}/manifest").first().path
    z = zipfile.ZipFile(io.BytesIO(fs.open_input_file(f"{base}/{name}").read()))
    assert z.testzip() is None and set(z.namelist()) == {warc.ARCHIVE, warc.INDEX}
    assert warc.archive(pages.limit(0)).count() == 0


def test_zip_reader_reads_other_writers_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"hello")
        with z.open("b.bin", "w", force_zip64=True) as f:
            f.write(b"x" * 1000)
        z.comment = b"PK\x05\x06 not the end"
    data = out.getvalue()
    r = warc.ZipReader(lambda at, n: data[at : at + n], len(data))
    at, n = r.locate("b.bin")
    assert data[at : at + n] == b"x" * 1000 and r.locate("a.txt")[1] == 5
    with pytest.raises(ValueError):
        warc.ZipReader(lambda at, n: b"junk"[at : at + n], 4)
    assert struct.calcsize(warc._END64) == 56


def test_sharding_compacts_and_keeps_rows(spark):
    rows = [(i, None if i % 7 == 0 else f"text {i} " * (i % 50), "en") for i in range(600)] + [(5, "again", None), (700, "é" * 3_000_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(8)
    t = sharding.ShardTable(spark, sharding.new_path(spark, "shards-test"))
    for k in range(3):
        t.append(docs.where(F.col("doc_id") % 3 == k), arrival_bytes=2000)
    before = t.manifest().collect()
    assert t.version() == 3 and len(before) > 20
    with pytest.raises(sharding.Conflict):
        t.commit(2, t.manifest())
    t.compact(target=20_000, fan=4)
    after = t.manifest().collect()
    assert len(after) < len(before) and sum(s.rows for s in after) == len(rows) and t.plan(20_000, 4).isEmpty()
    got = t.read(docs.drop("shard").schema)
    assert got.drop("shard").exceptAll(docs.drop("shard")).isEmpty() and got.count() == len(rows)
    assert {r["shard"] for r in got.select("shard").distinct().collect()} == {s.name for s in after}
    # versions before the compaction can still be read, before and after a vacuum that keeps them
    assert t.read(docs.drop("shard").schema, 3).count() == len(rows) and t.read(docs.drop("shard").schema, 1).count() < len(rows)
    assert t.vacuum() == 0
    assert t.vacuum(keep=1, grace=0) >= len({s.name for s in before} - {s.name for s in after}) > 10 and t.read(docs.drop("shard").schema).count() == len(rows) and t.versions() == [t.version()]
    whole = sharding.shard(docs)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r[0] for r in rows)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_sharding_vacuum_spares_what_another_writer_has_yet_to_commit(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string").repartition(8)
    t, other = (sharding.ShardTable(spark, f) for f in [sharding.new_path(spark, "shards-race")] * 2)
    t.append(docs, arrival_bytes=500)
    commit = other.commit

    def late(base, shards):
        # the first writer compacts and cleans up between the second one's writing and its commit
        if t.version() == 1:
            assert t.compact(target=20_000) > 0
            t.vacuum(keep=1)
        return commit(base, shards)

    monkeypatch.setattr(other, "commit", late)
    other.append(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    assert sorted(r.doc_id for r in t.read(docs.schema).collect()) == sorted([*range(200), *range(1000, 1200)])


def test_sharding_merges_nothing_twice(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    t = sharding.ShardTable(spark, sharding.new_path(spark, "shards-twice"))
    t.append(docs, arrival_bytes=1)
    gone = t.plan(20_000, 4)
    assert not gone.isEmpty()
    held = spark.createDataFrame(gone.collect(), gone.schema)
    t.compact(target=20_000)
    with pytest.raises(sharding.Conflict):
        t._commit_new(spark.createDataFrame([], "name string, rows long, bytes long"), held, __import__("time").time())
    assert t.read(docs.schema).count() == 64


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="wrap"><div class="promo box">Buy {0}</div><article><header><h1>Title {0}</h1></header><p><b>Bold{0}<br>next &amp; &eacute;&nbsp;x<p>Second   para {0}</p>
<aside>see also</aside><div id="comments"><article>first!</article></div></article></div><div class="tagline">Always the same words</div><footer>&copy; us</footer>"""


def test_main_text():
    assert html_extract.main_text(PAGE.format(1)) == "Title 1 Bold1 next & é x Second para 1"
    assert html_extract.main_text("") == "" and html_extract.main_text("plain <b>text") == "plain text"
    assert html_extract.main_text("<p>a<p>b<ul><li>c<li>d</ul>e") == "a b c d e"
    assert html_extract.main_text("<div>x < y &lt;b&gt; &#233;</div><!-- no --><script>bad()") == "x < y <b> é"
    assert html_extract.main_text("<div " + "a" * 1000 + "<" * 50 + "<p>t") != None  # noqa: E711
    assert html_extract.main_text("<i>" * 3000 + "deep") == "deep"


@pytest.mark.parametrize("opened, closed", [
    ('<div class="layout no-sidebar"><article>', "</article></div>"), ('<div id="page" class="right-sidebar"><main>', "</main></div>"), ('<main class="comments-open">', "</main>"), ('<article class="widget">', "</article>"),
    ('<main><article class="widget">', "</article></main>"), ('<div class="layout no-sidebar">', "</div>"), ('<article><div class="no-sidebar">', "</div></article>"),
])
def test_names_do_not_remove_the_article(opened, closed):
    page = f"<body><nav>Home</nav>{opened}<h1>Title</h1><p>First words<div class='ad'>Buy</div><p>last words<div id='comments'><article class='comment'>first!</article></div>{closed}<footer>us</footer>"
    assert html_extract.main_text(page) == "Title First words last words"


@pytest.mark.parametrize("opened, closed", [('<main class="comments-open">', "</main>"), ('<div class="right-sidebar"><article>', "</article></div>"), ('<main><h1>Title</h1><article class="widget">', "</article></main>")])
def test_names_do_not_remove_the_article_beside_other_text(opened, closed):
    page = f"<body><div>Tagline</div>{opened}<p>Own words</p><div id='comments'>first!</div>{closed}"
    assert html_extract.main_text(page).removeprefix("Title ") == "Own words"


def test_names_without_any_mark_leave_the_least_noisy_text():
    assert html_extract.main_text("<div class='layout no-sidebar'><p>own words</p><div class='sidebar'>side</div></div><nav>Home</nav>") == "own words"
    assert html_extract.main_text("<p>own words</p><div class='sidebar'>side</div>") == "own words"


@pytest.mark.parametrize("tag", ['<svg class="icon" />', "<svg/>", "<math/>", '<SVG a="b"/>'])
def test_self_closed_svg_and_math_are_empty(tag):
    assert html_extract.main_text(f"<article><p>one {tag} two</p><p>three</p></article>") == "one two three"
    assert html_extract.main_text(f"<p>one</p>{tag}<p>two</p><svg><text>no</text></svg><p>three") == "one two three"
    assert html_extract.main_text("<p>one <svg href=a/>no</svg> two") == "one two"


def test_site_style_tree_removes_what_repeats(spark):
    site = "<html><body><div class='top'>Same on all pages</div><div class='main'><p>Own words of page {0}, and {0} more.</p></div></body></html>"
    rows = [(i, "http://s.example/x", site.format(i)) for i in range(30)] + [(100, None, None), (101, "http://t.example/", site.format(7)), (0, "http://s.example/x", site.format(0))]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 100:
            assert r.text == f"Own words of page {r.page_id}, and {r.page_id} more."
        assert r.n_chars == len(r.text)
    assert {r.page_id: r.text for r in got}[100] == "" and "Same on all" in {r.page_id: r.text for r in got}[101]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_tree(pages):
    """Per path of a host (from the root, as tags with their classes): share of exp(entropy) of contents and of presentations, and of different contents."""
    import math
    from collections import Counter
    from html.parser import HTMLParser

    seen = {}
    for html in set(pages):
        root = {"path": (), "text": [], "kids": []}
        stack, every = [root], []

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                name = tag + "".join(f".{v}" for k, v in attrs if k in ("class", "id"))
                node = {"path": (*stack[-1]["path"], name), "text": [], "kids": []}
                stack[-1]["kids"].append(name)
                every.append(node)
                stack.append(node)

            def handle_endtag(self, tag):
                stack.pop()

            def handle_data(self, data):
                if data.strip():
                    for n in stack:
                        n["text"].append(" ".join(data.split()))

        Reader().feed(html)
        own = {}
        for n in every:
            text, kids = own.setdefault(n["path"], ([], []))
            text.append(tuple(n["text"]))
            kids += n["kids"]
        for path, (text, kids) in own.items():
            seen.setdefault(path, []).append((tuple(text), tuple(kids)))
    out = {}
    for path, values in seen.items():
        texts, kids = [v[0] for v in values], [v[1] for v in values]
        h = lambda xs: -sum(n / len(xs) * math.log(n / len(xs)) for n in Counter(xs).values())
        out[path] = (len(values), len(set(texts)) / len(texts), math.exp(h(texts)) / len(texts), math.exp(h(kids)) / len(kids))
    return out


def site(seed, n):
    """Pages without any mark: menus, adverts and footers are one of five variants, articles are their own, and one of them is on a third of the pages."""
    r, pages = random.Random(seed), []
    words = lambda k: " ".join(f"w{r.randrange(900)}" for _ in range(k))
    pool, hot = [[words(4) for _ in range(5)] for _ in range(3)], words(30)
    for k in range(n):
        parts = [r.choice(x) for x in pool]
        own = hot if k % 3 == 0 else words(r.randint(5, 30))
        ads = "".join(f'<div class="b">{parts[1]}</div>' for _ in range(r.randint(1, 2)))
        pages.append((f'<html><body><div class="a"><ul><li>{parts[0]}</li></ul></div>{ads}<div class="t"><p>{own}</p><p>{words(3)}</p></div><div class="z">{parts[2]}</div></body></html>', own))
    return pages


def test_style_tree_equals_a_plain_one(spark):
    pages = [h for h, _ in site(1, 60)]
    rows = [(k, "http://S.example/x", h) for k, h in enumerate([*pages, pages[0]])]
    got = html_extract.importance(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {}
    for path, values in plain_tree(pages).items():
        at = 0
        for name in path:
            at = (at * 0x100000001B3 + html_extract._key(name)) & html_extract._MASK
        want[at] = values
    assert {r.path for r in got} == set(want) and {r.host for r in got} == {"s.example"}
    for r in got:
        n, variety, content, presentation = want[r.path]
        assert r.pages == n and abs(r.variety - variety) < 1e-9 and abs(r.content - content) < 1e-9 and abs(r.presentation - presentation) < 1e-9
        assert abs(r.importance - (max(content, presentation / 2) * n + 0.25) / (n + 0.25)) < 1e-9


def test_style_tree_finds_unmarked_articles(spark):
    """No tag and no name says what is what: menus, adverts and footers go by their entropy alone, articles stay, the one on a third of the pages too."""
    pages = site(2, 90)
    got = html_extract.extract(spark.createDataFrame([(k, "http://s.example/x", h, "x") for k, (h, _) in enumerate(pages)], "page_id long, url string, html string, text string")).collect()
    for r in got:
        assert r.text.startswith(pages[r.page_id][1]) and len(r.text.split()) == len(pages[r.page_id][1].split()) + 3 and r.by_tree >= 3


def test_style_tree_of_few_pages(spark):
    rows = [(k, "http://few.example/", f"<div class='m'>Same</div><div class='t'>{'one article' if k < 5 else k}</div><i>{k}</i>") for k in range(4)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text for r in got)


@pytest.mark.parametrize("make", [lambda n: "<i>" * n + "</x>" * n, lambda n: "<div>t" * n, lambda n: "<i>" * n + "<hr>" * n, lambda n: "<i><div>" * n + "</i>" * n, lambda n: "<svg>" * n + "</svg>" * n + "x", lambda n: "<a '" * n + '"<b "' * n])
def test_parsing_takes_time_in_proportion(make):
    import time

    def took(n):
        begun = time.perf_counter()
        html_extract.nodes(make(n))
        html_extract.main_text(make(n))
        return time.perf_counter() - begun

    took(500)
    assert took(40_000) < 30 * max(took(4000), 0.01)


def test_math_is_text_and_nested_svg_is_not():
    assert html_extract.main_text("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<svg><svg><text>a</text></svg><text>b</text></svg> here<template><template>t</template>u</template>.") == "so x=2 holds here."


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1000:1600] = x[0] + 0.01 * rng.normal(size=(600, 24)).astype(np.float32)  # one crowded place
    x[50] = x[51]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(20_000, None), (20_020, []), (20_040, [0.0] * 24), (20_060, [float("nan")] * 24), (20_080, [None, *[1.0] * 23]), (20_100, [1.0] * 5), (None, [1.0] * 24), (60, x[60].tolist())]
    got = ann.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    d = x.astype(float)
    assert set(by) == set(range(0, 3000, 20))
    hit = 0
    for q, own in by.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and all(r.vec_id != q for r in own)
        s = d @ d[q]
        assert np.allclose([r.score for r in own], [s[r.vec_id] for r in own])
        assert [(r.score, -r.vec_id) for r in own] == sorted(((r.score, -r.vec_id) for r in own), reverse=True)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & {r.vec_id for r in own})
    assert hit >= 0.9 * 20 * len(by)


def test_nearest_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(few, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert ann.search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_neighbours_outside_the_range_of_floats_and_clashing_names(spark):
    rows = [(0, [1e200, 0.0], 1, 2.0), (20, [1.0, 1.0], 1, 2.0), (3, [2.0, 0.0], 1, 2.0), (4, [-1e-60, 0.0], 1, 2.0), (5, [0.0, 3.0], 1, 2.0)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double"), F.col("vec_id") % 20 == 0).collect()
    want = {}
    for q, x, *_ in rows:
        if q % 20 == 0:
            near = sorted(((-float(np.dot(x, y)), i) for i, y, *_ in rows if i != q))
            want[q] = [(r, i, -s) for r, (s, i) in enumerate(near, 1)]
    assert {q: sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) for q in want} == want


def test_nearest_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 8)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = {tuple(r) for r in ann.search(table, F.col("vec_id") % 20 == 0).collect()}
    for name in ("INDEX_BLOCK", "QUERY_BLOCK", "CHUNK"):
        monkeypatch.setattr(ann, name, 7)
    parts = {tuple(r) for r in ann.search(table, F.col("vec_id") % 20 == 0).collect()}
    assert len(whole & parts) >= 0.95 * len(whole) and len(parts) == len(whole)


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    r = random.Random(4)
    vocab = [f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k % 6]}" for k in range(900)]
    clean = [" ".join(r.choices(vocab, k=90)) for _ in range(20)]
    near = clean[0].rsplit(" ", 1)[0] + " changed"
    secret = clean[1][:-1] + ' password = "hunter2hunter2"'
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*clean, clean[2], near, secret + " " + " ".join(r.choices(vocab, k=90)), "junk ### " * 60, None, ""])]
    spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert sorted(x.doc_id for x in kept.collect()) == sorted([*range(23), 5]) and kept.columns == docs.columns
    one = corpus_pipeline.near_duplicates(spark, kept, str(tmp_path))
    assert sorted(x.doc_id for x in one.collect()) == [*range(20), 22] and one.columns == docs.columns
    clear = corpus_pipeline.secret_scan(spark, one, str(tmp_path))
    texts = {x.doc_id: x for x in clear.collect()}
    assert "hunter2" not in texts[22].text and texts[22].n_chars == len(texts[22].text) and texts[3].text == clean[3]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == {*range(20), 22}


def test_pipeline_packs_more_than_one_group_of_text(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from tokenizers import Tokenizer

    r = random.Random(11)
    vocab = [f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k % 6]}" for k in range(900)]
    rows = [(i, " ".join(r.choices(vocab, k=r.randint(400, 2400))), "en", "s", 0) for i in range(200)]
    # one file, and so one partition in each stage that does not shuffle
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert len(texts) > 150 and sum(map(len, texts.values())) > 2 * 2**20
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    by_doc = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        own = want[x.doc_id]
        assert x.doc_tokens == len(own) and x.ids_crc32 == zlib.crc32(np.array(own[x.start : x.start + x.length], "<u4").tobytes())
        by_doc[x.doc_id] = by_doc.get(x.doc_id, 0) + x.length
    assert by_doc == {i: len(own) for i, own in want.items()}
