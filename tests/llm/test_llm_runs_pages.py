"""Periodic runs, Yinyang clusters and main text: brute force, SQL over odd tables, and pages of many shapes."""

import hashlib
import random
import re
import sys
import zlib
from os.path import dirname

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, dirname(dirname(__file__)))
from compare import rows  # noqa: E402

from tillage.llm import maintext, periodic, yinyang  # noqa: E402


def plain_runs(words, min_length=24, min_exponent=3):
    """Runs by their definition: every lag, place by place."""
    n, found = len(words), {}
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(min_length, min_exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def made_text(rng):
    kinds = rng.choice([1, 2, 3, 30])
    words = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(200))]
    for _ in range(rng.randrange(3)):
        if len(words) > 30:
            a, p = rng.randrange(len(words)), rng.randrange(1, 40)
            for i in range(a, min(len(words), a + rng.randrange(20, 150))):
                words[i] = words[a + (i - a) % p]
    return rng.choice([" ", "\n", " \t", "\x0b"]).join(words)


def test_periodic_runs_are_those_of_the_definition(spark):
    rng = random.Random(3)
    table = [(i, made_text(rng)) for i in range(250)]
    table += [(None, "a b " * 30), (None, None), (900, ""), (901, None), (902, " \n "), (903, "x y " * 40), (904, "É é " * 20), (905, "one " * 5000)] + table[:3]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in table], "doc_id long, text string, runs string, collapsed int")
    got = [tuple(r) for r in periodic.run_scan(docs).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(*r) for r in table), key=repr)
    assert periodic.run_scan(docs.limit(0)).count() == 0


def test_long_texts_are_dealt_by_ranges_of_lags(spark):
    rng = random.Random(4)
    texts = [" ".join(f"v{rng.randrange(4)}" for _ in range(400)) for _ in range(6)]
    texts += [" ".join(" ".join(f"u{i}" for i in range(q)) for _ in range(4)) for q in (70, 150, 260)] + ["same " * 900, "short text", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:7])], "doc_id long, text string")
    whole = {tuple(map(str, r)) for r in periodic.find_runs(docs).collect()}
    assert whole == {tuple(map(str, r)) for r in periodic.find_runs(docs, part_chars=500).collect()}
    for r in periodic.find_runs(docs, part_chars=500).collect():
        assert [tuple(x) for x in r.runs] == plain_runs((texts + texts[:7])[r.doc_id].split() if (texts + texts[:7])[r.doc_id] else [])


def test_periodic_scan_of_a_uniform_text_is_not_quadratic():
    assert periodic.runs_of(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]
    ids = np.tile(np.arange(1000, dtype=np.int32), 300)
    assert periodic.runs_of(ids) == [(0, 300_000, 1000)]


def clusters_by_sql(frame):
    con = duckdb.connect()
    con.register("embeddings", frame)
    return con.sql(yinyang.SQL).df()


def test_clusters_with_odd_rows(spark):
    rng = np.random.default_rng(2)
    table = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(160)]
    table += [(i, [float(v) for v in rng.integers(-1, 2, 64)]) for i in range(160, 260)]  # many ties
    table += table[:4] + [(400 + i, table[7][1]) for i in range(5)] + [(None, table[9][1])]
    table += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 63 + [None]), (504, [float("nan")] + [0.0] * 63), (505, [float("inf")] * 64), (506, [0.0] * 64)]
    df = spark.createDataFrame([(*r, 5) for r in table], "vec_id long, embedding array<float>, cluster int")
    want = clusters_by_sql(pa.table({"vec_id": pa.array([r[0] for r in table], pa.int64()), "embedding": pa.array([r[1] for r in table], pa.list_(pa.float32()))}))
    got = yinyang.yinyang_clusters(df).toPandas()
    assert len(got) == 160 + 100 + 4 + 5 + 1 + 1 and rows(got) == rows(want)
    few = yinyang.yinyang_clusters(df.filter("vec_id < 3")).toPandas()
    assert len(few) == 6 and few.cluster.nunique() == 3 and set(few.distance) == {0}  # each of the three comes twice
    assert yinyang.yinyang_clusters(df.limit(0)).count() == 0 and yinyang.yinyang_clusters(df.filter("vec_id is null")).count() == 0
    with pytest.raises(Exception, match="must not exceed"):
        yinyang.yinyang_clusters(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


def test_bounds_save_distances_and_change_nothing():
    """On clustered vectors most distances are never measured, and each round equals a full scan."""
    rng = np.random.default_rng(5)
    middle = rng.integers(-200, 200, (40, 64))
    x = (middle[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 64))).astype(np.int32)
    c = x[:40].astype(np.int64)
    groups = yinyang.group_centroids(c)
    state, measured = yinyang.first_bounds(x, c, groups), 0
    for _ in range(6):
        sums = np.stack([x[state[0] == k].sum(0) // max(1, (state[0] == k).sum()) if (state[0] == k).any() else c[k] for k in range(40)])
        *state, n = yinyang.next_bounds(x, *state, c, sums, groups)
        measured, c = measured + n, sums
        full = yinyang.squared(x, c)
        assert (full.argmin(1) == state[0]).all()
        rest = np.sqrt(np.where(np.arange(40) == state[0][:, None], np.iinfo(np.int64).max, full))
        assert all((state[2][:, g] <= rest[:, groups == g].min(1) + 1e-9).all() for g in range(groups.max() + 1))
    assert measured < 6 * x.shape[0] * 40 * 0.35
    big = np.array([[1 << 26] * 64, [-(1 << 26)] * 64])
    assert yinyang.squared(big, big)[0, 1] == 64 * (1 << 27) ** 2


def read(page):
    return maintext._Page(page, "http://a.example/").kept


def article(page):
    return "\n\n".join(t if t is not None else " ".join(w) for t, w, _ in read(page))


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>T &amp; U</h1><p>One\n <b>t</b>wo<br>three<p>four</article>", "T & U\n\nOne two three\n\nfour"),
        ("<nav><a>menu</a></nav><main><h1>T</h1><p>x</p><aside>side</aside></main><footer>f</footer>", "T\n\nx"),
        ("<body class='has-sidebar'><div id=\"sidebar\">s</div><div class='post-content'><p>x</p><div class=\"ad\">buy</div><form>f</form></div></body>", "x"),
        ("<article><header><h1>T</h1></header><p>x</p><div class='comments'><article class='comment'><p>nice</p></article></div><footer>by me</footer></article>", "T\n\nx"),
        ("<header><form><article>x</article>", "x"),
        ("<div class=ad>a<article>x<p class=\"notice\">n</p>y</article></div>", "x\n\ny"),
        ("<article><script>var a='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>a &lt; b &#233; &nbsp; c</p><p hidden>no</p></article>", "a < b é c"),
        ("<article><p>unclosed <b>bold<p>next<ul><li>one<li>two</ul>tail", "unclosed bold\n\nnext\n\none\n\ntwo\n\ntail"),
        ("<article><p title='a > b'>x</p><p title='odd>y</p></article>", "x\n\ny"),
        ("a < b and 3 <4 <p>c</p> &am &amp", "a < b and 3 <4\n\nc\n\n&am &"),
        ("<title>t</title><noscript>n</noscript><template><p>t</p></template><p>x</p><script>never closed", "x"),
        ("<article><p>said<span class='ad'>buy</span> he</p></article>", "said he"),
        ("<div class='content-sidebar-wrap'><div id=sidebar-left><p>s</p></div><article class='post has-sidebar comments-open'><p>x</p></article></div>", "x"),
        ("<article><p>x</p><div class='article-sidebar'>s</div><p class='post-share'>s</p><div class='entry-content no-ads'><p>y</p></div><p class='downloads'>z</p></article>", "x\n\ny\n\nz"),
        ("<div role=main class=page-body><p>x</p><ul class='main-menu'><li>m</ul><div class='sideBar'>s</div><div id=comments><p>c</p></div></div><p>out</p>", "x"),
        ("<div class='ad-container'>kept, as it may frame the page</div><div class=nav-top>gone</div><section id=reader-comments>c</section>", "kept, as it may frame the page"),
        ("", ""),
        (None, ""),
        ("<p></p>", ""),
    ],
)
def test_shapes_of_pages(page, want):
    assert article(page) == want


def test_a_page_of_open_tags_is_linear():
    assert article("<article>" + "<b>" * 100_000 + "x" + "</i>" * 100_000 + "</b>" * 100_000) == "x"
    assert article("<article><p>" + "<a title='" * 20_000) == ""


def plain_covered(streams, window, least):
    """Covered places of each stream by comparing all windows of a host."""
    held = {}
    for key, s in enumerate(streams):
        for i in range(len(s) - window + 1):
            held.setdefault(tuple(s[i : i + window]), set()).add(tuple(s))
    out = []
    for s in streams:
        cover = [False] * len(s)
        for i in range(len(s) - window + 1):
            if len(held[tuple(s[i : i + window])]) >= least:
                cover[i : i + window] = [True] * window
        out.append(cover)
    return out


def test_what_the_markup_leaves_open_is_told_by_repetition(spark):
    """Pages of plain divs: passages of three different pages of a host go, unique runs stay, as a comparison of all windows says."""
    rng = random.Random(9)
    notice = "we use small files on your device to make this site work well for you every single day"
    pages = []
    for i in range(60):
        own = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 40))) for _ in range(3)]
        where = rng.choice(["a.example", "b.example", "A.example:80"])
        blocks = [own[0], notice, own[1], f"{notice} {own[2]}"] if i % 3 else [own[0], own[1]]
        pages.append((i, f"http://{where}/{i}", "".join(f"<div>{b}</div>" for b in blocks)))
    pages += [(None, None, pages[0][2]), (70, "http://a.example/x", None), (71, pages[1][1], pages[1][2])]
    got = {(r.page_id, r.url): r.text for r in maintext.main_text(spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string")).collect()}
    by_host: dict[str, list] = {}
    for p in pages:
        by_host.setdefault(maintext.host_of(p[1]), []).append(p)
    for group in by_host.values():
        streams = [maintext._Page(p[2], p[1]).stream for p in group]
        for p, s, cover in zip(group, streams, plain_covered(streams, maintext.WINDOW, maintext.MIN_PAGES)):
            blocks, now = [], []
            for w, c in [*zip(s, cover), (None, False)]:
                if w is None:
                    blocks.append(" ".join(now))
                    now = []
                elif not c:
                    now.append(w)
            assert got[p[0], p[1]] == "\n\n".join(b for b in blocks if b)
    assert not any("small files" in t for (i, _), t in got.items() if i is not None and i % 3 and i < 60 and len(by_host[maintext.host_of(pages[i][1])]) > 3)
    assert maintext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_an_article_stays_whole_however_often_it_repeats(spark):
    body = " ".join(f"word{i}" for i in range(80))
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", f"<nav>m{i}</nav><article><p>{body}</p><p>{i}</p></article>") for i in range(8)], "page_id long, url string, html string")
    assert [r.text for r in maintext.main_text(pages).orderBy("page_id").collect()] == [f"{body}\n\n{i}" for i in range(8)]
    r = maintext.main_text(pages.withColumn("html", F.lit("<article>\U0001f600 é</article>"))).first()
    assert (r.n_chars, r.n_outside) == (3, 0)


def test_what_stands_beside_articles_tells_of_pages_without_one(spark):
    """Pages with an article lose nothing by the array, but what they repeat outside it goes from a page of the host that has none."""
    notice = "we use small files on your device to make this site work well"
    pages = [(i, f"http://h.example/{i}", f"<div>{notice}</div><article><p>story {i}</p></article>") for i in range(3)]
    pages += [(3, "http://h.example/3", f"<div>{notice}</div><div>plain story</div>"), (4, "http://other.example/4", f"<div>{notice}</div><div>plain story</div>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    kept = f"{notice}\n\nplain story"
    assert [r.text for r in maintext.main_text(table).orderBy("page_id").collect()] == ["story 0", "story 1", "story 2", "plain story", kept]
    assert [r.text for r in maintext.main_text(table, min_pages=9).orderBy("page_id").collect()] == ["story 0", "story 1", "story 2", kept, kept]


def test_pages_of_the_table_by_sql(spark):
    from compare import tables

    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert rows(maintext.main_text(spark.read.parquet(f"{d}/pages.parquet")).toPandas()) == rows(tables(d).sql(maintext.SQL).df())
