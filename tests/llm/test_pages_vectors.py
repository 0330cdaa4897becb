import base64
import hashlib

import numpy as np
import pytest

from pagetrace.llm import range_join as rj
from pagetrace.llm import warc, wrapper
from pagetrace.llm.common import new_dir

PAGE = """<html><head><title>x</title></head><body><div id="cookie-notice">We use cookies</div><header class="site-header"><h1>Site</h1></header><nav>a</nav>
<div class="{box}"><h2>Head</h2><p>One &amp; two<br>three <b>bold</b>text <a href=x>link</a></p><ul><li>i1<li>i2</ul><aside>side</aside><script>var a="<p>";</script>
<div class="ad-banner">buy</div><form>q <input></form><p>Last&nbsp; {n}</p></div><section id="comments"><p>c1</p></section><footer>f</footer></body></html>"""
TEXT = "Head\nOne & two three boldtext link\ni1\ni2\nLast {n}"


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, host string")
    return {r["page_id"]: r for r in wrapper.main_texts(df.repartition(3)).collect()}


def test_main_text_with_and_without_a_content_container(spark):
    rows = [(i, f"https://{box}.example/{i}", PAGE.format(box=box, n=i)) for i, box in enumerate(["content", "x1"] * 6)]
    got = texts(spark, rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {tuple(r) for r in wrapper.main_texts(df, most=0).collect()} == {tuple(r) for r in got.values()}
    assert all(r["text"] == TEXT.format(n=i) and r["n_chars"] == len(r["text"]) for i, r in got.items())


def test_names_of_containers(spark):
    page = "<body class='has-sidebar no-nav'><div class='page with-sidebar'><article class='post has-comments'><h1>T {n}</h1><p>A {n} <button>Buy</button></p></article><article class='comment'><p>c {n}</p></article></div><div class='site-footer'>f {n}</div></body>"
    got = texts(spark, [(i, "http://n.example/", page.format(n=i)) for i in range(4)])
    assert {r["text"] for r in got.values()} == {f"T {i}\nA {i}" for i in range(4)}


def test_copies_are_not_a_template(spark):
    got = texts(spark, [(i, "http://same.example/", "<body><div class=x><p>All alike</p></div></body>") for i in range(6)])
    assert {r["text"] for r in got.values()} == {"All alike"}


def test_template_text_outside_an_article_goes(spark):
    page = "<body><div class=top>Welcome to our site</div><div class=x><p>Story {n} goes on for a while and then for longer still</p><p>More {n}</p></div><div class=end>All rights kept</div></body>"
    got = texts(spark, [(i, "http://h.example/", page.format(n=i)) for i in range(5)])
    assert {r["text"] for r in got.values()} == {f"Story {i} goes on for a while and then for longer still\nMore {i}" for i in range(5)}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a", ""), (3, "http://a", "plain & text"), (None, "http://b", "<p>x"), (None, "http://b", "<p>x"), (4, "x", "<article><p>" + "long " * 60_000), (5, "http://c", "<article><p>a < b &lt;c&gt;<script>never closed <p>z")]
    got = texts(spark, rows)
    assert [got[k]["text"] for k in (1, 2, 3, None)] == ["", "", "plain & text", "x"]
    assert got[4]["n_chars"] == 5 * 60_000 - 1 and got[5]["text"] == "a < b <c>"
    assert wrapper.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def infer(*pages):
    first, *rest = (wrapper.parse(p)[0] for p in pages)
    for w in rest:
        first.align(w)
    return first


def test_wrapper_has_optional_and_repeated_groups_and_slots():
    pages = ["<ul><li>a</li><li>b</li></ul><p>x1</p>", "<ul><li>c</li></ul><h2>t</h2><p>x2</p>"]
    assert infer(*pages).expression() == "<ul>(<li>#</>)+</>(<h2>=</>)?<p>#</>"
    assert infer("<dl><dt>a<dd>b<dt>c<dd>d</dl>").expression() == "<dl>(<dt>=</><dd>=</>)+</>"
    assert infer("<p>a<ul><li>b</ul><p>c<h2>d</h2><p>e").expression() == "(<p>=</>(<ul><li>=</></>)?(<h2>=</>)?)+"
    assert infer("<h1>a</h1><h2>b</h2>", "<h2>b</h2><h1>c</h1>").expression() in ("(<h1>#</><h2>=</>)+", "(<h2>=</><h1>#</>)+")
    w = infer(*pages)
    assert wrapper.Wrapper.loads(w.dumps()).dumps() == w.dumps()


def test_order_of_alignment_does_not_matter_for_decisions():
    pages = [f"<div class=a>Same</div><div class=b><p>One {i}</p>" + "<ul><li>x</ul>" * (i % 2) + f"<p>Two {i}</p></div>" for i in range(6)]
    key = lambda w: sorted((r[1], *r[2:]) for r in wrapper.decisions(w))
    assert key(infer(*pages)) == key(infer(*pages[::-1])) == key(infer(*pages[:3]).align(infer(*pages[3:])))


def test_long_fixed_texts_and_short_posts(spark):
    legal = "All of this may be read by anyone who keeps to the rules of the house. " * 8
    page = "<body><div class=x1><p>Site of sites</p></div><div class=x2><p>Short {n}</p><p>Post {m}</p></div><div class=x3><p>" + legal + "</p></div></body>"
    got = texts(spark, [(i, "http://short.example/", page.format(n=i, m=i * i)) for i in range(8)])
    assert {r["text"] for r in got.values()} == {f"Short {i}\nPost {i * i}" for i in range(8)}
    inside = "<body><article><h1>T {n}</h1><p>Text {n} of the story, which is long enough to tell, as it says much about {n} and about other things, of which there are many {n}.</p><p>" + legal[:71] + "</p></article></body>"
    got = texts(spark, [(i, "http://inside.example/", inside.format(n=i)) for i in range(8)])
    assert all("T " in r["text"] and "story" in r["text"] and "rules of the house" not in r["text"] for r in got.values())


def test_more_kinds_of_children_than_two_dozen_keep_their_order(spark):
    page = "<body><div class=y>" + "".join(f"<div class=k{chr(97 + i)}><p>{{n}} part {i}</p></div>" for i in range(26)) + "</div></body>"
    got = texts(spark, [(i, "http://many.example/", page.format(n=i)) for i in range(4)])
    assert all(r["text"] == "\n".join(f"{i} part {k}" for k in range(26)) for i, r in got.items())


def test_menus_and_boxes_without_telling_names(spark):
    """No container, no class: slots, links and fixed texts tell the article."""
    page = "<body><div><ul>" + "".join(f"<li><a href=x>Link {{n}}{k}</a></li>" for k in range(5)) + "</ul></div><div><h1>Head {n}</h1><p>The story {n} is told here at some length, with a <a href=y>link</a> in it.</p><blockquote><p>Quote {n}</p></blockquote></div><table><tr><td>Imprint</td><td>Terms of use</td></tr></table></body>"
    page = page.replace("<div><h1>", "<section><h1>").replace("</blockquote></div>", "</blockquote></section>")
    got = texts(spark, [(i, "http://plain.example/", page.format(n=i)) for i in range(6)])
    assert all(r["text"] == f"Head {i}\nThe story {i} is told here at some length, with a link in it.\nQuote {i}" for i, r in got.items())


def test_content_with_names_of_boxes_stays_within_an_article(spark):
    page = "<article><header><h1>On {n}</h1></header><p>Some text {n} <math><mi>x</mi></math> more</p><section class='related-work'><p>Others wrote about {n} at length</p></section><div class=related><ul><li><a href=a>See {n}</a></li><li><a href=b>And {n}</a></li></ul></div><noscript>Told {n} without scripts</noscript></article>"
    got = texts(spark, [(i, "http://names.example/", page.format(n=i)) for i in range(5)])
    assert all(r["text"] == f"On {i}\nSome text {i} x more\nOthers wrote about {i} at length\nTold {i} without scripts" for i, r in got.items())


REFERENCES = """<body><nav><ul><li><a href=/>Home</a></li></ul></nav>{open}<h1>On {n}</h1><p>The text about {n} is told at length here, with {m} and more.</p><h2>Summary</h2><p>In short, {n} it is.</p>
<div class="hidden-gems"><p>A gem of {n}</p></div><div class="notice-board"><p>Pinned on {n}</p></div><table><tr><th>Name</th><th>Value</th></tr><tr><td><a href=a>Row {n}</a></td><td><a href=b>Cell {m}</a></td></tr></table>
<h2>References</h2><ul><li><a href=c>Source {n}</a></li><li><a href=d>Source {m}</a></li></ul>{last}{close}<div class="site-footer">{n}</div><div class="left-sidebar-box"><p>Side {n}</p></div></body>"""


@pytest.mark.parametrize("tag, last", [("article", ""), ("main", ""), ("div", "<p>The end of {n}</p>")])
def test_shared_headings_lists_of_links_and_names_with_a_telling_word_stay(spark, tag, last):
    page = REFERENCES.replace("{last}", last).replace("{open}", f"<{tag}>").replace("{close}", f"</{tag}>")
    got = texts(spark, [(i, "http://refs.example/", page.format(n=f"n{i}", m=f"m{i * i}")) for i in range(8)])
    for i, r in got.items():
        n, m = f"n{i}", f"m{i * i}"
        want = [f"On {n}", f"The text about {n} is told at length here, with {m} and more.", "Summary", f"In short, {n} it is.", f"A gem of {n}", f"Pinned on {n}", "Name", "Value", f"Row {n}", f"Cell {m}", "References", f"Source {n}", f"Source {m}"]
        assert r["text"] == "\n".join(want + [f"The end of {n}"] * bool(last))


def test_links_of_the_host_within_an_article_go(spark):
    page = "<body><article><h1>On {n}</h1><p>Text about {n}, long enough to count</p><ul>" + "".join(f"<li><a href=x>Topic {k}</a></li>" for k in range(6)) + "</ul><p>More about {n}</p><p>Share this with all</p></article></body>"
    got = texts(spark, [(i, "http://topics.example/", page.format(n=i)) for i in range(8)])
    assert all(r["text"] == f"On {i}\nText about {i}, long enough to count\nMore about {i}" for i, r in got.items())


def word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_names_of_one_page_are_folded(spark):
    page = "<body><div class=top><p>Site of sites</p></div><div class=u{a}><div class=v{a}><h1>Head {n}</h1><p>The story {n} goes on</p></div></div><div class='ad w{a}'><p>Buy {n}</p></div><div class=end>All rights kept</div></body>"
    pages = [page.format(a=word(i), n=i) for i in range(1500)]
    held = list(wrapper._folding(iter([wrapper.pa.record_batch([wrapper.pa.array(["h"] * 1500), wrapper.pa.array(pages)], ["host", "source"])]), True))
    w = wrapper.Wrapper.loads(held[0].column(1)[0].as_py())
    assert len(w.key) < 2500 and len(w.lean().key) < 250 and w.n[0] == 1500
    got = texts(spark, [(i, "http://unique.example/", p) for i, p in enumerate(pages)])
    assert all(r["text"] == f"Head {i}\nThe story {i} goes on" for i, r in got.items())


def test_a_small_box_named_content_does_not_win(spark):
    page = "<body><div class=content><p>Tip {n}</p></div><div class=z><p>The story of {n} goes on for much longer than the tip above, {n}.</p><p>And on, {n}</p></div></body>"
    got = texts(spark, [(i, "http://tip.example/", page.format(n=i)) for i in range(5)])
    assert all(r["text"].startswith("The story") and "Tip" not in r["text"] for r in got.values())


def test_deep_and_broken_pages_take_linear_time(spark):
    import time

    began = time.time()
    deep = "<div>" * 5000 + "<p>deep</p>" + "</div>" * 2500 + "</span></div>" * 5000
    quotes = '<a href="x> ' * 80_000 + "<p>after</p>"
    stray = "<p title='" + "</b>" * 100_000 + "<<<" * 50_000
    got = texts(spark, [(1, "http://d.example", deep), (2, "http://d.example", deep), (3, "http://q.example", quotes), (4, "http://s.example", stray), (5, "http://t.example", "<ul>" + "<li>x<div>" * 3000)])
    assert got[1]["text"] == "deep" and got[5]["text"] == "\n".join("x" * 3000)
    assert time.time() - began < 30


def test_sf_pages_equal_their_articles(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrapper.main_texts(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert got[r["page_id"]] == "\n".join(filter(None, parts))


def test_warc_round_trip(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    odd = [(9991, None, None), (9992, "u\r\nv", ""), (9993, "x", "é"), (9993, "x", "é"), (9980, "x", "é"), (None, "n", "null id"), (9994, "big", "ab" * 500_000)]
    pages = some.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).repartition(3)
    path = new_dir(spark, "test-warc")
    index = warc.write(pages, path)
    got = warc.read(index, path, payloads=True).collect()
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    key = lambda p, b: (p is not None, p or 0, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
    assert sorted(key(p, b) for p, b in rows) == sorted((r["page_id"] is not None, r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["payload_digest"], []).append(r)
    for own in by.values():
        first = [r for r in own if r["record_type"] == "response"]
        assert len(first) == 1 and first[0]["page_id"] == max((r["page_id"] for r in own if r["page_id"] is not None), default=None)
        assert all(r["refers_to"] == first[0]["page_id"] and r["payload"] is None for r in own if r["record_type"] == "revisit")
        assert hashlib.sha1(first[0]["payload"]).digest() == base64.b32decode(first[0]["payload_digest"])
    members = []
    for r in index.collect():
        with open(f"{path.removeprefix('file://')}/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            members.append(warc.parse(f.read(r["length"]))["fields"]["WARC-Record-ID"])
    assert len(members) == len(set(members)) == len(rows)
    few = warc.read(index.where("page_id % 10 = 3"), path)
    assert {r["page_id"] for r in few.collect()} == {p for p, _ in rows if p is not None and p % 10 == 3}
    assert warc.ranges(index.where("page_id < 5"), gap=0).count() >= 1
    none = new_dir(spark, "test-none")
    assert warc.read(warc.write(pages.limit(0), none), none).count() == 0


def test_damaged_record_is_told():
    member = warc.record(1, "u", b"abc", "WRONG", None, False, None, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse(member)


def brute(rows):
    out = {}
    for label, size in {(r[2], len(r[1] or [])) for r in rows if r[2] is not None}:
        good = [(v, np.array(e, float)) for v, e, l in rows if l == label and e and all(x is not None and np.isfinite(x) for x in e) and any(e) and len(e) == size]
        if not good:
            continue
        x = np.array([e / np.linalg.norm(e) for _, e in good])
        near = x @ x.T >= 0.98
        np.fill_diagonal(near, False)
        at = np.arange(len(good))
        for _ in range(len(good)):
            at = np.minimum(at, np.where(near, at[None, :], len(good)).min(1))
        for i, (v, _) in enumerate(good):
            out[v] = (int(near[i].sum()), min(w for (w, _), c in zip(good, at) if c == at[i]))
    return out


@pytest.mark.parametrize("cell, block", [(4096, 1024), (20, 16)])
def test_range_join_equals_brute_force(spark, cell, block, monkeypatch):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + draw.normal(size=8) * (0.02 + 0.25 * (i % 5))).astype(np.float32).tolist(), i % 2) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)] + [(2000 + i, (base[0] + draw.normal(size=8) * 0.01).astype(np.float32).tolist(), 0) for i in range(60)]
    rows += [(-1, None, 1), (-2, [0.0] * 8, 1), (-3, [float("nan")] * 8, 1), (-4, [1.0] * 3, 1), (-5, [1.0] * 8, None), (-6, [None] + [1.0] * 7, 1), (-7, [float("inf")] * 8, 0)]
    rows += [(3000 + i, [1.0, 2.0, 3.0 + i % 3 * 0.1], 1) for i in range(9)] + [(3100 + i, [5.0, float(i)], 0) for i in range(5)]  # rarer lengths
    inner = rj.links
    monkeypatch.setattr(rj, "links", lambda v, c: inner(v, c, cell=cell, block=block))
    df = spark.createDataFrame([(v, e, l, 1) for v, e, l in rows], "vec_id long, embedding array<float>, label int, copies int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rj.near_vectors(df.repartition(3)).collect()}
    want = {v: (0, v) for v, *_ in rows} | brute(rows)
    assert len(got) == len(rows) and {v: x[:2] for v, x in got.items()} == want
    assert all(k == (v == c) for v, (_, c, k) in got.items())


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert rj.near_vectors(df).count() == 0
    assert rj.near_vectors(spark.createDataFrame([(1, None, None), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count() == 2


def test_pivots_replicate_whatever_is_near():
    draw = np.random.default_rng(2)
    x = rj.unit(draw.normal(size=(400, 4)))
    radius = float(np.sqrt(2 - 2 * 0.98))
    pivots = rj.choose_pivots({0: x}, {0: 400}, radius, 10)[0]
    d = rj._distance(x, pivots)
    own = d.argmin(1)
    near = x @ x.T >= 0.98
    for i, j in zip(*np.nonzero(near)):
        low, high = (i, j) if own[i] <= own[j] else (j, i)
        assert d[high, own[low]] <= d[high, own[high]] + 2 * radius + rj.SLACK
