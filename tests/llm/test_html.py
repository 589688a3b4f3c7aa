"""Main texts against literal pages, and templates against whole occurrence vectors."""

import html as entities
import re

import pytest

from flowlens.llm import html

HEAD = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Title {i}</title><style>p{{margin:0}}</style><script>var t="</p><p>no";</script></head><body>'


def page(i, body):
    return HEAD.format(i=i) + body + "</body></html>"


BLOG = (
    '<header><a href="/">Home of {w}</a></header><div class="wrap"><div class="cookie-notice">We bake {w} cookies</div><ul class="x1"><li><a href="/a">Link {w}</a><li><a href="/b">Other {v}</a></ul>'
    '<div class="x2"><div class="x3"><h2>Heading {w}</h2>Words of the text {v} &amp; more<br>of &lt;it&gt; with a <a href="/c">link</a> inside<p>Second {w}\n  part <b>bold</b>ly.</div>'
    '<div class="x4">Read on at our partners now</div></div><form><label>Mail {v}</label><input name=a></form><section id="comments"><p>First! {w}</section></div><footer>&copy; {w}</footer>'
)
NEWS = (
    "<nav><ul><li><a href=/x>{w}</a></ul></nav><main><article><h1>On {w}</h1><p>One {v}.<p>Released under the same licence.<aside>See {w}</aside><div class=share>Share {w}</div>"
    "<div>Filed under news</div></article></main><div class=ad>Buy {v}</div>"
)


def made(spark):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    rows, want = [], {}
    for i, w in enumerate(words):
        v = words[i - 3] + " " + str(i)
        rows.append((i, f"http://blog.example.com/{i}", page(i, BLOG.format(w=w, v=v)), "t"))
        want[i] = f"Heading {w} Words of the text {v} & more of <it> with a link inside Second {w} part boldly."
        rows.append((100 + i, f"https://news.example.com/{i}?q=1", page(i, NEWS.format(w=w, v=v)), "t"))
        want[100 + i] = f"On {w} One {v}. Released under the same licence."
    rows += [
        (200, "http://once.example.com/", "<p>Only <i>one</i> page<p class=ad>advert</p><!-- <p>not this --><p hidden>nor this</p>3 < 4 &gt; 2", "t"),
        (201, None, None, "t"), (202, "", "", "t"), (None, None, "<article>no id</article>", "t"), (203, "odd", "<div class='has-sidebar'><article>kept <div class=menu>no</div>whole", "t"),
        (204, "x", "<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl><pre>f\n g</pre><textarea><p>no</textarea><iframe>no</iframe>", "t"),
        (205, "x", "<p><b>Open title.<br><p>Next one.</article></span></p> end <i href='q>quote", "t"), (206, "x", "<title>no</title><p>a<div class=sidebar><article>b</article></div>", "t"),
        (0, "http://blog.example.com/0", rows[0][2], "t"), (207, "x", "<span class='ad'>no</span> yes <span>and</span> <em>so</em> on", "t"), (208, "y", "<nav><a>no", "t"),
    ]
    want |= {200: "Only one page 3 < 4 > 2", 201: "", 202: "", None: "no id", 203: "kept whole", 204: "a b c d e f g", 206: "b", 207: "yes and so on", 208: ""}
    return spark.createDataFrame(rows, "page_id long, url string, html string, template string"), want


def test_main_texts(spark):
    df, want = made(spark)
    got = html.main_texts(df.repartition(3)).collect()
    assert len(got) == df.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    for r in got:
        if r["page_id"] in want:
            assert r["text"] == want[r["page_id"]], r["page_id"]
    odd = next(r["text"] for r in got if r["page_id"] == 205)
    assert odd.startswith("Open title. Next one. end")


def test_templates_match_whole_vectors(spark):
    df, _ = made(spark)
    df = df.union(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("template", html.F.lit("t")))
    host = html.F.lower(html.F.regexp_extract(html.F.coalesce("url", html.F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*:/*([^/?#]*)", 1))
    pages = df.select("page_id", "url", html.F.xxhash64(host).alias("host"), html.whole_text("html").alias("html"))
    found = {r["host"]: {t["token"] & (2**64 - 1): t["linked"] for t in r["template"]} for r in html.templates(pages, html.materialise(html.equivalence_classes(pages))).collect()}
    by_host = {}
    for r in pages.collect():
        by_host.setdefault(r["host"], []).append(html.Page(r["html"]))
    want = {}
    for host, own in by_host.items():
        vectors = {}
        for i, p in enumerate(own):
            for t in p.tokens:
                vectors.setdefault(t, [0] * len(own))[i] += 1
        groups = {}
        for t, v in vectors.items():
            if sum(x > 0 for x in v) >= max(html.LEAST_PAGES, html.LEAST_SHARE * len(own)):
                groups.setdefault(tuple(v), set()).add(t)
        groups = {v: g for v, g in groups.items() if len(g) >= html.LEAST_TOKENS}
        classes = {t: n for n, g in enumerate(groups.values()) for t in g}
        spoilt, seen = set(), {}
        for p in own:
            for c, order, broken in html.orders(p.tokens, classes):
                if broken or seen.setdefault(c, order) != order:
                    spoilt.add(c)
        valid = {t for t, c in classes.items() if c not in spoilt}
        if valid:
            linked = {}
            for t in valid:
                sums = [(n, k) for p in own for e, _, n, k in p.runs if t in e.keys()]
                linked[t] = sum(k for _, k in sums) > html.LINKS * sum(n for n, _ in sums)
            want[host] = linked
    assert found == want and len(found) > 2


def test_orders():
    classes = {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    assert [(c, b) for c, _, b in html.orders([1, 9, 4, 5, 2, 4, 5, 3], classes)] == [(1, False), (1, False), (0, False)]
    assert {c for c, _, b in html.orders([1, 4, 2, 5, 3], classes) if b} == {1}
    assert len({o for c, o, _ in html.orders([1, 2, 3, 2, 1, 3], classes)}) == 2


def test_articles_of_the_table(spark):
    """The pages of the tables have one article each, whose blocks are all of its text."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.main_texts(df).collect()}
    for r in df.collect():
        article = re.search("<article>(.*?)(?:</article>|<footer|$)", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(entities.unescape(re.sub("<(/?p|br|/?h1)>", " ", re.sub("</?b>", "", article))).split())


def test_long_page(spark):
    text = "<p>" + "word " * 200_000 + "</p><div" + " a=1" * 3000 + " class=ad>no</div><b>" * 1 + "<i>" * 3000 + "deep"
    got = html.main_texts(spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string")).collect()[0]
    assert got["text"] == "word " * 200_000 + "deep"


def test_empty_table(spark):
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_are_read_once_for_a_host():
    """Rows of one host share what is made of its template."""
    tokens = [{"token": -1, "class": 5, "linked": True}, {"token": 7, "class": 5, "linked": False}]
    kind = html.pa.list_(html.pa.struct([("token", html.pa.int64()), ("class", html.pa.int64()), ("linked", html.pa.bool_())]))
    part = html.pa.RecordBatch.from_arrays([html.pa.array([1, 2, 1, 1]), html.pa.array([tokens, None, tokens, tokens], kind)], ["host", "template"])
    one, other, *rest = html.known_templates(part)
    assert rest == [one, one]
    assert (one.classes, one.sizes, one.linked) == ({2**64 - 1: 5, 7: 5}, {5: 2}, {2**64 - 1})
    assert (other.classes, other.sizes, other.linked) == ({}, {}, set())
