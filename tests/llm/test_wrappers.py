"""Operator 12: pages whose article is known, wrappers against the streams they were made from, plain extraction by hand."""

import html as entities
import random
import re
import time

import pytest

from glosa.llm import wrappers as w

SCHEMA = "page_id long, url string, html string, text string, host string, wrapper string"

MIXED = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href=/>Home</a></ul></nav></header>
<div class="cookie-notice">We use cookies.</div>
<main><article class="post"><header class="post-header"><h1>A &amp; B</h1><p>by Me</p></header>
<p>One   two<br>three&nbsp;four<!-- not this --></p><p class='notice'>Sign up!
<div class="ad-slot"><p>Buy</p></div>
<ul><li>x<li>y <b>z</b></ul><aside>See also</aside>
<table><tr><td>1<td>2</table>
<p>a &lt;b&gt; &#x41;&copy</p><script>document.write("<p>no</p>")</script>
<form><p>Mail <input></p></form><p hidden>secret</p><figure><figcaption>Cap</figcaption></figure>
<section id="comments"><article class="comment"><p>First!</p></article></section>
<footer>Tags</footer></article></main>
<div id="sidebar">Side</div><footer>&copy; Site</footer></body></html>"""
MIXED_TEXT = "A & B\n\nOne two three four\n\nx\n\ny z\n\n1\n\n2\n\na <b> A©\n\nCap"


def soup(title, paras, menu="Home"):
    """A page without any telling name."""
    return (f"<html><body><div class=x1><a href=/>{menu}</a> <a href=/n>News</a></div><div class=x2><div class=x3><h2>{title}</h2>"
            + "".join(f"<p>{p}</p>" for p in paras) + "</div></div><div class=x9>All rights reserved, printed in Utopia, since 1900 and ever after.</div></body></html>")


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h, "t", "h", "w") for i, (u, h) in enumerate(rows)], SCHEMA).repartition(3)
    out = w.extract_pages(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: r for r in out.collect()}
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == rows[i][0] for i, r in got.items())
    return [got[i]["text"] for i in range(len(rows))]


def test_article_without_the_rest():
    assert w.extracted(MIXED, None) == MIXED_TEXT


def test_odd_pages():
    for page, want in ((None, ""), ("", ""), ("plain  text", "plain text"), ("<article>", ""), ("<article><p>x", "x"), ("<p>a<p>b", "a\n\nb"), ("a < b <3 c", "a < b <3 c"),
                       ("<article><p>x<!-- open <p>y", "x"), ("<article>a<script>var s='</p>'", "a"), ("</p></article>x", "x"), ("<article><P CLASS=Ad>x</P><p>y</article><p>z", "y"),
                       ("<article><p title='a > b'>x</p><p title=\"c>y</p></article>", "x\n\ny"), ("<nav>m</nav>", ""), ("<article><b>bo</b>ld <i>it</i></article>", "bold it"),
                       ('<div data-class="ad"><p title="a hidden id=ad">x</p></div>', "x")):
        assert w.extracted(page, None) == want, page


def test_linear():
    begun = time.time()
    for page in ("<div>" * 60_000 + "x" + "</section>" * 60_000, "<a " * 300_000, "<a =\"'" * 100_000, "<p>" * 100_000 + "x", "<ul><li>" * 30_000 + "y", "<!--" * 200_000,
                 "<article>" + "<b><p>z " * 50_000, "<script>" * 100_000, "".join(f"<i{k}>" for k in range(40_000))):
        w.extracted(page, None)
    assert time.time() - begun < 60
    long = "<article>" + "".join(f"<p>{'word ' * 20}{i}</p>" for i in range(60_000)) + "</article>"
    assert w.extracted(long, None).count("\n\n") == 59_999


def test_without_telling_names(spark):
    rng = random.Random(5)
    said = [[" ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randint(5, 30))) + str(i) + "." for _ in range(rng.randint(2, 6))] for i in range(30)]
    rows = [(f"http://Soup.org/{i}", soup(f"Title {i}", p)) for i, p in enumerate(said)]
    rows.append(("http://alone.org/", soup("Alone", said[0])))
    got = texts(spark, rows)
    assert got == [f"Title {i}\n\n" + "\n\n".join(p) for i, p in enumerate(said)] + ["Alone\n\n" + "\n\n".join(said[0])]


def test_what_all_pages_share(spark):
    """A block inside the article that all pages of a host have is none of its prose; titles are, and copies of pages are kept whole."""
    def page(i, k):
        return f"<article><h1>Same</h1><div>Read this on our site today</div><p>{i}</p><blockquote>Body {i} of {k}.</blockquote></article>"

    rows = [(f"http://a.org/{i}", page(i, 1)) for i in range(10)] + [(f"http://b.org/{i}", page(1, 1)) for i in range(10)] + [(f"http://c.org/{i}", page(i, 1)) for i in range(3)]
    got = texts(spark, rows)
    assert got[:10] == [f"Same\n\n{i}\n\nBody {i} of 1." for i in range(10)]
    assert got[10:20] == ["Same\n\nRead this on our site today\n\n1\n\nBody 1 of 1."] * 10  # nothing varies: no evidence
    assert got[20:] == [f"Same\n\nRead this on our site today\n\n{i}\n\nBody {i} of 1." for i in range(3)]


def test_degenerate_rows(spark):
    rows = [(None, MIXED), ("no scheme", MIXED), ("http://x.org/", None), ("http://x.org/", ""), ("http://x.org/2", MIXED), ("http://x.org/2", MIXED), ("://", "<p>q")]
    assert texts(spark, rows) == [MIXED_TEXT, MIXED_TEXT, "", "", MIXED_TEXT, MIXED_TEXT, "q"]
    assert w.extract_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def matches(items, stream):
    """Whether a wrapper's items, as a regular expression, accept a stream of (key, text hash, kids)."""
    def pattern(its):
        out = ""
        for x in its:
            body = pattern(x[w.KIDS]) if x[w.KEY].startswith("(") else re.escape(x[w.KEY] + ("=" + x[w.TEXT] if x[w.TEXT] else "")) + ("" if x[w.KEY] != "#" or x[w.TEXT] else "=[0-9a-f]+") + (
                ";" if x[w.KEY] == "#" else "<" + pattern(x[w.KIDS]) + ">")
            out += f"(?:{body}){x[w.TIMES]}"
        return out

    return re.fullmatch(pattern(items), stream) is not None


def stream(e):
    out = ""
    for k in e.kids:
        if isinstance(k, str):
            if w.plain(k):
                out += f"#={w.text_hash(w.plain(k))};"
        else:
            out += f"{k.sig}<{stream(k)}>"
    return out


@pytest.mark.parametrize("seed", range(6))
def test_wrapper_accepts_its_pages(seed):
    """Regular pages with optional and repeated parts: the inferred expression accepts each page."""
    rng = random.Random(seed)

    def page():
        rows = "".join(f"<dt>{rng.choice('pqr')}</dt><dd>{rng.randint(0, 9)}</dd>" for _ in range(rng.randint(1, 4)))
        return ("<div class=h>Site</div>" + ("<div class=ad>Buy</div>" if rng.random() < 0.5 else "") + f"<h1>{rng.randint(0, 99)}</h1>"
                + "".join(f"<p>{rng.randint(0, 99)}" + ("<b>bold</b>" if rng.random() < 0.3 else "") + "</p>" for _ in range(rng.randint(0, 4)))
                + (f"<dl>{rows}</dl>" if rng.random() < 0.7 else "") + "<div class=f>End</div>")

    trees = [w.parsed(re.sub("class=ad", "class=x", page())) for _ in range(12)]
    made = w.page_wrapper(trees[0])
    for t in trees[1:]:
        made = w.aligned_item(made, w.page_wrapper(t))
    assert made[w.PAGES] == 12 and made[w.KIDS][0][w.KIDS][0][w.TEXT]  # "Site" is a constant
    assert all(matches(made[w.KIDS], stream(t)) for t in trees)


def test_given_pages_by_hand(spark):
    import duckdb

    pages = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    got = texts(spark, [(u, h) for _, u, h in pages])
    for (_, _, h), text in zip(pages, got):
        inner = h[h.index("<article>"): h.index("</article>")]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert text == "\n\n".join(filter(None, blocks))
