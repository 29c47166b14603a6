"""Main text of pages: the given template, and made pages of other kinds."""

import html
import re
import time

import pytest
from conftest import SF

from ledgerlark.llm import pages, queries

RUN = "This is a paragraph of running text that goes on for a while, so that it looks like an article does."
MADE = {
    "div soup": (f'<html><head><title>T</title></head><body class="has-sidebar"><div id="header"><h1>Site</h1><a href=/>Home</a></div><div class="menu"><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></div>'
                 f'<div class="wrap"><div id="content"><h1>Title &amp; more</h1><p>{RUN}<p>Short.<p>{RUN} {RUN}<ul><li>one<li>two {RUN}</ul><blockquote>{RUN}</blockquote><p>End.</div><div class="sidebar"><p>{RUN}{RUN}</p></div></div>'
                 f'<div id="cookie-notice">We use cookies {RUN}</div><div class="comments"><h3>Comments</h3><p>{RUN * 5}</p></div><div id="footer">Copyright</div></body></html>',
                 ["Title & more", RUN, "Short.", f"{RUN} {RUN}", "one", f"two {RUN}", RUN, "End."]),
    "no names": (f"<body><div><a>Home</a> | <a>News</a> | <a>About</a></div><div><h1>Head</h1><p>{RUN}</p><p>x</p><p>{RUN}</p></div><div>Copyright 2020</div></body>", ["Head", RUN, "x", RUN]),
    "parts of an article": (f'<body><header><h1>Site</h1></header><main><article><header><h1>Head</h1><p>By A</p></header><p>{RUN}</p><aside>{RUN}</aside><div class="advert">Buy</div><figure><img><figcaption>Cap</figcaption></figure>'
                            f'<p>Tiny</p><form><input><label>Mail</label></form><footer>tags</footer></article><section id="comments"><article class="comment"><p>{RUN * 9}</p></article></section></main><footer>{RUN}</footer>',
                            ["Head", "By A", RUN, "Cap", "Tiny"]),
    "a form round the page": (f'<body><form id="aspnetForm"><div id="nav"><a>x</a></div><div id="main"><h1>Head</h1><p>{RUN}</p><p>{RUN}</p></div></form></body>', ["Head", RUN, RUN]),
    "flat": (f"<body><h1>Head</h1><p>{RUN}<p>b<p>{RUN}<hr><p>{RUN}</body>", ["Head", RUN, "b", RUN, RUN]),
    "table layout": (f"<body><table><tr><td><a>a</a><br><a>b</a><br><a>c</a></td><td><h2>Head</h2><p>{RUN}</p><p>c</p><p>{RUN}</p></td></tr></table></body>", ["Head", RUN, "c", RUN]),
    "sections": (f'<body><nav>x</nav><div class=post><h1>Head</h1><section><h2>A</h2><p>{RUN}</p></section><section><h2>B</h2><p>{RUN} {RUN}</p><p>d</p></section></div><div class="related-posts"><article><p>{RUN * 3}</p></article></div></body>',
                 ["Head", "A", RUN, "B", f"{RUN} {RUN}", "d"]),
    "empty": ("", []), "null": (None, []), "menu only": ("<body><nav><ul><li><a>x</a></ul></nav><footer>c</footer></body>", []),
    "no markup": ("Just words &lt;here&gt; &#8217;ok&#x27;", ["Just words <here> ’ok'"]),
    "white space": (f"<article><p>one<br>two\n  three&nbsp;four<p>{RUN}</article>", ["one two three four", RUN]),
    "article in a sidebar": (f"<body><article><h1>H</h1><p>{RUN}</p></article><aside><article><p>{RUN * 9}</p></article></aside></body>", ["H", RUN]),
    "cut short": (f'<body><article><h1>H</h1><p>{RUN}</p><p>more <a href="x', ["H", RUN, "more"]),
    "comments below a heading": (f'<article><h1>H</h1><p>{RUN}</p><div class="ad">ad text</div><h2>3 Comments</h2><ol><li>{RUN}</li></ol></article>', ["H", RUN]),
    "short": ("<article><h1>H</h1><p>Tiny one.</p></article>", ["H", "Tiny one."]),
    "wrapper named like a frame": (f'<div class="page-with-sidebar content-header-wrap"><article><h1>H</h1><p>{RUN}</p></article></div>', ["H", RUN]),
    "hidden and scripts": (f'<article><script>if (a<b) "</p>"</script><style>p{{}}</style><noscript>{RUN}</noscript><p hidden>{RUN}</p><p style="display: none">x</p><p>{RUN}<!-- {RUN} --></p></article>', [RUN]),
}


@pytest.mark.parametrize("case", MADE)
def test_made_pages(case):
    page, want = MADE[case]
    assert [x for x in pages.extract(page).split("\n") if x] == want


def test_template(shipped):
    """Article blocks cut out by hand, for every page; a repeated query gives the same rows."""
    rows = {r["page_id"]: r for r in shipped.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op12_pages(shipped, SF).collect()
    assert sorted(r["page_id"] for r in got) == sorted(rows)
    for r in got:
        article = rows[r["page_id"]]["html"].split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]]["url"]


@pytest.mark.parametrize("page", ["<" * 200_000, "<a " * 200_000, "<a " * 200_000 + ">", "<!-- " * 200_000 + ">", "<div>" * 30_000 + "x" + "</div>" * 30_000, "<div>" * 10_000 + "</span>" * 100_000, "&" * 500_000,
                                  "<p>" * 50_000 + RUN, "<ul><li>x" * 20_000, "</p>" * 100_000, "<div><p>a" * 20_000, "<table><tr><td>x" * 20_000, "<script>" + "a<b " * 100_000])
def test_hostile_pages_take_linear_time(page):
    start = time.process_time()
    pages.extract(page)
    assert time.process_time() - start < 20


def test_long_paragraph_is_whole():
    words = " ".join(f"w{i}" for i in range(200_000))
    assert pages.extract(f"<article><p>{words}</p></article>") == words


def test_odd_rows(shipped):
    rows = [(1, "u", MADE["flat"][0], 9), (1, "u", MADE["flat"][0], 9), (None, None, None, None), (2, None, "", 1), (3, "v", "  \n ", 1)]
    df = shipped.createDataFrame(rows, "page_id long, url string, html string, n_chars int").selectExpr("*", "1 AS text")
    got = {(r["page_id"], r["url"], r["text"][:4], r["n_chars"]) for r in pages.main_text(df).collect()}
    assert got == {(1, "u", "Head", len("\n".join(MADE["flat"][1]))), (None, None, "", 0), (2, None, "", 0), (3, "v", "", 0)} and pages.main_text(df).count() == 5
    assert pages.main_text(df.limit(0)).collect() == []
