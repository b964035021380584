import time

import pytest

from burstline.llm.html_text import extract_text, main_text

STORY = "<p>The  first &amp; longest\nparagraph of the story, which goes on for a while so that it weighs more.</p>"
CASES = {
    "article": (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1>{STORY}<p>End.</p></article><footer>c</footer>",
                ["Title", 1, "End."]),
    "div": (f"<div class='header'>x</div><header>Site</header><div id=content><h1>Title</h1>{STORY}{STORY}<p>End.</p></div>"
            "<div class='sidebar-left'>Other news, other news, other news</div>", ["Title", 1, 1, "End."]),
    "unclosed": (f"<article><h1>T</h1><p><b>Short.<br>{STORY}<p>Last <i>word", ["T", "Short.", 1, "Last word"]),
    "noise inside": (f"<article>{STORY}<div class=ad>Buy now</div><form>Mail <input></form><aside>Also</aside>"
                     f"<section id=comments><p>I disagree.</p></section><p>Bye</p></article>", [1, "Bye"]),
    "main": (f"<html><head><title>t</title><script>var a='</p>'</script></head><body><main><header><h1>T</h1></header>{STORY}"
             "<ul><li>one</li><li>two</li></ul></main><div role=contentinfo>x</div>", ["T", 1, "one", "two"]),
    "body": (f"<body><ul><li><a href=a>Home</a><li><a href=b>About us</a></ul><h1>Title</h1>{STORY}<p>Short.</p></body>",
             ["Title", 1, "Short."]),
    "hidden": (f"<article>{STORY}<p style='display:none'>trap</p><p hidden>trap</p><p>&lt;b&gt; stays</p></article>", [1, "<b> stays"]),
}
FIRST = "The first & longest paragraph of the story, which goes on for a while so that it weighs more."


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    html, want = CASES[name]
    assert main_text(html).split("\n\n") == [FIRST if w == 1 else w for w in want]


def test_region_holds_all_content():
    a, b, c = ("alpha " * 40).strip(), ("beta " * 160).strip(), ("gamma " * 90).strip()
    pages = {
        f"<div id=content><h1>T</h1><p>{a}</p><blockquote>{b}</blockquote><p>{a}</p></div>": ["T", a, b, a],
        f"<div><section><h2>S</h2><p>{b}</p></section><section><p>{c}</p><p>Short.</p></section></div>": ["S", b, c, "Short."],
        f"<body><section><p>{b}</p></section><section><p>{c}</p><p><a href=x>The source</a></p></section></body>": [b, c, "The source"],
        f"<main><article><h2>A</h2><p>{b}</p></article><article><h2>B</h2><p>{c}</p></article></main>": ["A", b, "B", c],
        f"<div><article><p>{b}</p></article><article><p>{c}</p></article></div><div>Imprint</div>": [b, c],
        f"<div><div><p>{b}</p></div><div><div><p>{c}</p></div><p>{a}</p></div></div>": [b, c, a],
        f"<main><div>Home</div><article><p>{b}</p><p>{c}</p></article><div>More</div></main>": [b, c],
    }
    for html, want in pages.items():
        assert main_text(html).split("\n\n") == want


def test_names_alone_do_not_decide():
    rest = "<footer>Foot</footer><div class=ad>Buy now</div>"
    pages = {
        f"<body><div class='widget'><h1>T</h1>{STORY}{STORY}</div>{rest}</body>": ["T", 1, 1],
        f"<body><form id=aspnetForm><div class=menu><a href=x>Home</a></div><article><h1>T</h1>{STORY}</article>{rest}</form></body>": ["T", 1],
        f"<article>{STORY}<h2 id='Related_work'>Related work</h2><p>Older.</p><h2 id='Notices'>Notices</h2>{STORY}</article>":
            [1, "Related work", "Older.", "Notices", 1],
        f"<article>{STORY}<section id='social-impact'><p>Impact.</p></section><table class='share-prices'><tr><td>12<td>13</table></article>":
            [1, "Impact.", "12", "13"],
        f"<article>{STORY}<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>": [1, "Let x=1 be."],
        f"<article>{STORY}<div class='social-links'>Tell others</div><div class='related-posts'><p>Read on</p></div></article>": [1],
        f"<article>{STORY}{STORY}<h3>3 Comments</h3><div><p>I disagree with all of this, and so should you.</p></div></article>": [1, 1],
        f"<article><h2>Comments</h2>{STORY}</article>": ["Comments", 1],
        f"<body><nav class=comments><div class=sidebar><div class=ads><p>{'alpha ' * 60}</p></div></div></nav></body>": [("alpha " * 60).strip()],
    }
    for html, want in pages.items():
        assert main_text(html).split("\n\n") == [FIRST if w == 1 else w for w in want], html


def test_hostile_pages_take_little_time():
    n = 100_000
    pages = ["<div>x " * n + STORY, "<b>" * n + "<p>x" * 1000, "<a " * n, "<a " * n + ">", "<a href='" * n, "<!--" * n, "<![CDATA[" * n,
             "<?" * n, "</" * n, "<" * n, "&" * n, "&#" * n, "</x>" * n, "<p><i>" * n, "<div>" * n + "</p>" * n, "<ul><li>x" * n,
             "<div class=ad>x " * n, "<script>" * n, "<title>" * n, "<textarea>x" * n, "<a b=" * n + ">", "<table><tr><td>x" * n]
    for html in pages:
        start = time.process_time()
        main_text(html)
        assert time.process_time() - start < 20, html[:20]


def test_no_content_and_broken_markup():
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<script>x</script>") == ""
    for broken in ("<![", "<!DOCTYPE", "<![foo[ x", "<article><p>a</p", "</p></div>", "&#xFFFFFFFF; <p", "<a <b>c"):
        main_text(broken)
    assert main_text("just text") == "just text"


def test_text_behind_broken_declarations_stays():
    for broken in ("<![foo[ x ]]>", "<![1] x>", "<![if !IE]>", "<![CDATA[x]]>", "<![endif]-->", "<![>", "<! x>"):
        text = main_text(f"<article><p>one</p>{broken}<p>two</p>{STORY}</article>")
        assert text.split("\n\n")[0] == "one" and text.endswith("two\n\n" + FIRST)


def test_table(spark):
    html = CASES["article"][0]
    long = "<article>" + STORY * 3000 + "</article>"
    rows = [(1, "u", html, "x"), (1, "u", html, "x"), (None, None, None, None), (3, "v", "", "y"), (4, "w", long, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.n_chars, len(r.text)) for r in extract_text(pages).collect()}
    n = len("\n\n".join(["Title", FIRST, "End."]))
    assert got == {(1, n, n), (None, 0, 0), (3, 0, 0), (4, 3000 * (len(FIRST) + 2) - 2, 3000 * (len(FIRST) + 2) - 2)}
    assert extract_text(pages).count() == 5 and extract_text(pages.limit(0)).count() == 0
