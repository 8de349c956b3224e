"""Main texts of pages: layouts with and without landmarks, broken markup, awkward rows, and all pages of a table."""

import html as entities
import re
import time

import pytest

from terrane.llm import html, registry

from .fixtures import SF

TITLE = "A walk in the hills"
LONG = [f"Sentence {i} of the article, with a comma, goes on for a while, as articles do, and then it ends. It begins again." for i in range(6)]
BODY = [TITLE, LONG[0], LONG[1], "Then.", LONG[2], "First item, short", "Second item", LONG[3]]
ARTICLE = f"<h1>{TITLE}</h1><p>{LONG[0]}</p><p>{LONG[1]}</p><h2>Then.</h2><p>{LONG[2]}</p><ul><li>First item, short<li>Second item</ul><p>{LONG[3]}</p>"
MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Contact us"))
CHATTER = "".join(f"<p>{x} I quite agree, as a reader, with what was said here, and more.</p>" for x in LONG)

LAYOUTS = {
    "landmarks": f"<html><body><header><h1>The Paper</h1></header><nav><ul>{MENU}</ul></nav><main><article>{ARTICLE}</article></main><aside><p>{LONG[4]}</p></aside><footer>&copy; The Paper. All rights, reserved.</footer></body></html>",
    "article only": f"<body><div class=ad>Buy now, pay later, be happy.</div><article>{ARTICLE}</article><form>Your name, please. <input name=x><button>Send</button></form></body>",
    "divisions": f"<body><div id=top><a href=/>Home</a> <a href=/a>About</a></div><div class=wrapper><div class=content>{ARTICLE}</div><div class=sidebar><p>{LONG[4]}</p></div></div><div id=footer><p>Imprint, privacy, and so on.</p></div></body>",
    "no names": f"<body><div><ul>{MENU}</ul></div><div>{ARTICLE}</div><div><a href=1>One</a> | <a href=2>Two</a></div></body>",
    "comments": f"<body><article>{ARTICLE}<section class='comments'><h3>3 comments</h3>{CHATTER}</section></article></body>",
    "comment articles": f"<body><main><article class=post>{ARTICLE}</article><ol id=comment-list><li><article class='comment byuser'>{CHATTER}</article></li></ol></main></body>",
    "table": f"<table><tr><td class=menu><ul>{MENU}</ul></td><td>{ARTICLE}</td></tr><tr><td colspan=2 class='copyright'>Copyright, 1999.</td></tr></table>",
    "notice": f"<body><div class='cookie-notice' role=alert><p>{LONG[5]} We use cookies, as all do.</p></div><div class='post'><div class='entry-header'><h1>{TITLE}</h1></div>{ARTICLE.split('</h1>', 1)[1]}<div class='share-buttons'>Share, tweet, like.</div></div></body>",
    "hidden": f"<body><div style='display: none'><p>{LONG[5]}</p></div><main>{ARTICLE}<script>var a = '<p>no, never.</p>';</script><style>p > a {{}}</style><noscript>Turn it on, please.</noscript></main></body>",
    "headers": f"<body><div class='page-header'><h1>The Paper</h1><p>Founded, as all know, in 1900.</p></div><div id='main-menu'>{MENU}</div><div class=post><header class='post-header'><h1>{TITLE}</h1></header>{ARTICLE.split('</h1>', 1)[1]}</div></body>".replace("<header class='post-header'>", "<div class='post-header'>").replace("</header>", "</div>"),
    "unclosed": f"<body><nav><ul>{MENU}</ul></nav><article>{ARTICLE.replace('</p>', '').replace('</li>', '')}",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert html.main_text(LAYOUTS[name])[0] == "\n\n".join(BODY)


def test_blocks_references_and_white_space():
    page = "<article><p> a&amp;b &lt;i&gt; &#233;&#x41;&nbsp;\n\t<b>bo</b>ld<br>next,  line. <!-- > no --> end</p><p></p><p>x < y, or x > y.<p>&unknown; &amp</article>"
    assert html.main_text(page)[0] == "a&b <i> éA bold next, line. end\n\nx < y, or x > y.\n\n&unknown; &"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<!--", "</p>", "<p", "<nav>only a menu, here.</nav>", "<!-->", "<a b='", "<script>x", "<title>t</title>", "\x00"])
def test_pages_without_text(page):
    assert html.main_text(page)[0] in ("", "<", "<p", "<a b='", "\x00")


def test_one_short_paragraph_stays():
    assert html.main_text("<p>Hi")[0] == "Hi"
    assert html.main_text("just text & more")[0] == "just text & more"


def test_deep_and_long_pages_take_time_that_grows_with_them():
    began = time.time()
    deep = html.main_text("<div>" * 20000 + "In the deep, a sentence.")[0]
    assert deep == "In the deep, a sentence."
    assert html.main_text("<" * 500_000)[0] == "<" * 500_000
    long = "<article>" + "<p>One of very many, indeed.</p>" * 200_000 + "</article>"
    assert html.main_text(long)[0].count("One of") == 200_000
    html.main_text("<p a='" * 100_000)
    assert time.time() - began < 60


def test_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x", 1), (1, "u", f"<article>{ARTICLE}</article>", "x", 1), (None, None, None, None, None), (2, "v", "", "", 0)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    want = "\n\n".join(BODY)
    key = lambda r: str(r)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=key) == sorted([(1, "u", want, len(want))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=key)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_all_pages_of_a_table(spark):
    """The pages hold their article in one element, so a plain cut by pattern gives what is wanted."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in registry.op11_tag_path_extraction(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        cut = re.search("<article>(.*)</article>", p["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", cut)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[p["page_id"]]["url"], got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"]) == (p["url"], want, len(want))
