import html
import re

from crashrisk.llm.html_paths import extract_main_text, main_text, op10


def test_pages(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op10(spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for row in got:
        page = pages[row["page_id"]]
        article = re.search(r"<article>(.*)</article>", page["html"], re.DOTALL)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert row["text"] == "\n".join(b for b in blocks if b), row["page_id"]
        assert row["n_chars"] == len(row["text"]) and row["url"] == page["url"]


PAGE = """<html><head><title>T</title><style>p { x: y }</style></head><body>
<div id="top-nav"><a href=x>Home</a> <a>About, contact, and more of it.</a></div><div class="cookie-notice">We use cookies, many of them. Accept.</div>
<div class="content"><h2>A title</h2><p>First long paragraph, with text &amp; more text, indeed; it goes on.
 And on, for a while.<p>Second <i>lo</i>ng paragraph, with text.<br>It goes on, too, as paragraphs do.<ul><li>Point one, of some length.</ul><p>Short.</p>
<form><p>Your name, please, in full.</p></form><script>document.write("<p>no</p>")</script></div>
<aside><p>Buy this now, it is great, cheap, and so on and on and on.</p></aside><div class="comments"><p>I agree, totally. This is what a reader says.</p></div>
<footer><p>Copyright, contact, and all the rest.</p></footer></body></html>"""


def test_page_without_an_article_element():
    assert main_text(PAGE) == ["A title", "First long paragraph, with text & more text, indeed; it goes on. And on, for a while.",
                               "Second long paragraph, with text. It goes on, too, as paragraphs do.", "Point one, of some length.", "Short."]


def test_articles_of_several_parts_are_whole():
    """Without <article> or <main> no section, list, quote or cell stands for the whole."""
    def words(n, word):
        return ", ".join([word] * n) + "."

    def page(*blocks):
        parts = "".join(f"{begin}{text}{end}" for begin, text, end in blocks)
        return main_text(f"<body><nav>menu</nav><div><h2>Title</h2>{parts}</div></body>"), ["Title", *(t for _, t, _ in blocks)]

    for blocks in (
        [("<section><p>", words(60, "one"), "</p></section>"), ("<section><p>", words(40, "two"), "</p></section>")],
        [("<p>", words(10, "before"), "</p>"), ("<ul><li>", words(80, "long"), "</li>"), ("<li>", words(9, "short"), "</li></ul>")],
        [("<p>", words(20, "before"), "</p>"), ("<blockquote>", words(90, "quote"), "</blockquote>"), ("<p>", words(20, "after"), "</p>")],
        [("<p>", words(20, "before"), "</p>"), ("<pre>", words(90, "code"), "</pre>"), ("<p>", words(20, "after"), "</p>")],
        [("<p>", words(20, "before"), "</p>"), ("<table><tr><td>", words(90, "cell"), "</td></tr></table>"), ("<p>", words(20, "after"), "</p>")],
        [("<section><blockquote>", words(60, "quote"), "</blockquote></section>"),
         *(("<section><p>", words(5, f"p{i}"), "</p></section>") for i in range(20))],
        [("<blockquote><div>", words(90, "quote"), "</div></blockquote>"), ("<p>", words(5, "after"), "</p>")],
    ):
        got, want = page(*blocks)
        assert got == want, blocks[0]
    assert main_text("<body><div><a href=x>" + words(40, "link") + "</a></div><table><tr><td><div><p>" + words(30, "cell") + "</p></div></td></tr></table>"
                     ) == [words(30, "cell")]


def test_odd_pages():
    assert main_text("") == [] and main_text("<p>") == [] and main_text("<script>x") == []
    assert main_text("plain text, no tags.") == ["plain text, no tags."]
    assert main_text('<p title="a > b">x y.</p>') == ["x y."]
    assert main_text("<!-- <p>no</p> --><article><p>yes, so it is.</p></article>") == ["yes, so it is."]
    assert main_text("<div>" * 3000 + "<p>deep text, here.</p>") == ["deep text, here."]
    assert main_text("<nav>menu</nav>") == []


def test_edges(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<article><p>One, two.</p></article>"), (2, "v", "<p>" + "long text, " * 50_000 + "</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'x' AS n_chars")
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in extract_main_text(frame).collect())
    assert got == sorted([("1", 0), ("1", 0), ("None", 9), ("2", 549_999)])
    assert extract_main_text(frame.limit(0)).count() == 0


def test_attributes_say_what_they_say():
    text = "A long sentence of the article, with marks; and more of it, as articles have."
    for mark in ('class="content no-sidebar"', 'aria-hidden="false"', 'title="a hidden place"', 'data-role="menu"', 'class="side-by-side"',
                 'data-hidden', 'class="related-work"', 'class="page has-sidebar with_banner"', "title='class=\"menu\"'", 'class="adapted shared"',
                 'class="aside-note wayside"', 'id="searching"'):
        for page in (f"<body><div {mark}><p>{text}</p><p>{text}</p></div></body>", f"<article><p>{text}</p><div {mark}><p>{text}</p></div></article>",
                     f"<article><p {mark}>{text}</p><p>{text}</p></article>"):
            assert main_text(page) == [text, text], (mark, page)
    for mark in ('class="sidebar"', 'class="box left-sidebar"', 'id=top_nav', "class='side'", 'class="side-bar"', 'class="related"', 'class="related-posts"',
                 'hidden', 'aria-hidden="true"', 'role="navigation"', 'class="advertisement"', 'CLASS="Cookie-Notice"', 'id="comments"'):
        page = f"<article><p>{text}</p><div {mark}><p>{text} No.</p></div><p>{text}</p></article>"
        assert main_text(page) == [text, text], mark
