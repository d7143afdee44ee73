import re
from html import unescape

import pytest

from helpers import SF
from lodestrata.llm import html_text, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>x</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
<div id=wrap>{main}<aside><p>Sidebar words that are quite long and plain.</p></aside></div>
<div class="ad">Buy this now.</div><form><p>Your name <input name=n></p><button>Send</button></form><div id="comments"><p>First! A reader wrote a long comment here, with many words.</p></div>
<footer>&copy; me</footer></body></html>"""


def text(main):
    return html_text.main_text(PAGE.format(main=main))


def test_article():
    assert text("<article><h1>Head &amp; line</h1><p>One  two\n three.</p><p>Short.</p><ul><li>a point<li>another</ul></article>") == "Head & line\nOne two three.\nShort.\na point\nanother"


def test_without_article_element():
    assert text("<div class=text><h2>Title here</h2><p>A first paragraph of some length.<p>A second paragraph, <b>bold</b> and <a href=x>linked</a>.</div>") == "Title here\nA first paragraph of some length.\nA second paragraph, bold and linked."


def test_sections_side_by_side_are_kept():
    got = text("<main><section><p>One part of the text is here.</p><p>And more of it follows.</p></section><section><p>The other part is here, of like length.</p><p>It ends.</p></section></main>")
    assert got.split("\n") == ["One part of the text is here.", "And more of it follows.", "The other part is here, of like length.", "It ends."]


STORY = "<h1>Title here</h1><p>A first paragraph of some length, and more.</p><p>A second paragraph, which is long as well.</p>"


@pytest.mark.parametrize("wrapper", ['div class="content has-sidebar"', 'div id="content-sidebar-wrap"', 'div class="elementor-widget elementor-widget-theme-post-content"', 'section class="social-policy"', 'div class="related-work"', 'form action="/"', 'form id=f class="share"'])
@pytest.mark.parametrize("inner", ["{}", '<div class="content-widget">{}</div>'])
def test_wrappers_named_like_noise_keep_the_text(wrapper, inner):
    story = inner.format(STORY)
    assert text(f'<{wrapper}><input name=q><div class="share"><a href=x>Tell friends</a></div>{story}<div class="related"><a href=y>Other story</a></div></{wrapper.split()[0]}>') == "Title here\nA first paragraph of some length, and more.\nA second paragraph, which is long as well."


@pytest.mark.parametrize("main,want", [
    ('<article><h1>Title</h1><p>One paragraph of text, long enough.</p><h2 id="related-work">Related work</h2><p>Another paragraph of it here.</p><h2 id="share-prices">Share prices</h2><p>They rose again today.</p></article>',
     "Title\nOne paragraph of text, long enough.\nRelated work\nAnother paragraph of it here.\nShare prices\nThey rose again today."),
    ('<article><h1>Title</h1><p>One paragraph of text, long enough.</p><section id="social-policy"><h2>Social policy</h2><p>Another paragraph of it here.</p></section></article>', "Title\nOne paragraph of text, long enough.\nSocial policy\nAnother paragraph of it here."),
    ('<article><header><h1>Title</h1></header><p>One paragraph of text, long enough.</p><p>Another paragraph of it here.</p></article>', "Title\nOne paragraph of text, long enough.\nAnother paragraph of it here."),
    ('<h1>Title</h1><div class=text><p>One paragraph of text, long enough.</p><p>Another paragraph of it here.</p><p>And a third one, at the end.</p></div>', "Title\nOne paragraph of text, long enough.\nAnother paragraph of it here.\nAnd a third one, at the end."),
    ('<article><h1>Title</h1><p>One paragraph of text, long enough.</p><p>Another paragraph of it here.</p></article><div id="sidebar-left"><p>Words beside the text.</p></div><div id="reader-comments"><p>First! Well said.</p></div><div id="site-nav"><a href=/a>All</a></div>', "Title\nOne paragraph of text, long enough.\nAnother paragraph of it here."),
])
def test_headings_and_sections_with_names_from_their_text_stay(main, want):
    assert text(main) == want


def test_long_comments_are_still_left_out():
    comments = '<div id="comments">' + "<p>A reader wrote a long comment here.</p>" * 8 + "</div>"
    want = "Title here\nA first paragraph of some length, and more.\nA second paragraph, which is long as well."
    assert html_text.main_text(f"<article>{STORY}</article>{comments}") == want
    assert html_text.main_text(f"<div>{STORY}</div>{comments}") == want


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>", ""), ("<article>One</article>", "One"), ("<article><p>a<br>b", "a b"), ("<p>&am; &amp &lt;b&gt;</p>", "&am; & <b>"),
    ("<body><nav>menu<p>open", ""), ("<div><script>x", ""), ("<p>a</p></div></p><p>b", "a\nb"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<" * 50, "<" * 50), ("<!-- only -->", ""),
])
def test_odd_pages(html, want):
    assert html_text.main_text(html) == want


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>core text</p>" + "</div>" * 3000
    assert html_text.main_text(deep) == "core text"
    assert html_text.main_text("<article>" + "<p>word word.</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_query_equals_the_article_of_each_page(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op10_html_text(spark, SF).collect()}
    for i, page in pages.items():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?p>|</?h1>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[i] == (want, len(want))


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (3, "u", "<p>x</p>", "t"), (3, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(str, html_text.extract(pages).collect())) == sorted(map(str, [html_text.extract(pages).where(f"page_id = {i}").first() for i in (1, 2, 3, 3)]))
    assert html_text.extract(pages).count() == 4 and html_text.extract(pages.limit(0)).count() == 0


TWO = "<p>A first paragraph of some length, and more.</p><p>A second paragraph, which is long as well.</p>"
TWO_TEXT = "A first paragraph of some length, and more.\nA second paragraph, which is long as well."
READERS = "<p>A reader wrote a long comment here, and went on for a while about it.</p>" * 12


@pytest.mark.parametrize("body,want", [
    (f"<div id=main><h1>Title</h1>{TWO}</div><div id=comments>{READERS}</div>", f"Title\n{TWO_TEXT}"),
    (f"<div><h1>Title</h1></div><div id=main>{TWO}</div><div id=comments>{READERS}</div>", f"Title\n{TWO_TEXT}"),
    (f"<div id=main>{TWO}</div><div id=comments>{READERS}</div>", TWO_TEXT),
    (f"<div id=main>{TWO}</div><ol class='comment-list x'>{READERS}</ol><div id=respond><h3>Leave a reply</h3><p>Your words here.</p></div>", TWO_TEXT),
    (f"<div id=main>{TWO}</div><div id=disqus_thread>{READERS}</div>", TWO_TEXT),
    (f"<article><h1>Title</h1>{TWO}</article><section><h2>Comments</h2><p>One reader said something here, at length.</p><p>Another one answered to that, and more.</p></section>", f"Title\n{TWO_TEXT}"),
    (f"<article><h1>Title</h1>{TWO}</article>" + f"<article class=comment>{READERS}</article>" * 3, f"Title\n{TWO_TEXT}"),
    (f"<article><h1>Title</h1>{TWO}<h2>12 Comments</h2>{READERS}</article>", f"Title\n{TWO_TEXT}"),
    (f"<div class=story><h1>Title</h1>{TWO}<section><h3>Comments (12)</h3>{READERS}</section></div>", f"Title\n{TWO_TEXT}"),
    (f"<div><h1>Title</h1></div><div>{TWO * 3}</div>", "Title\n" + "\n".join([TWO_TEXT] * 3)),
    (f"<div>{TWO * 3}</div><div><p>It ends here.</p></div>", "\n".join([TWO_TEXT] * 3) + "\nIt ends here."),
    (f"<div>{TWO * 3}</div><div><p>Copyright 2020 by us. All rights reserved.</p></div>", "\n".join([TWO_TEXT] * 3)),
    (f"<div class=page><h1>Title</h1>{TWO}<section class='social-policy'><h2>Social policy</h2><p>On it.</p></section><div class='notice-of-intent'><p>We intend to.</p></div></div>", f"Title\n{TWO_TEXT}\nSocial policy\nOn it.\nWe intend to."),
    (f"<div class=elementor-widget>{TWO}</div><div class=elementor-widget>{TWO}</div>", f"{TWO_TEXT}\n{TWO_TEXT}"),
    (f"<article><h1>Title</h1>{TWO}<section><h2>Discussion</h2><p>We discuss it.</p></section></article>", f"Title\n{TWO_TEXT}\nDiscussion\nWe discuss it."),
    (f"<main><h1>Title</h1><p>Lead in words.</p><article>{TWO * 2}</article></main>", None),
    (f"<div id=comments><h1>Title</h1>{TWO}</div>", f"Title\n{TWO_TEXT}"),
    (f"<div class='entry'><h2>Sub</h2>{TWO}</div><div class='widget-area'><p>Some widget with plain words in it.</p></div>", f"Sub\n{TWO_TEXT}"),
    (f"<div class='post'><h1>Title</h1>{TWO}</div><div class='x-share-y2'><a href=1>Tell a friend</a> <a href=2>Send it</a></div>", f"Title\n{TWO_TEXT}"),
])
def test_everyday_pages(body, want):
    """With and without article elements, and reader comments by name and by heading."""
    page = f"<html><head><title>x</title></head><body><nav><a href=/>Home</a><a href=/b>News</a></nav>{body}<footer>me</footer></body></html>"
    got = html_text.main_text(page)
    if want is None:
        assert got.startswith("Title\n") and got.endswith("\n".join([TWO_TEXT] * 2))
    else:
        assert got == want


def plain_density(node, top):
    """The published formula, counted anew for each node."""
    import math

    def counts(n):
        c = t = lc = lt = 0
        for k in n.children:
            if isinstance(k, str):
                c += len(k.replace(" ", "").replace("\n", ""))
            else:
                kc, kt, klc, klt = counts(k)
                c, t, lc, lt = c + kc, t + kt + 1, lc + klc, lt + klt + (k.tag == "a")
        return c, t, c if n.tag == "a" else lc, lt

    (c, t, lc, lt), (cb, _, lcb, _) = counts(node), counts(top)
    if not c:
        return 0.0
    base = math.log(c * max(1, lc) / max(1, c - lc) + lcb / max(1, cb) * c + math.e)
    if base == pytest.approx(1):
        return c / max(1, t)  # without a base, characters a tag
    return c / max(1, t) * max(0.0, math.log(c * max(1, t) / (max(1, lc) * max(1, lt)), base))


def test_densities_equal_the_published_formula():
    import random

    rng = random.Random(8)
    for _ in range(30):
        html, opened = "", []
        for _ in range(rng.randrange(5, 120)):
            kind = rng.random()
            if kind < 0.4:
                opened.append(rng.choice(["div", "section", "a", "span", "li", "b"]))
                html += f"<{opened[-1]}>"
            elif kind < 0.6 and opened:
                html += f"</{opened.pop()}>"
            else:
                html += " ".join("word"[: rng.randrange(1, 5)] for _ in range(rng.randrange(9))) + "\n"
        tree = html_text.Tree()
        tree.feed(html)
        tree.close()
        order = html_text.measure(tree.root)
        for node in order:
            assert node.density == pytest.approx(plain_density(node, tree.root))
            assert node.total == pytest.approx(sum(plain_density(k, tree.root) for k in node.children if not isinstance(k, str)))
