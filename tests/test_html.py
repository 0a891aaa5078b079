"""The DOM, extraction strategies, Markdown and pruning on hand-made pages."""

import json
import re

import pytest

from webgrain.html import dom, extract, markdown, prune

LONG = "This sentence, of some length, is here to give the page a body that counts. " * 4


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title> Page title </title>{head}</head><body>{body}</body></html>"


# -- DOM -------------------------------------------------------------------------


def test_paragraphs_and_items_close_themselves():
    doc = dom.parse("<div><p>one<p>two<ul><li>a<li>b</ul>three</div>")
    div = dom.Selector("div").first(doc)
    assert [c.tag if isinstance(c, dom.Element) else c for c in div.children] == ["p", "p", "ul", "three"]
    assert [e.text() for e in dom.Selector("li").all(doc)] == ["a", "b"]


def test_scripts_keep_end_tags_of_others():
    doc = dom.parse('<script>var t="</p>";</script><p>x</p></section>')
    assert dom.Selector("script").first(doc).text() == 'var t="</p>";'
    assert doc.inner_html() == '<script>var t="</p>";</script><p>x</p>'


def test_selectors():
    doc = dom.parse('<main><div class="a b" id="x" data-k="Five stars"><p>1</p></div></main><p>2</p>')
    pick = lambda s: [e.text() for e in dom.Selector(s).all(doc)]
    assert pick("main p") == ["1"] and pick("main > p") == [] and pick("div > p, body p") == ["1"]
    assert pick(".a.b") == ["1"] and pick("#x") == ["1"] and pick('[data-k*="five" i]') == ["1"] and pick("[data-k*=five]") == []
    with pytest.raises(ValueError):
        dom.Selector("p:hover")


def test_deep_pages_are_no_trouble():
    doc = dom.parse("<div>" * 5000 + "x" + "</div>" * 5000)
    assert doc.text() == "x" and doc.copy().outer_html().count("<div>") == 5000
    assert extract.extract("<div>" * 3000 + LONG)["text"]


# -- extraction --------------------------------------------------------------------


def ld(data):
    return f'<script type="application/ld+json">{data if isinstance(data, str) else json.dumps(data)}</script>'


def test_structured_data_wins_and_its_limits():
    body = "b" * 200
    article = {"@type": "NewsArticle", "headline": "Head", "articleBody": body}
    out = extract.extract(page(f"<p>{LONG}</p>", ld(article)))
    assert out["method"] == "json-ld" and out["text"] == f"Head\n\n{body}" and out["title"] == "Head"
    assert out["markdown"].startswith("# Head\n\n")
    assert extract.json_ld(dom.parse(page("", ld(article | {"articleBody": "b" * 199})))) is None
    assert extract.json_ld(dom.parse(page("", ld("{broken") + ld([{"@graph": [article]}])))).text.endswith(body)
    assert extract.json_ld(dom.parse(page("", ld({"@type": "WebPage", "text": body})))) is None
    assert extract.json_ld(dom.parse(page("", ld({"@type": ["Thing", "BlogPosting"], "text": body})))).title is None
    longest = extract.json_ld(dom.parse(page("", ld([article, article | {"articleBody": "c" * 300, "headline": "L"}]))))
    assert longest.title == "L"


def test_reader_view_takes_the_article():
    out = extract.extract(page(f"<nav>{LONG}</nav><article><h1>Own</h1><p>{LONG}</p><p>{LONG}</p></article><footer>{LONG}</footer>"))
    assert out["method"] == "readability" and out["text"].count("This sentence") == 8 and out["markdown"].startswith("# Page title\n\n")


def test_density_block_and_fallback():
    short = "word " * 5
    dense = "<section>" + f"<p>{short}</p>" * 12 + "</section>"
    assert extract.densest(dom.parse(page(dense))).method == "density"
    assert extract.densest(dom.parse(page("<section><p>a</p></section>"))) is None
    block = extract.extract(page(f'<span class="x"><i class="post-content">{"tiny " * 30}</i></span>'))
    assert block["method"] == "largest-block"
    plain = extract.extract(page("just text"))
    assert plain["method"] == "fallback" and plain["text"] == "Page title\n\njust text"


def test_meta_tags_need_six_letters():
    head = '<meta property="og:title" content="12345"><meta name="twitter:title" content="123456"><meta name="description" content=" A description ">'
    assert extract.meta_tags(dom.parse(page("", head))) == {"title": "123456", "description": "A description"}
    assert extract.meta_tags(dom.parse("<p>x</p>")) == {"title": None, "description": None}


def test_formats_gate_what_is_made():
    out = extract.extract(page(f"<script>x</script><p>{LONG}</p>"), ("html", "json"))
    assert "<script" not in out["html"] and out["markdown"] is None and out["text"] is None and out["title"] == "Page title"


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "</p></p>", "<![CDATA[x", "\x00", "<a href=x>" * 300])
def test_odd_pages_do_not_fail(html):
    extract.extract(html, extract.FORMATS)
    prune.prune(html)


# -- Markdown ----------------------------------------------------------------------


@pytest.mark.parametrize(
    "html,md",
    [
        ("<h1>A</h1><h3>B <b>c</b></h3>", "# A\n\n### B **c**"), ("<p>a<br>b</p>", "a\nb"), ("<ul><li>a<li>b</ul>", "*   a\n*   b"),
        ("<ol start=3><li>a</li><li>b</li></ol>", "3.  a\n4.  b"), ('<p><a href="/u">x <i>y</i></a></p>', "[x _y_](/u)"),
        ('<pre><code class="language-py">a = 1\nb</code></pre>', "```py\na = 1\nb\n```"), ("<p>use <code>f()</code></p>", "use `f()`"),
        ('<img src="data:image/gif;base64,AA"><p>k</p>', "k"), ('<p><img src="/i.png" alt="t"></p>', "![t](/i.png)"), ("<blockquote><p>q</p></blockquote>", "> q"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"), ("<p>1 * 2</p>", "1 \\* 2"), ("", ""),
    ],
)
def test_markdown(html, md):
    assert markdown.to_markdown(html) == md


def test_markdown_is_cleaned():
    assert "data:" not in markdown.clean_markdown("a [x](javascript:void(0)) \n ; \n\n\n\nb![](data:image/png;base64,A)")
    assert "javascript" not in markdown.clean_markdown("[x](javascript:f)")


# -- pruning -----------------------------------------------------------------------


def test_a_shop_page_keeps_what_it_says():
    """A page of our own: noise goes, goods stay with their marks."""
    html = (
        '<html><head><title>t</title></head><body><nav>Home</nav><div class="mt-2 grid-cols-3"><article class="lg:flex-1 goods" onmouseover="f()" data-n="7">'
        '<h2 style="color:red">Lamp</h2><span>plain</span><p class="stars two"></p><p class="Rating-box FIVE">so good</p><a href="/lamp" target="_blank">more</a>'
        '<img src="/l.png" width="9"><div><div></div><b></b></div><table><tr><td colspan="2" bgcolor="x">1</td></tr></table></article></div><footer>f</footer></body></html>'
    )
    assert prune.prune(html) == (
        '<html><body><article class="goods" data-n="7"><h2>Lamp</h2>plain<p class="stars two" data-rating-decoded="2">Rating: 2/5</p>'
        '<p class="Rating-box FIVE" data-rating-decoded="5">so good</p><a href="/lamp">more</a><img src="/l.png"><table><tr><td colspan="2">1</td></tr></table></article></body></html>'
    )


@pytest.mark.parametrize(
    "html,want",
    [
        ("<div><em> </em><img src=a></div>", '<img src="a">'), ("<ul><li></li></ul>", "<ul></ul>"), ("<section title=x><i></i></section>", '<section title="x"></section>'),
        ("<p class='no-stars six'></p>", '<p class="no-stars six"></p>'), ("<b hidden>x</b>y<aside>z</aside>", "y"), ("<div class='p-1'><span class='dark:a'>k</span></div>", "k"), ("<!--c--><p></p>", "<!--c-->"),
    ],
)
def test_what_says_shows_or_means_nothing_goes(html, want):
    assert prune.prune(html) == want


def test_long_pages_are_cut_and_classes_counted():
    assert prune.prune("<p>" + "word " * 40 + "</p>", 33) == ("<p>" + "word " * 40)[:33] + "\n<!-- truncated -->"
    assert prune.semantic_classes("one two p-3 three four md:w-1 five six seven") == "one two three four five six"
    assert prune.prune("<div>" * 4000 + "deep" + "</div>" * 4000) == "deep"


def test_facts_are_those_of_each_elements_text():
    html = "<div> a <p> b c </p>\n<section><p>d</p> <p> </p><!-- no --><i>e<b> </b></i> </section></div><div> <p></p></div>"
    tree = dom.parse(html)
    facts = extract.facts_of(tree)
    for e in tree.elements():
        if e.tag != "!--":
            p = [x for x in e.elements() if x.tag == "p"]
            f = facts[id(e)]
            assert (f.size, f.trimmed, f.paragraphs, f.paragraph_size) == (len(e.text()), len(e.text().strip()), len(p), sum(len(x.text().strip()) for x in p))


def test_records_by_a_declared_spec():
    html = "".join(f'<li class="i"><a href="/{n}">N{n}</a><b>${n},000.50</b></li>' for n in (1, 2))
    spec = {"item": "li.i", "fields": {"name": {"selector": "a"}, "url": {"selector": "a", "attr": "href"}, "price": {"selector": "b", "type": "number"}, "none": {"selector": "em"}}}
    assert prune.records(html, spec) == [{"name": f"N{n}", "url": f"/{n}", "price": n * 1000 + 0.5, "none": None} for n in (1, 2)]
    made = prune.spec_from_example(html, {"name": "N2", "missing": "zzz"})
    assert prune.records(html, made) == [{"name": "N1"}] and prune.records(html, made | {"item": "li.i"}) == [{"name": "N1"}, {"name": "N2"}]
