import pytest
from fixtures import SF
from pyspark.sql import functions as F

from vexel.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav>
<div class="wrap"><article><h1>The title</h1><p>First paragraph of the text, &amp; long   enough
to count as content.<p>Second <b>one</b>, which is also long enough to be taken for the content.<div class="ad-slot">Buy now</div><p>Short.</p>
<form><p>Your mail</p></form></article><section id="comments"><p>I disagree with all of this, and say so at some length here.</p></section></div>
<aside>More</aside><footer>&copy; us</footer></body></html>"""
TEXT = "The title\n\nFirst paragraph of the text, & long enough to count as content.\n\nSecond one, which is also long enough to be taken for the content.\n\nShort."


def test_article_alone():
    assert html.main_text(PAGE) == TEXT


def test_page_without_article_element():
    assert html.main_text(PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>")) == TEXT


@pytest.mark.parametrize("before, after", [('<div class="page has-sidebar">', "</div>"), ('<div class="content no-comments">', "</div>"), ('<div id="main-menu-layout"><div class="page has-sidebar">', "</div></div>"),
                                           ("<form>", "</form>"), ('<form action="/x"><fieldset>', "</fieldset></form>"), ('<article class="post comments-open">', "</article>"), ("<form><main>", "</main></form>")])
@pytest.mark.parametrize("page", [PAGE, PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>")])
def test_wrapper_with_a_name_or_form(page, before, after):
    """What is named within it goes all the same."""
    assert html.main_text(page.replace('<div class="wrap">', before).replace("</div>\n<aside>", after + "\n<aside>")) == TEXT
    if "<article" in before or "<main" in before:  # a header within it would be the article's own
        return
    start, stop = page.index("<header>"), page.index("</body>")
    assert html.main_text(page[:start] + before + page[start:stop] + after + page[stop:]) == TEXT


def test_comments_longer_than_the_article():
    comment = "<p>I disagree with all of this, and say so at some length here.</p>"
    page = PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>")
    assert html.main_text(PAGE.replace(comment, 20 * comment)) == html.main_text(page.replace(comment, 20 * comment)) == TEXT


def lines_beside(lines):
    prose = "".join(f"<p>Paragraph {i} of the article is a good deal longer than any of the lines that stand beside it, and so its ratio of text to tags is high.</p>" for i in range(12))
    return f"<html><body><div>{prose}</div><div>{''.join(f'<p><b>score</b> of <i>team</i> {i}</p>' for i in range(lines))}</div></body></html>"


def test_the_ratios_decide():
    """The region is the one whose smoothed ratios stand out; without threshold or with far too wide a kernel it is another."""
    page = lines_beside(80)
    text = html.main_text(page)
    assert text.startswith("Paragraph 0") and "score" not in text
    assert "score" in html.main_text(page, html.Params(threshold=0.0)) and "score" in html.main_text(page, html.Params(sigma=60.0, threshold=0.1))


def test_region_equals_a_plain_loop():
    """Ratios, kernel, threshold and mass worked out block by block."""
    page = lines_beside(80)
    reader = html.parse(page)
    ratio = [(len(b.text) - min(b.link_chars, len(b.text))) / max(1, b.tags) for b in reader.blocks]
    mean = sum(ratio) / len(ratio)
    std = (sum((r - mean) ** 2 for r in ratio) / len(ratio)) ** 0.5
    weights = [2.718281828459045 ** (-0.5 * d * d) for d in range(-3, 4)]
    chosen = []
    for i in range(len(ratio)):
        near = [ratio[min(max(i + d, 0), len(ratio) - 1)] for d in range(-3, 4)]
        chosen.append(sum(w * r for w, r in zip(weights, near)) / sum(weights) >= 0.5 * std and ratio[i] > 0)
    assert html.clustered(reader.blocks, [False] * len(ratio), html.Params()).tolist() == chosen
    share = {}
    for b, c in zip(reader.blocks, chosen):
        node = b.node
        while c and node:
            share[node] = share.get(node, 0) + len(b.text)
            node = reader.parents[node]
    total = sum(len(b.text) for b, c in zip(reader.blocks, chosen) if c)
    assert html.region(reader, html.Params())[-1] == max(n for n, v in share.items() if v >= 0.7 * total and reader.tags[n] in html.CONTAINERS)


def test_names_within_the_text():
    page = PAGE.replace("<p>Short.", '<h2 id="social-history">Social history</h2><p class="share-price">Short.')
    assert html.main_text(page) == TEXT.replace("Short.", "Social history\n\nShort.")


def prose(n, first=0):
    return [f"Paragraph {i} of the article, with enough words in it to be told apart from what stands around it on the page." for i in range(first, first + n)]


def tagged(texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


SHELL = "<html><body><nav><a href=1>One</a> <a href=2>Two</a></nav>{}<footer>us</footer></body></html>"
SOURCES = "<h2>Sources</h2><ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li><li><a href=c>Third source</a></li></ul>"
WHOLE = [
    *[(f"<{tag}>{tagged(prose(a))}</{tag}><{tag}>{tagged(prose(b, a))}</{tag}>", prose(a + b)) for tag in ("div", "section") for a, b in ((9, 1), (6, 4), (4, 6), (1, 9))],
    (f"<p>{prose(1)[0]}</p><div>{tagged(prose(8, 1))}</div>", prose(9)),
    (f"<div>{tagged(prose(8))}</div><div>In short.</div><div>{tagged(prose(1, 8))}</div>", [*prose(8), "In short.", *prose(1, 8)]),
    (f"<table><tr><td>{' '.join(prose(8))}</td><td>{prose(1, 8)[0]}</td></tr></table>", [" ".join(prose(8)), prose(1, 8)[0]]),
    (f"<div>{tagged(prose(5))}<p>The account <span class='login'>admin</span> was closed by its owner in the spring.</p></div>", [*prose(5), "The account admin was closed by its owner in the spring."]),
    *[(f"<{tag}>{tagged(prose(6))}{SOURCES}</{tag}>", [*prose(6), "Sources", "First source", "Second source", "Third source"]) for tag in ("article", "div")],
    (f"<article>{tagged(prose(5))}<fieldset>{tagged(prose(1, 5))}</fieldset></article>", prose(6)),
    (f"<div class='entry'><header><h1>The title</h1></header>{tagged(prose(6))}</div>", ["The title", *prose(6)]),
]


@pytest.mark.parametrize("body, texts", WHOLE)
def test_the_article_stays_whole(body, texts):
    assert html.main_text(SHELL.format(body)) == "\n\n".join(texts)


def test_the_ratios_decide_about_what_no_name_marks():
    """A part beside the region stays if it clusters; what it is cluttered with decides, not where it stands."""
    cluttered = "".join(f"<p><b>{i}</b> <i>more</i> <a href={i}>of</a> <b>it</b></p>" for i in range(12))
    page = SHELL.format(f"<div>{tagged(prose(9))}</div><div>{tagged(prose(1, 9))}</div><div>{cluttered}</div>")
    assert html.main_text(page) == "\n\n".join(prose(10))
    assert html.main_text(page, html.Params(threshold=0.0)) != html.main_text(page)


def test_deep_and_wide_pages():
    deep = "<div>" * 3000 + tagged(prose(3)) + "</div>" * 3000
    assert html.main_text(SHELL.format(deep)) == "\n\n".join(prose(3))
    assert html.main_text(SHELL.format(f"<div>{tagged(prose(4000))}</div>")) == "\n\n".join(prose(4000))


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<nav>menu</nav>", ""), ("<p>a &lt;b&gt; &#233;</p>", "a <b> é"), ("<![x[ a", "<![x[ a"), ("<p>cut off", "cut off"), ("<div>" * 20000 + "deep", "deep")])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def test_columns_nulls_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, 9, "old"), (None, None, None, 8, "old"), (1, "u", PAGE, 9, "old")], "page_id bigint, url string, html string, n_chars int, text string").withColumn("a.b", F.lit("x"))
    got = html.extracted(rows).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT))]
    assert html.page_texts(rows.limit(0)).count() == 0


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html.page_texts(pages).collect()
    assert len(got) == pages.count() and all(r.text and r.n_chars == len(r.text) for r in got)
