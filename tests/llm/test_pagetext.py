"""Main text of pages: a plain version on the given pages, hand-made pages, odd rows."""

import random
from html.parser import HTMLParser
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from weftline.llm import pagetext
from weftline.llm.queries import op11_main_text

SF = "/root/testdata/sf0.01"


class Article(HTMLParser):
    """Text of the article element by the standard library's parser; blocks apart by spaces."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.parts += [] if tag in pagetext.INLINE and tag != "br" else [" "]

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.parts += [] if tag in pagetext.INLINE else [" "]

    def handle_data(self, data):
        self.parts += [data] if self.depth else []


def plain(page):
    parser = Article()
    parser.feed(page)
    parser.close()
    return " ".join("".join(parser.parts).split())


def test_given_pages_equal_a_plain_version(spark):
    got = {r.page_id: r for r in op11_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for row in pages:
        assert got[row.page_id].text == plain(row.html) and got[row.page_id].url == row.url
        assert got[row.page_id].n_chars == len(plain(row.html))


PROSE = "Rivers carry gravel down to the plain and leave it there in long bars each spring."
OTHER = "Smaller streams only move sand, and what they leave is gone by the next flood."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("no markup &amp; two  words", "no markup & two words"),
        (f"<body><article><p>{PROSE}</p></article>", PROSE),
        # without an article element: link lists before, a marked sidebar and a footer after
        (
            "<html><head><title>t</title></head><body><div id=top><ul>"
            + "".join(f'<li><a href="/{i}">Go {i}</a></li>' for i in range(9))
            + f'</ul></div><div class="text"><h1>Rivers</h1><p>{PROSE}<p>{OTHER}</div><div class="right-sidebar"><p>{OTHER}</div>'
            f"<footer>{OTHER}</footer>",
            f"Rivers {PROSE} {OTHER}",
        ),
        # furniture inside of the article, closed and not closed
        (
            f'<main><h1>A&nbsp;title</h1><p>{PROSE}</p><div class="advert"><p>Buy <b>now</b></div><form><p>Name <input name=n></form>'
            f'<script>if (a < b) "</p>"</script><aside><p>{OTHER}</aside><p>{OTHER}</p><section id="comments"><p>{PROSE}</section></main>',
            f"A title {PROSE} {OTHER}",
        ),
        (f'<article><p class="cookie-notice">We set cookies<p>{PROSE}<ul><li class=ad>x<li>kept</ul></article>', f"{PROSE} kept"),
        # inline elements and comments don't end words; br is white space
        ("<article><p>o<b>n</b>e<!-- x > y --> t&#119;o<br>th<span>r</span>ee\n\t four</p></article>", "one two three four"),
        ('<article><p title="a > b" lang=x>one</p><p>a < b</p></article>', "one a < b"),
        ("<article><p>one</p><p>two &lt;b&gt; &copy</p><p clas", "one two <b> ©"),
        # names that only look like furniture
        (f'<body class="has-sidebar"><div class="no-ads shadow"><p>{PROSE}</div></body>', PROSE),
        ("<nav><a href=/>Home</a></nav><footer>End</footer>", ""),
        (f'<article><div class="SIDEBAR">{OTHER}</div><div id="topAdBox">Buy</div><div class="hasAds download">{PROSE}</div></article>', PROSE),
        (f'<header><p>{OTHER}</header><article><header><h1>Rivers</h1></header><p>{PROSE}</p><footer>Tags</footer></article>', f"Rivers {PROSE}"),
        (f'<article><p>{PROSE}</article><article class="comment"><p>{OTHER} {OTHER}</article>', PROSE),
        (f'<body><p>{PROSE}<div role="complementary">{OTHER}</div><div hidden>{OTHER}</div><div style="display: none">{OTHER}</div>', PROSE),
    ],
)
def test_hand_made_pages(page, text):
    assert pagetext.extract(page, {})[0] == text


def test_the_scan_finds_the_best_run():
    rng = random.Random(3)
    for _ in range(400):
        scores = [rng.choice([-3, -2, -1, 0, 1, 2, 3]) for _ in range(rng.randint(0, 12))]
        start, stop = pagetext.best_run(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[start:stop]) == max([0, *sums])
        assert start < stop or not any(s > 0 for s in scores)


def test_weights_from_labelled_pages(spark):
    pages = spark.createDataFrame(
        [(i, f"<div><dl>{'<dt>x</dt>' * 9}</dl></div><article><ul><li>{PROSE}</ul></article><dl>y</dl>") for i in range(40)]
        + [(50, "<dl>unlabelled</dl>"), (51, None)],
        "page_id long, html string",
    )
    weights = pagetext.learn(pages)
    assert weights["dl"] < pagetext.weight("dl") - 3 and weights["li"] > pagetext.weight("li")
    assert pagetext.TAG_COST > 0 and all((w > 0) == kind.startswith("word") for kind, w in weights.items())
    # what the labelled pages say decides where nothing is marked
    page = f"<dl><dt>{PROSE}</dt></dl><p>{PROSE} {OTHER}</p>"
    assert pagetext.extract(page, {})[0] == f"{PROSE} {PROSE} {OTHER}"
    few = f"<dl><dt>Short list</dt></dl><p>{PROSE} {OTHER}</p>"
    assert pagetext.extract(few, weights)[0] == f"{PROSE} {OTHER}"


def test_odd_rows(spark):
    long = "<article>" + "<p>word " * 200_000 + "</article>"
    deep = "<div><b>" * 20_000 + "text" + "</p></li>" * 1000
    unclosed = '<a title="' * 5_000 + "<!-- " * 5_000
    rows = [(1, "u", f"<article>{PROSE}</article>", "a", 5), (1, "u", f"<article>{PROSE}</article>", "a", 5), (None, None, None, None, None)]
    rows += [(2, "u", "", "", 0), (3, "v", long, "b", 1), (4, "w", deep, "c", 1), (5, "x", unclosed, "d", 1), (6, "y", "<<<>&#xZ;</", "e", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = pagetext.main_text(pages).cache()
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    by = {r.page_id: r for r in got.where("page_id is not null").collect()}
    assert got.where("page_id = 1 and n_chars = length(text)").count() == 2 and by[1].text == PROSE
    assert by[3].n_chars == 5 * 200_000 - 1 and by[4].text == "text" and by[2].text == "" == by[5].text
    assert by[6].text == "<<<>&#xZ;"
    none = got.where("page_id is null").collect()
    assert [(r.url, r.text, r.n_chars, r.region_end) for r in none] == [(None, "", 0, 0)]
    assert pagetext.main_text(pages.limit(0)).count() == 0
    spans = got.join(pages.select("page_id", "html").distinct(), "page_id").where("n_chars > 0")
    inside = F.expr("substring(html, cast(region_start as int) + 1, cast(region_end - region_start as int))")
    assert spans.where(F.length(inside) < F.col("n_chars")).where("page_id < 4").count() == 0


def test_regions_follow_the_page(spark):
    page = f"<nav>x</nav><article><p>{PROSE}</p><p>{OTHER}</p></article>"
    text, blocks, start, end = pagetext.extract(page, {})
    assert blocks == 2 and page[start:end] == f"{PROSE}</p><p>{OTHER}"
    assert all(a <= b for a, b in pairwise(pagetext.tokens(page).places))
