"""Main text of pages."""

import html
import re
import time

import pytest

from clearsift.llm.html_extraction import extract, main_text

CASES = [
    ("<div id=a><p>Short one, text.</p><aside>no</aside></div>", "Short one, text."),
    (
        "<body><nav><a href=x>m</a></nav><header><h1>Site</h1></header><main><h1>T</h1>"
        "<div class='content'><p>One,\n two.</p><div class='share'>x</div><p>A &amp; B &lt;b&gt;</p></div>"
        "</main><section class=comments><article class=comment><p>Bad, bad, bad</p></article></section>"
        "<footer>f</footer>",
        "T\n\nOne, two.\n\nA & B <b>",
    ),
    ("<p>a<p>b <b>c</p> d", "a\n\nb c\n\nd"),
    ("plain text only", "plain text only"),
    ("<ul><li><a href=x>menu</a></li></ul><div><p>Hello there, world, all</p></div>", "Hello there, world, all"),
    ('<p title="abc>Text & more</p><p>two</p>', "Text & more\n\ntwo"),
    ("a < b <c>d</c>", "a < b\n\nd"),
    ("<table><tr><td>Cell a<td>Cell b</table>", "Cell a\n\nCell b"),
    (
        "<div class='cookie-notice'>We use</div><div class='post'><h1>Ti</h1><p>Body, ok.</p>"
        "<form>f<input></form></div><div id='sidebar'><p>Side, text, text, text</p></div>",
        "Ti\n\nBody, ok.",
    ),
    ("<article><header><h1>H</h1><p>by x</p></header><p>B</p></article>", "H\n\nB"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><p>yes<!-- <p>no</p> --></p>", "yes"),
    ("<nav>only</nav><footer>this</footer>", ""),
    ("<div class='content ad-free'><p>Kept, text.</p></div>", "Kept, text."),
    ("<article><p>one</p><div class=ad>x</div><p>two", "one\n\ntwo"),
    ("<article><p>cut off &am", "cut off &am"),
    ("<article><p>cut off</p></arti", "cut off"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>a&nbsp;&eacute;&#8211;b</p>", "a é–b"),
    ("", ""),
    (None, ""),
    (
        f"<body><div><p>{'One of two, alike. ' * 7}</p></div><div><p>{'Two of two, alike. ' * 7}</p></div></body>",
        ("One of two, alike. " * 7).strip() + "\n\n" + ("Two of two, alike. " * 7).strip(),
    ),
    (
        f"<article><h1>T</h1><p>{'Text of it, long. ' * 9}</p></article><div class='discussion'><div><b>Al</b>"
        f"<p>{'No, I do not think so. ' * 5}</p></div></div>",
        "T\n\n" + ("Text of it, long. " * 9).strip(),
    ),
    (
        f"<div class=post><p>{'Text of it, long. ' * 30}</p><section class='reader-responses'><p>{'Well, no. ' * 9}</p></section>"
        "<div class=cta><p>Get it now, today, for less, at once.</p></div></div>",
        ("Text of it, long. " * 30).strip(),
    ),
    (
        f"<div><p>{'Text of it, long. ' * 30}</p><ul>" + "".join(
            f"<li class='entry-{'x'}'><span class=author>A{i}</span><p>{'Well, no, not so. ' * 6}</p></li>" for i in range(3)
        ) + "</ul></div>",
        ("Text of it, long. " * 30).strip(),
    ),
    (
        "<div><p>Short lead.</p>" + "".join(f"<div class=day><time>Day {i}</time><p>{'It went on, and on. ' * 9}</p></div>" for i in (1, 2)) + "</div>",
        "\n\n".join(["Short lead."] + [x for i in (1, 2) for x in (f"Day {i}", ("It went on, and on. " * 9).strip())]),
    ),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page",
    ["<" * 400_000, "</b>" * 100_000, "<p><span>" * 50_000, "<div>" * 50_000 + "x", "<!--" * 100_000,
     "<a x='" + '<p a="b ' * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "&" * 500_000,
     "<div class=a>" * 50_000 + "<time>x", "<p>x" + "<li class=a><time>x" * 50_000],
)
def test_broken_pages_take_linear_time(page):
    started = time.process_time()
    main_text(page)
    assert time.process_time() - started < 20


def test_pages_table_against_its_article_markup(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = extract(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", inner))
        plain = [" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", p)).split()) for p in parts]
        assert r.text == "\n\n".join(p for p in plain if p)


def test_columns_nulls_and_repeats(spark):
    pages = spark.createDataFrame(
        [(1, "<p>a", "old"), (1, "<p>a", "old"), (None, None, None)], "page_id long, html string, text string"
    )
    got = [(r.page_id, r.text) for r in extract(pages).collect()]
    assert sorted(got, key=str) == [(1, "a"), (1, "a"), (None, "")]
    assert extract(pages).columns == pages.columns and extract(pages.where("false")).count() == 0
