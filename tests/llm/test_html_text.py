import html
import re

import pytest

from cutlake.llm import html_text

from .conftest import DATA

PROSE = "The house of the old man is on the hill, and the road to it is long and it was built by hand, for years, with stone from the valley."
MORE = "It is not as far as it was, and the people that have to go there by foot are on the road for an hour at the most, or for two in winter."


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><style>p{{}}</style><script>var x = '</p><p>no';</script></head><body>{body}"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("", ""),
        (f"<p>{PROSE}</p>", PROSE),
        # What surrounds an article goes, however much it reads like prose.
        (f"<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title</h1><p>{PROSE}</article><footer>{MORE}</footer>", f"Title {PROSE}"),
        (f"<header><p>{MORE}</p></header><div class='side-bar sidebar'>{MORE}</div><article><p>{PROSE}</p></article><aside>{MORE}</aside>", PROSE),
        (f"<div id=cookieNotice>{MORE}</div><div class='ad'>{MORE}</div><article>{PROSE}</article><form>{MORE}<input value='<p>'></form>", PROSE),
        (f"<main><article>{PROSE}</article><section id='comments'><article class='comment'><p>{MORE}</p></article></section></main>", PROSE),
        (f"<body class='has-sidebar no-menu'><div class=content><p>{PROSE}</p><p>{MORE}</p></div>", f"{PROSE} {MORE}"),
        # Short blocks of an article stay; so do blocks without any stop word.
        ("<article><p>Of.</p></article><footer>x</footer>", "Of."),
        (f"<article><p>{'qwx | ' * 60}</p><p>Of.<p>a<br>b</article>", " ".join(("qwx | " * 60).split()) + " Of. a b"),
        (f"<article><header><h1>Title</h1><p>By someone</p></header><p>{PROSE}</p><footer>Filed under</footer></article>", f"Title {PROSE}"),
        # Lists of links within the article go, links within prose stay.
        (f"<article><p>{PROSE} <a href=x>Read</a></p><ul><li><a href=1>One thing</a><li><a href=2>Other</a></ul></article>", f"{PROSE} Read"),
        # Without any element for the article the rules decide, and short blocks follow their neighbours.
        (f"<div><a href=1>One</a> <a href=2>Two</a></div><h1>Title</h1><div>{PROSE}</div><div>Short.</div><div>{MORE}</div><div>© 2020 Someone</div>", f"Title {PROSE} Short. {MORE}"),
        # References, comments, broken markup.
        ("<article>a &amp;&lt;b&gt; &#233;&eacute;&nbsp;c &am &amp<!-- <p>no --> 1 < 2 <3 d</article>", "a &<b> éé c &am & 1 < 2 <3 d"),
        ("<article><p title='a > b' class=x>one<P>two</b></i></div> three<unknown>four</unknown></article>", "one two threefour"),
        (f"<nav><ul><li><a href=1>Never closed</a><article><p>{PROSE}", PROSE),
        ("<article><p>cut off <b", "cut off"),
        ("<article>日本語の記事です。</article>", "日本語の記事です。"),
        ("<article><p>in\n\tside \x0b it</p></article><p hidden>x</p><div style='display: none'>y</div>", "in side it"),
    ],
)
def test_main_text(body, text):
    assert html_text.main_text(page(body)) == text


def test_close_tags_in_any_number_stay_linear():
    deep = "<div><b>" * 20_000 + "x" + "</i></p></span>" * 20_000 + "<li>" * 20_000
    assert "x" in html_text.main_text(deep)


def test_pages_of_the_table(spark):
    """Against a model that knows where the article of these pages stands."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r["page_id"]: r for r in html_text.op13_html_text(spark, DATA).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for row in rows:
        article = row["html"].split("<article>")[1].split("</article>")[0]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert (found[row["page_id"]]["text"], found[row["page_id"]]["n_chars"], found[row["page_id"]]["url"]) == (text, len(text), row["url"])


def test_odd_rows(spark):
    long_page = page("<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>")
    rows = [(1, "u", page(f"<p>{PROSE}")), (1, "u", page(f"<p>{PROSE}")), (None, None, None), (2, None, ""), (3, "v", " \n"), (4, "w", long_page)]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as `a.b`")
    found = html_text.extract(frame).collect()
    assert found[0].asDict() == found[1].asDict() == {"page_id": 1, "url": "u", "text": PROSE, "n_chars": len(PROSE)}
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in found[2:5]] == [(None, "", 0), (2, "", 0), (3, "", 0)]
    assert found[5]["text"] == " ".join([PROSE] * 20_000)
    assert html_text.extract(frame.limit(0)).count() == 0
