"""Names that articles have too, votes against a page's own best, tied votes, hosts joined by a shuffle."""

import pytest

from recollect.llm import common, html

T = "A long sentence about the matter at hand, which goes on for quite a while and says something. " * 4
SHAPES = [
    (f"<article><p>{T}</p><section id='discussion'><h2>Discussion</h2><p>{T}</p></section></article>", f"{T}Discussion {T}"),
    (f"<article><h1 id='search'>Search engines</h1><p>{T}</p><h2 id='related' class='share'>Related work</h2><p>{T}</p></article>", f"Search engines {T}Related work {T}"),
    (f"<article><p>{T}</p><div class='market-share'><p>{T}</p></div><div class='post-share'><a href=x>Tweet</a></div></article>", T + T),
    (f"<article><div class='article-header'><h1>Title</h1><p>Lead.</p></div><p>{T}</p></article>", f"Title Lead. {T}"),
    (f"<article><p>{T}</p><section class='responses'><p>{T}</p></section><section id='comments'><p>{T}</p></section></article>", T),
    (f"<article><p>{T}</p><div class='site-search'>Find <a href=x>all</a></div><section id='related'><a href=x>{T}</a></section></article>", T),
    (f"<body><div class='story'><p>{T}</p></div><div class='reader-discussion'><div class='inner'><a href=x>{T}</a></div></div></body>", T),
    (f"<article><p>{T}</p><section id='search'><div class='related'>{T}</div>{T}</section></article>", T + T),
]


@pytest.mark.parametrize("page, text", SHAPES)
def test_names_that_articles_have_too(page, text):
    assert html.Page(page).along(None) == text.strip()


def test_winning_paths_hold_where_their_text_is_worth_a_share():
    page = f"<body><div class='x'><div class='summary'>Hi.</div></div><div class='y'><div class='story'><p>{T * 5}</p></div></div></body>"
    path = next(p for p in html.Page(page).path if p.endswith("summary"))
    assert html.Page(page).along([path]) == (T * 5).strip()
    short = page.replace("Hi.", T)
    assert html.Page(short).along([path]) == T.strip() and html.Page(page).along(["nowhere"]) == (T * 5).strip()


def test_tied_votes_and_hosts_joined_by_a_shuffle(spark, monkeypatch):
    one, other = (f"<div class='{c}'><p>{T}</p></div>" for c in ("one", "other"))
    mixed = f"<div class='a'>{one}</div><div class='b'>{other.replace(T, T + 'End.')}</div>"
    rows = [(i, f"http://h{i % 3}.net/{i}", h) for i, h in enumerate([one, other, mixed] * 4)] + [(90, None, None), (91, "http://h0.net/x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, html.extract(df.repartition(5)).collect()))
    monkeypatch.setattr(common, "SMALL_BYTES", 0)
    assert sorted(map(tuple, html.extract(df).collect())) == got and len(got) == 14
    tied = spark.createDataFrame([(i, "http://t.net/", h) for i, h in enumerate([one, other])] + [(2, "http://t.net/", f"<div>{one}{other}</div>")], "page_id long, url string, html string")
    for n in (1, 4):
        assert {r.page_id: r.text for r in html.extract(tied.repartition(n)).collect()} == {0: T.strip(), 1: T.strip(), 2: (T + T).strip()}
