"""Frames and landmarks of pages, and articles whose paragraphs many pages share."""

from __future__ import annotations

import pytest

from pairtide.llm import html

TEXT = "<h1>T</h1><p>body</p>"


def kept(page):
    return [text for kind, text in html.blocks(page) if kind != html.FRAME]


@pytest.mark.parametrize("page", [
    f"<form id=aspnetForm><div><article>{TEXT}</article></div><p>x</p></form>",
    f"<form><main>{TEXT}</main></form>",
    f"<nav><ul><li>home<article>{TEXT}</article>",
    f"<header><div>site<main>{TEXT}</main></div>",
    f"<div class=comment><article>{TEXT}</article></div>",
    f"<aside><main>{TEXT}</main></aside>",
    f"<div role=form><div role=main>{TEXT}</div></div>",
    f"<div class=header>menu</div><div id=header>m</div><div class='page-header'>m</div><div class=topbar>m</div><article>{TEXT}</article>",
    f"<article><p class=advert>buy</p><p class='cookie-notice'>c</p>{TEXT}</article>",
    f"<main>{TEXT}<article class=comment><p>me too</p></article><div class='comment-thread'><p>c</p></div></main>",
    f"<article><div class=header><h1>T</h1></div><p>body</p></article>",
    f"<article class='post share'>{TEXT}</article><aside><article>teaser</article></aside>",
])
def test_frames_and_landmarks(page):
    assert kept(page) == ["T", "body"]


def test_what_names_do_not_decide():
    assert kept("<article><table class=share><tr><td>price</td></tr></table></article>") == ["price"]
    assert kept("<div class=comment><p>whole page</p></div>") == ["whole page"]
    assert kept("<nav>menu</nav><footer>f</footer>") == []
    assert kept("<article><p>a</p><form><p>mail</p></form><nav>n</nav><p>b</p></article>") == ["a", "b"]


def test_shared_paragraphs_of_articles_stay(spark):
    """A paragraph that a third of a host's articles quote is article text; a line under most of them is not."""
    words = lambda seed, n: " ".join(f"w{seed}x{k}" for k in range(n))
    pages = []
    for i in range(30):
        quote = f"<p>{words('quote', 20)}</p>" if i % 3 == 0 else ""
        line = f"<p>{words('line', 10)}</p>" if i % 4 else ""
        pages.append((i, "http://a.example/", f"<nav>{words('nav', 9)}</nav><article><p>{words(i, 30)}</p>{quote}{line}</article>"))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: words(i, 30) + ("\n\n" + words("quote", 20) if i % 3 == 0 else "") for i in range(30)}
