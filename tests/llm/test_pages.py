"""Main text of pages in layouts that the training pages don't have, by the F1 of words."""

from collections import Counter

import pytest

from termloom.llm import html_text

SF = "/root/testdata/sf0.001"

ONE = "The river rose through the night, and by morning the lower fields were under water as far as the mill road."
TWO = "Nobody had seen it so high since the old bridge was carried off; the older people still speak of that winter."
THREE = "In the afternoon the rain stopped, the wind turned, and the first boats went out to look for the cattle."
STORY = f"{ONE} {TWO} {THREE}"
P = f"<p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
NAV = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li><li><a href='/w'>Weather</a></li></ul>"
SAID = "".join(f"<div class='note'><b>{who}</b><p>{what}</p></div>" for who, what in (("Ann", "I was there and it was worse than that."), ("Bob", "Nonsense, it was over by noon."), ("Cy", "Thanks for the report!")))
LAYOUTS = {
    "article": f"<html><body><nav>{NAV}</nav><article>{P}</article><footer>Copyright 2020 The Paper</footer></body></html>",
    "plain_div": f"<html><body><div>{P}</div></body></html>",
    "story_more": f"<html><body><nav>{NAV}</nav><main><div class='story-more'>{P}</div></main></body></html>",
    "classed_div": f"<html><body><div class='menu'>{NAV}</div><div class='post-content'>{P}</div><div class='footer'>Copyright 2020</div></body></html>",
    "user_notes": f"<html><body><nav>{NAV}</nav><article>{P}<div class='user-notes'>{SAID}</div></article></body></html>",
    "comments_after": f"<html><body><article>{P}</article><section class='comments'><h2>3 comments</h2>{SAID}</section></body></html>",
    "open_quote": f"<html><body><nav>{NAV}</nav><article><p class=\"x>{ONE}</p><p class=\"y\">{TWO}</p><p>{THREE}</p></article></body></html>",
    "strange_names": f"<html><body><div class='kolu'>{NAV}</div><div id='tapi'>{P}</div><div class='copyright'>Copyright 2020 The Paper</div></body></html>",
    "body_alone": f"<html><body>{P}</body></html>",
    "advert_inside": f"<html><body><article><p>{ONE}</p><div class='advert'>Buy two umbrellas and get one free.</div><p>{TWO}</p><p>{THREE}</p></article></body></html>",
    "notice_sidebar": f"<html><body><div class='cookie-notice'><p>We use cookies to make this page better.</p></div><div id='main'>{P}</div><div class='sidebar'><h3>Popular</h3>{NAV}</div></body></html>",
    "form": f"<html><body><main>{P}<form class='newsletter'><label>Your mail</label><input name='m'><p>Sign up for our letter.</p></form></main></body></html>",
}


def f1(got: str, wanted: str) -> float:
    a, b = Counter(got.split()), Counter(wanted.split())
    both = sum((a & b).values())
    return 2 * both / (sum(a.values()) + sum(b.values())) if both else 0.0


@pytest.fixture(scope="module")
def forest(spark):
    return html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def scores(spark, forest) -> dict[str, float]:
    made = spark.createDataFrame([(k, name, html) for k, (name, html) in enumerate(LAYOUTS.items())], "page_id bigint, url string, html string")
    return {r["url"]: f1(r["text"], STORY) for r in html_text.extracted(made, forest).collect()}


def test_layouts(spark, forest):
    found = scores(spark, forest)
    assert min(found.values()) >= 0.9 and sum(found.values()) / len(found) >= 0.97, found


def test_markup_never_leaks(forest):
    page = html_text.Page(LAYOUTS["open_quote"])
    assert not any("class" in text or "<" in text for _, text, _ in page.pieces)


def test_pages_without_articles_are_learned_from_made_up_ones(spark):
    pages = spark.createDataFrame([(k, None, f"<div class='menu'>{NAV}</div><div>{P}</div>") for k in range(3)], "page_id bigint, url string, html string")
    texts = [r["text"] for r in html_text.extracted(pages, html_text.fit(pages)).collect()]
    assert texts == [STORY] * 3
    assert html_text.fit(pages.limit(0)) is None


def test_articles_of_the_table_are_whole(spark, forest):
    """Pages of the table: the text is that of the article, block by block, as a plain parser gives it."""
    import html as html_lib
    import re

    rows = html_text.extracted(spark.read.parquet(f"{SF}/pages.parquet"), forest).collect()
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    equal = 0
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", sources[r["page_id"]] or "", re.S)
        inline = re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", inner[1]) if inner else ""
        equal += r["text"] == " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", inline)).split())
    assert equal >= 0.98 * len(rows)
