import html
import random
import re

import numpy as np
import pytest

from mlwatch.llm import main_text as module
from mlwatch.llm.main_text import extract, main_text

ARTICLE = "<p>First paragraph of the text, which is long enough.</p><p>Second, also long; and it has words.</p>"
TEXT = "First paragraph of the text, which is long enough.\nSecond, also long; and it has words."


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("", ""),
        ("<html></html>", ""),
        ("<!-- only -->", ""),
        ("plain text only", "plain text only"),
        ("a &lt; b &amp; c&eacute;", "a < b & cé"),
        ("<p>one<p>two", "one\ntwo"),
        ("<p>a\n\t b&nbsp;c<br>d</p>", "a b c d"),
        (f"<body><nav><a href=/>Home</a></nav>{ARTICLE}<footer>foot</footer></body>", TEXT),
        (f"<header><h2>Site</h2></header><main>{ARTICLE}</main><aside>Read this, too, now.</aside>", TEXT),
        (f"<div class='cookie-notice'>We use cookies, as all do.</div><div class=content>{ARTICLE}</div>", TEXT),
        (f"<article><header><h1>Title</h1></header>{ARTICLE}<script>x('<p>no</p>')</script></article>", f"Title\n{TEXT}"),
        (f"<article>{ARTICLE}</article><section id=comments><p>I disagree, sir, with all of it.</p></section>", TEXT),
        (f"<article>{ARTICLE}<form><input><button>Send</button> it, please</form></article>", TEXT),
        (f"<div><div class=ad>Buy, buy, buy!</div><div id=main-text>{ARTICLE}</div></div>", TEXT),
        ("<article><p>unclosed <b>bold<br><p>next</p></article><footer>f", "unclosed bold\nnext"),
        ("<p>x < y and 1<2</p>", "x < y and 1<2"),
    ],
)
def test_main_text(page, expected):
    assert main_text(page) == expected


LONG = "A listing of many words, one after the other; and so on. " * 40


@pytest.mark.parametrize("dominant", ["<pre>{}</pre>", "<table><tr><td>{}</table>", "<section><p>{}</p></section>", "<blockquote>{}</blockquote>"])
@pytest.mark.parametrize("page", ["<div>{}</div>", "<body>{}</body>", "<div><div>{}</div></div>"])
def test_a_long_part_is_not_the_whole_text(page, dominant):
    body = f"<h1>Title</h1><p>An intro.</p>{dominant.format(LONG)}<p>An outro.</p>"
    assert main_text(page.format(body)) == f"Title\nAn intro.\n{LONG.strip()}\nAn outro."


def test_titles_and_selected_blocks_outside_the_longest_container_stay():
    page = f"<div id=content><h1>Title</h1><div class=text><p>{LONG}</p><p>{LONG}</p></div></div>"
    assert main_text(page) == f"Title\n{LONG.strip()}\n{LONG.strip()}"
    parts = [f"<div><p>{LONG * 9}</p></div>", f"<div><p>{LONG}</p></div>"]
    for order in (parts, parts[::-1]):
        assert main_text("".join(order)) == "\n".join(re.sub("<.*?>", "", x).strip() for x in order)


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout no-sidebar'>{}</div>",
        "<div id=page class='has-banner'><div class=ad>Buy, buy, buy!</div><article>{}</article></div>",
        "<div class='related-work'>{}</div>",
        "<form action=/><div class=menu>Go, now.</div><div>{}</div></form>",
        "<div class=sidebar><div class=widget>{}</div></div>",
        "<form><main>{}</main></form><form><p>Send, please.</p></form>",
    ],
)
def test_wrappers_named_like_asides_keep_their_text(page):
    assert main_text(page.format(ARTICLE)) == TEXT


def test_words_of_inline_elements_stay_in_their_paragraph():
    page = "<p>The <span class='search-term'>second</span> word, and <b class=promo>more</b>.</p>"
    assert main_text(page) == "The second word, and more."
    assert main_text(f"{page}<p><span class=share>Share this, now.</span></p>") == "The second word, and more."
    assert main_text(f"{page}<div hidden>Unseen, here.</div>") == "The second word, and more."


def test_whole_articles_of_the_pages_table(spark, sf):
    for row in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        clean = [" ".join(html.unescape(b).split()) for b in blocks]
        assert main_text(row.html) == "\n".join(b for b in clean if b)


def test_long_and_deep_pages():
    assert main_text("<div>" * 20_000 + "deep text" + "</div>" * 20_000) == "deep text"
    assert main_text("<p>" + "word " * 200_000) == " ".join(["word"] * 200_000)
    assert main_text("<" * 50_000) == "<" * 50_000


def test_rows_of_any_kind(spark):
    rows = [(1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (None, None, None, "y")]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted(map(str, found.collect())) == sorted(
        ["Row(page_id=1, url='u', text='a')"] * 2 + ["Row(page_id=None, url=None, text='')"]
    )
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


REMARKS = "<p>I disagree, sir, with all of it; and here is why, at length, point by point.</p>" * 30


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{ARTICLE}<section id=comments>{REMARKS}</section></article>",
        f"<article>{ARTICLE}</article><div class=comments>{REMARKS}</div>",
        f"<article>{ARTICLE * 9}</article><div class=reply-list>{REMARKS}</div>",
        f"<article>{ARTICLE * 9}</article><div class=voices>{REMARKS}</div>",
        f"<div>{ARTICLE}</div><div class=comments>{REMARKS}</div>",
        f"<article>{ARTICLE}</article><section class=comments><article>{REMARKS}</article></section>",
        f"<div>{ARTICLE}</div><form>{REMARKS}</form><div class='advert'>{REMARKS}</div>",
    ],
)
def test_remarks_go_however_long_they_are(page):
    assert main_text(page) == "\n".join([TEXT] * (9 if "reply-list" in page or "voices" in page else 1))


@pytest.mark.parametrize("attribute", ["title='a hidden gem'", "data-hidden=false", "data-id=menu", "title='x class=ad'"])
def test_only_whole_attributes_count(attribute):
    assert main_text(f"<p>One, two.</p><p {attribute}>Three, four.</p>") == "One, two.\nThree, four."
    assert main_text(f"<p>One, two.</p><p hidden {attribute}>Three, four.</p>") == "One, two."


def test_two_articles_are_both_returned():
    assert main_text(f"<article>{ARTICLE}</article><p>Aside.</p><article>{ARTICLE}</article>") == f"{TEXT}\n{TEXT}"


def test_the_ratios_decide(spark, sf, monkeypatch):
    """With a coin toss per path in place of the thresholded ratios, pages come out otherwise."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    texts = [main_text(p) for p in pages]
    rng = random.Random(1)

    def toss(page):
        coins = {b[2]: rng.random() < 0.5 for b in page.blocks}
        return np.array([coins[b[2]] for b in page.blocks])

    monkeypatch.setattr(module, "selected", toss)
    assert sum(a != main_text(p) for a, p in zip(texts, pages)) > len(pages) / 10
