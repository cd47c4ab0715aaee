"""Pages where density has to decide, and pages where marks must not."""

from lodestone.llm import html as P

LONG = "The quick brown fox jumps over the lazy dog and runs into the deep green wood again."
ARTICLE = f"<p>{LONG}</p><p>{LONG} Twice.</p><p>{LONG} Thrice.</p>"
TEXT = f"{LONG}\n{LONG} Twice.\n{LONG} Thrice."


def everything(html):
    """All text of the body but for the cut elements: what there would be without densities."""
    page = P.Page(html)
    return "\n".join(P.block_texts(page.body, lambda x: False))


def test_density_decides_without_marks():
    html = f"<body><div><a href=a>one</a> <a href=b>two</a> <a href=c>three</a></div><div><span>Sign</span> <i>up</i> <b>now</b></div><div><div>{ARTICLE}</div></div><div><span>All</span> <span>rights</span> <span>ours</span></div></body>"
    assert P.main_text(html) == TEXT
    assert everything(html) != TEXT and "rights" in everything(html)


def test_a_mark_does_not_lose_the_article():
    for name in ("comment-free", "post share-text", "content with-sidebar", "post comments-open", "layout-menu", "social-article"):
        assert P.main_text(f"<body><div class='{name}'>{ARTICLE}</div></body>") == TEXT, name
        assert P.main_text(f"<body><nav>menu</nav><div id='{name}'><div>{ARTICLE}</div></div><div class=ad>buy this</div></body>") == TEXT, name


def test_a_form_around_the_page():
    assert P.main_text(f"<body><form id=aspnet><div>{ARTICLE}</div></form></body>") == TEXT
    assert P.main_text(f"<body><div>{ARTICLE}</div><form><p>Your name and your address, please, and your telephone number.</p></form></body>") == TEXT


def test_a_title_beside_the_article_and_bare_text():
    assert P.main_text(f"<body><div class=top><h1>Title</h1></div><div>{ARTICLE}</div></body>") == "Title\n" + TEXT
    assert P.main_text(f"<body>{LONG} Bare. <div>{ARTICLE}</div></body>") == f"{LONG} Bare.\n{TEXT}"


def test_marked_parts_go():
    comments = f"<div class=comments><div class=comment>A reader says {LONG.lower()}</div></div>"
    for html in (f"<body><div>{ARTICLE}<div class='share'>Share this page with others</div></div>{comments}</body>", f"<body><article>{ARTICLE}{comments}</article></body>", f"<body><div class=ad>Buy it now</div>{ARTICLE}<section id=comments>no!</section></body>"):
        assert P.main_text(html) == TEXT, html
    assert P.main_text(f"<body><div role=navigation>Go there</div>{ARTICLE}<div hidden>{LONG}</div><p aria-hidden='true'>x</p></body>") == TEXT


def test_odd_pages():
    assert [P.main_text(x) for x in (None, "", "<", "plain  text", "<script>if (a<b) {}", "<body></body>", "<p>", "</p></div>", "a<br>b &amp; c")] == ["", "", "<", "plain text", "", "", "", "", "a b & c"]
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert P.main_text(deep) == "deep text"


def test_hostile_tables(spark):
    rows = [(1, None, None, "a"), (1, "u", f"<body>{ARTICLE}</body>", "b"), (None, "u", "<p>x y z</p>", None), (1, "u", f"<body>{ARTICLE}</body>", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in P.extract(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (None, "u", "x y z", 5)], key=str)
    assert P.extract(df.limit(0)).count() == 0


def test_marks_on_all_of_the_text_count_for_nothing():
    assert P.main_text("<body><div class=social>just this text</div></body>") == "just this text"
    assert P.main_text(f"<body><p>{LONG}</p><div>{ARTICLE}</div></body>") == f"{LONG}\n{TEXT}"


PARTS = "".join(f"<p>{LONG} Part {k}.</p>" for k in range(8))
PART_TEXTS = "\n".join(f"{LONG} Part {k}." for k in range(8))


def test_short_parts_of_a_nested_article_stay():
    assert P.main_text(f"<body><article><section>{PARTS}</section><section><h2>Note</h2><p>Short closing line.</p></section></article></body>") == PART_TEXTS + "\nNote\nShort closing line."
    assert P.main_text(f"<body><nav>x</nav><article><p>standfirst</p><div>{PARTS}</div><p>Reporting by A. B.</p></article><aside>more</aside></body>") == f"standfirst\n{PART_TEXTS}\nReporting by A. B."
    assert P.main_text(f"<body><div id=x><h1><a href=t>Title</a></h1><div>{PARTS}</div><p>The end.</p></div><div class=ad>Buy</div></body>") == f"Title\n{PART_TEXTS}\nThe end."


def test_marked_sentences_and_linked_sources_of_an_article_stay():
    inside = f"{PARTS}<p class='notice'>{LONG} Noted.</p><ul><li><a href=1>One source</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul>"
    want = f"{PART_TEXTS}\n{LONG} Noted.\nOne source\nTwo\nThree"
    assert P.main_text(f"<body><article>{inside}</article></body>") == want
    assert P.main_text(f"<body><article><div>{inside}</div></article><ul><li><a href=1>a</a></li><li><a href=2>b</a></li><li><a href=3>c</a></li></ul></body>") == want
    assert P.main_text(f"<body><article>{PARTS}<p class='share'>Share</p><div class='related-links'><a href=x>Other</a></div></article></body>") == PART_TEXTS


def test_neighbours_that_are_no_prose_go():
    assert P.main_text(f"<body><div>{PARTS}</div><div><span>All</span> <span>rights</span> <span>ours</span></div></body>") == PART_TEXTS
    assert P.main_text(f"<body><div>{PARTS}</div><div><a href=a>Home</a></div></body>") == PART_TEXTS


def test_hostile_pages_take_linear_time():
    from time import process_time

    def took(make, n):
        t = process_time()
        P.main_text(make(n))
        return process_time() - t

    pages = {
        "forms": lambda n: "<form><p>x y z</p></form>" * n,
        "unmatched ends": lambda n: "<b>" * n + "</q>" * n,
        "blocks under inline": lambda n: "<p><select>" + "<b>" * n + "<h1></h1>" * n,
        "items under inline": lambda n: "<ul>" + "<b>" * n + "<li>x" * n,
        "cells": lambda n: "<table>" + "<tr><td>a<th>b" * n,
        "deep": lambda n: "<div>" * n + "text " * n + "</div>" * n,
        "signs": lambda n: "<" * n + "&amp" * n,
        "marked": lambda n: f"<div>{'<p class=ad>some words here</p><p>and some more words</p>' * n}</div>",
    }
    for name, make in pages.items():
        small, large = (min(took(make, n) for _ in range(2)) for n in (5_000, 40_000))
        assert large < 20 * small + 0.2, (name, small, large)  # 64 times would be quadratic
    t = process_time()
    P.main_text(("<form>" + "<b>" * 40 + "</q>" * 40 + "word " * 20) * 13_000)  # 5 MB
    assert process_time() - t < 30
