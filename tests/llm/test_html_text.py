import time

import pytest

from flowlake.llm.html_text import Blocks, extract, main_text, path_scores

PARAGRAPHS = ["First paragraph, with some words; and a few more. It goes on, and on, for a while.",
              "Second one &amp; more: caf&eacute; &#8364; 5, as it was said. Nobody knows, but it is so.",
              "Third, the last of them. It has an end, and this is it."]
PLAIN = [PARAGRAPHS[0], "Second one & more: café € 5, as it was said. Nobody knows, but it is so.", PARAGRAPHS[2]]
NOISE = ["<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News, sports, and more.</a></li></ul></nav>",
         "<header><h2>The Daily Site. All of the news, every day.</h2></header>",
         "<div class='ad'>" + "Buy this now, it is cheap. It is good, too, they say. " * 3 + "</div>",
         "<div class='cookie-notice'>We use cookies, and so on. Please accept them all, now.</div>",
         "<aside>Also read: this, that, and the other story. It is long, too.</aside>",
         "<form>Your name, please: <input><textarea>nothing</textarea></form>",
         "<script>var a = '<p>not, text.</p>';</script><style>p { margin: 0 }</style>",
         "<section id='comments'><h3>Comments</h3><p>Great story, really. I liked it, a lot. Thanks, for all of it.</p></section>",
         "<footer><p>Copyright, by somebody. All rights reserved, as always.</p></footer>"]


def page(body):
    return f"<!DOCTYPE html><html><head><title>t, t.</title></head><body>{body}</body></html>"


@pytest.mark.parametrize("box", ["article", "main", "div", "div class='post-content'", "section"])
def test_article_without_noise(box):
    text = "<h1>A  title\nhere</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    tag = box.split()[0]
    html = page("".join(NOISE[:7]) + f"<{box}>{text}</{tag}>" + "".join(NOISE[7:]))
    assert main_text(html) == "\n\n".join(["A title here", *PLAIN])


def test_one_paragraph_that_outweighs_the_rest_keeps_its_neighbours():
    html = page(f"<article><h1>Title</h1><p>{PARAGRAPHS[0] * 30}</p><p>Short.</p><ul><li>One</li><li>Two</li></ul></article>{NOISE[8]}")
    assert main_text(html).split("\n\n") == ["Title", PARAGRAPHS[0] * 30, "Short.", "One", "Two"]


def test_broken_markup():
    assert main_text(page(f"<article><p><b>{PARAGRAPHS[0]}<br><p>{PARAGRAPHS[2]}</article>")).split("\n\n") == [PLAIN[0], PLAIN[2]]
    assert main_text("<article><p>cut &am") == "cut &am"
    assert main_text("<article><p>cut &amp") == "cut &"
    assert main_text("<article><p>a <!-- never closed") in ("a", "a <!-- never closed", "a\n\n<!-- never closed")
    assert main_text("</div></p>just words <3 here") == "just words <3 here"
    assert main_text("<p>a \n b<i>c</i>d</p>") == "a bcd"
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<script>x</script>") == ""


@pytest.mark.parametrize("start", ["<body>", "<body><div>", "", "<div>", "<script>x</script></noscript><body>"])
def test_pages_without_end_of_head(start):
    text = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    html = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>t, t.</title><style>p {{}}</style>{start}<article>{text}</article></html>"
    assert main_text(html) == "\n\n".join(PLAIN)
    assert main_text("<head><title>t</title>bare text, of a page") == "bare text, of a page"


@pytest.mark.parametrize("tag", ["object", "audio", "video", "button", "canvas"])
def test_hidden_elements_without_end(tag):
    text = "".join(f"<p>{p}</p>" for p in PARAGRAPHS[1:])
    for after in ("</article></body></html>", ""):
        assert main_text(f"<html><body><article><p>{PARAGRAPHS[0]}</p><{tag} id=x>{text}{after}") == "\n\n".join(PLAIN)
    assert main_text(f"<article><p>{PARAGRAPHS[0]}</p><{tag}>not, seen.</{tag}>{text}</article>") == "\n\n".join(PLAIN)


@pytest.mark.parametrize("box", [
    "div class='content has-sidebar'", "div class='layout-no-sidebar'", "div class='with-comments'", "div class='page-with-banner'",
    "section class='notice-board'", "div id='sidebar-left-off'", "div class='social'"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_names_do_not_veto_what_holds_the_article(box, inner):
    text = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    html = page(f"{NOISE[0]}<{box}><{inner}>{text}</{inner}></{box.split()[0]}>{NOISE[3]}{NOISE[8]}")
    assert main_text(html) == "\n\n".join(PLAIN)


def test_title_in_an_article_header_is_kept():
    text = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    html = page(f"<article><div class='article-header'><h1>The title</h1></div>{text}<div class='share'>Share, it. Now.</div></article>")
    assert main_text(html) == "\n\n".join(["The title", *PLAIN])


def test_long_comments_beside_an_article_are_left_out():
    text, comment = "".join(f"<p>{p}</p>" for p in PARAGRAPHS), "<article><p>Great story, really. I liked it, a lot.</p></article>"
    html = page(f"<article>{text}</article><section id='comments'>{comment * 40}</section>")
    assert main_text(html) == "\n\n".join(PLAIN)


def test_table_of_pages(spark):
    long = page("<article>" + f"<p>{PARAGRAPHS[0]}</p>" * 3000 + "</article>")
    rows = [(1, "u", page(f"<article><p>{PARAGRAPHS[0]}</p></article>"), "clash"), (2, None, None, "c"), (None, "u", "", "c"), (3, "u", long, "c")]
    got = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, score string")).collect()
    of = {r["page_id"]: r["text"] for r in got}
    assert of[1] == PLAIN[0] and of[2] == of[None] == "" and of[3] == "\n\n".join([PLAIN[0]] * 3000) and "score" in got[0]
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(5)) + "</ul>"


@pytest.mark.parametrize("body", ["{links}{text}<p>Copyright 2024 by somebody</p>",
                                  "<div>Home | World | Sport</div>{text}<div>Copyright 2024 by somebody</div>",
                                  "<div id=content>{text}{links}</div>",
                                  "<table><tr><td>Home<br>News<br>Sport</td><td>{text}</td></tr></table>"])
def test_unmarked_menus_and_footers_go_by_their_ratios(body):
    text = "".join(f"<p>{p}</p>" for p in PARAGRAPHS + PARAGRAPHS[:1])
    assert main_text(page(body.format(links=LINKS, text=text))).split("\n\n") == PLAIN + PLAIN[:1]


def test_ratios_of_paths_equal_plain_sums():
    parser = Blocks()
    parser.feed(page("<div><p>One, two.</p><p>Three; four, five.</p></div><ul><li><a href=x>link text</a> and more</li></ul>"))
    parser.finish()
    by_path = {}
    for b in parser.blocks:
        labels, e = [], b.element
        while e.number:
            labels.append(e.label)
            e = e.above
        by_path.setdefault(tuple(reversed(labels)), []).append(b)
    assert set(by_path) == {("html", "body", "div", "p"), ("html", "body", "ul", "li")}
    raw = path_scores(parser.blocks)[1]
    for blocks in by_path.values():
        text = sum(max(0, len(b.text) - 2 * b.links) for b in blocks) / len(blocks)
        marks = sum(b.text.count(c) for b in blocks for c in ".,;") / len(blocks)
        assert all(raw[parser.blocks.index(b)] == pytest.approx((text * (1 + marks)) ** 0.5) for b in blocks)


@pytest.mark.parametrize("tag", ["div", "object", "p", "li", "article", "h1", "td", "section class=ad"])
def test_depth_costs_no_more_than_length(tag):
    start = time.time()
    assert main_text(f"<{tag}>" * 20_000 + "text, and more.") in ("text, and more.", "")
    main_text((f"<{tag}> w, ") * 20_000 + "</x></div>" * 1000)
    assert time.time() - start < 10  # about a second; the square of the depth would take minutes
