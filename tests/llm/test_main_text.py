from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolloom.llm.main_text import Block, extract, main_blocks, parse, path_values

LONG = "The committee met on Tuesday, heard three reports, and agreed to publish its findings before the end of May."
MORE = "Members asked for figures; none were at hand, so the chair promised them by post, with a note on method."


def test_named_surroundings_and_short_blocks():
    page = f"""<html><head><title>T | Site</title><style>p{{}}</style></head><body class="has-sidebar">
    <header id="top"><a href="/">Site</a><p>Slogan of the site, quite long, with commas, and more words than the article has.</p></header>
    <div id="main-menu"><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></div>
    <div class="wrapper"><div class="post-body"><h1>The  title &amp; more</h1>
      <p>{LONG}<br>After a break.</p><h2>Part</h2><ul><li>one<li>two</ul><p>Ok.</p><blockquote>{MORE}</blockquote>
      <div class="advert">Buy now, buy cheap, buy today, and buy again tomorrow, says this advert!</div><p>{MORE}</p></div>
    <aside><p>{LONG} {LONG}</p></aside>
    <div class="comment-list"><div class="comment"><p>{LONG} I disagree, strongly, with all of it!</p></div></div></div>
    <div class="cookieNotice">We use cookies, and more cookies, to make this site work, and to count you.</div>
    <form><p>Your name, please, and your address, so that we can write to you:</p><input></form>
    <footer>&copy; 2020, all rights reserved, by the owners of this site.</footer><script>var a = "<p>no</p>";</script></body></html>"""
    assert main_blocks(page) == ["The title & more", f"{LONG} After a break.", "Part", "one", "two", "Ok.", MORE, MORE]


def test_page_without_any_names():
    links = "".join(f"<li><a href=/{i}>Some link {i}</a></li>" for i in range(12))
    page = f"<body><ul>{links}</ul><table><tr><td><p>{LONG}<p>{MORE}<p>{LONG}<td>Short<tr><td>Tail</table>"
    assert main_blocks(page) == [LONG, MORE, LONG]


def test_article_among_unnamed_lists():
    links = "".join(f"<li><a href=/{i}>Some link {i}</a></li>" for i in range(30))
    page = f"<div><div><ul>{links}</ul></div><article><h1>Of</h1><p>{LONG}</p><p>Is.</p></article><div><ul>{links}</ul></div></div>"
    assert main_blocks(page) == ["Of", LONG, "Is."]


def test_very_short_articles():
    page = "<nav><a href=/x>The menu of this page</a></nav><div class=ad>A long advert, with words.</div><article><h1>{}</h1><p>{}</p></article>"
    assert main_blocks(page.format("Of", "Of")) == ["Of", "Of"]
    assert main_blocks(page.format("", " &nbsp; ")) == []


def test_a_frame_with_a_telling_name_is_still_the_frame():
    page = f"<form class='search-page'><main><h1>Title</h1><p>{LONG}</p><p>{MORE}</p></main></form><div class=comments><p>{LONG}</p></div>"
    assert main_blocks(page) == ["Title", LONG, MORE]


def test_comments_longer_than_the_article():
    page = f"<main><article><h1>T</h1><p>{LONG}</p></article><section id=comments>" + f"<article class=reply><p>{MORE}</p></article>" * 40
    assert main_blocks(page) == ["T", LONG]


def test_broken_markup():
    assert main_blocks(f"<article><p>{LONG}</div></b><p class='x>y'>{MORE}") == [LONG, MORE]
    assert main_blocks(f"<article><p><b>{LONG}<br><p>{MORE}</b></i></article></article>") == [LONG, MORE]
    assert main_blocks(f"<article>{LONG}<script>if (a < b) '</p>'; <p>never closed {MORE}") == [LONG]
    assert main_blocks(f"<article>{LONG}<!-- <p>{MORE}</p>") == [LONG]
    assert main_blocks(f"<p title='a > b'>{LONG}</p><p data-x=\"'\">{MORE}<") == [LONG, MORE + "<"]
    assert main_blocks("a < b and b > c, 1 <2 &lt;p&gt; &#233;&#x1F600; &eacute;t&eacute; &am &amp") == ["a < b and b > c, 1 <2 <p> é😀 été &am &"]


def test_whitespace_and_references():
    page = "<article><p>\n a&nbsp;\tb c <i>d</i>e<b> f</b></p>g<p></p><p> </p><pre>x\n  y</pre></article>"
    assert main_blocks(page) == ["a b c de f", "g", "x y"]


def test_edges(rows):
    data = [
        (1, "u", None, "x", 9), (2, None, "", "x", 9), (None, "u", "<article><p>Hi</p></article>", "x", 9), (3, "u", "no tags", "x", 9),
        (3, "u", "no tags", "x", 9), (4, "u", "<article>" + f"<p>{LONG}</p>" * 20000, "x", 9), (5, "u", "<script>", None, None),
        (6, "u", "<div>" * 30000 + LONG, "x", 9),
    ]
    df = rows("page_id long, url string, html string, text string, n_chars int", data)
    found = extract(df, "html", ["page_id", "url"])
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    expected = ["", "", "Hi", "no tags", "no tags", "\n".join([LONG] * 20000), "", LONG]
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in found.collect()] == [
        (i, u, t, len(t)) for (i, u, *_), t in zip(data, expected)
    ]
    assert extract(rows("page_id long, html string", []), "html", ["page_id"]).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.text("x., ", min_size=1, max_size=12), st.integers(0, 3)), min_size=1, max_size=9))
def test_path_values_against_plain_loops(rows):
    blocks = [Block(0, text, min(linked, len(text))) for _, text, linked in rows]
    paths = [path for path, _, _ in rows]
    ratio = {}
    for path in set(paths):
        own = [b for p, b in zip(paths, blocks) if p == path]
        length = sum(len(b.text) - b.linked for b in own) / len(own)
        ratio[path] = length * (1 + sum(b.text.count(".") + b.text.count(",") for b in own) / len(own))
    smooth = defaultdict(list)
    for i, path in enumerate(paths):
        near = [(np.exp(-((i - j) ** 2) / 2), ratio[paths[j]]) for j in range(max(0, i - 2), min(len(paths), i + 3))]
        smooth[path].append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    assert path_values(paths, blocks) == pytest.approx({p: sum(v) / len(v) for p, v in smooth.items()})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<a href=x>", "</a>", "<table>", "<td>", "<tr>", "</table>", "<li>",
    "<!--", "-->", "<br>", "x y.", " ", "<article>", "</article>", "<h1>", "<svg/>", "<script>", "</script>", "<b", "='", '="', ">"]), max_size=25))
def test_any_markup_is_read(parts):
    page = "".join(parts)
    elements, blocks = parse(page)
    assert all(b.text == " ".join(b.text.split()) and b.text for b in blocks)
    assert all(e.parent < i for i, e in enumerate(elements))
    main_blocks(page)
