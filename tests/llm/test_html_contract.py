"""Main text by its contract: comments, inline elements, menus, depth; and generated pages whose text is known."""

import random
import time

import pytest

from labeltrail.llm.html_text import main_text

_TEXT = "The long article text goes on with many words. " * 6
_BODY = f"<p>{_TEXT}</p>"
_COMMENT = "<p>" + "A reader says that this is all wrong and more. " * 12 + "</p>"


@pytest.mark.parametrize("html", [
    f"<main><article>{_BODY}</article><section id='comments'>{_COMMENT}{_COMMENT}</section></main>",
    f"<article>{_BODY}<div class='comments'>{_COMMENT}{_COMMENT}</div></article>",
    f"<main><article>{_BODY}</article><section class='comments'><article class='comment'>{_COMMENT}</article></section></main>",
    f"<div class='with-comments'><article>{_BODY}</article><div class='comment-list'>{_COMMENT}</div></div>",
    f"<body class='comments-open'><div>{_BODY}</div><div id='disqus_thread'>{_COMMENT}</div></body>",
    f"<body><ul><li><a href=/>Home</a></li><li><a>About us</a></li></ul><div>{_BODY}</div></body>",
])
def test_comments_and_menus_go(html):
    assert main_text(html) == _TEXT.strip()


@pytest.mark.parametrize("inside, text", [
    ("See the <a class='related-link'>earlier report</a> for more.", "See the earlier report for more."),
    ("a <span class='search-term'>b</span> c <a id='search'>d</a> e", "a b c d e"),
    ("one <span aria-hidden='true'>x<b>y</b></span> two <button>z</button> three", "one two three"),
    ("one <script>if (a < b) { }</script>two <svg><title>t</title></svg> three <span hidden>no<span>no</span>no</span>four", "one two three four"),
    ("x<br>y &amp; z<wbr>w", "x y & zw"), ("one <select><option>a<option>b</select> two", "one two"),
])
def test_inline_elements_neither_end_a_line_nor_lose_words(inside, text):
    assert main_text(f"<article>{_BODY}<p>{inside}</p>{_BODY}</article>") == f"{_TEXT.strip()}\n{text}\n{_TEXT.strip()}"


@pytest.mark.parametrize("html", [
    "<div>" * 100_000 + "text", "<div>" * 50_000 + "</p>" * 50_000 + "x", "<span hidden>" * 50_000 + "x", "<li>a" * 50_000, "<div>x" * 50_000,
    "<svg>" * 30_000 + "</b>" * 30_000, "<p>a</span>" * 50_000, "<form>" * 30_000 + "z<p>k" * 100, "<article>" * 50_000 + "z",
])
def test_time_is_linear_in_depth(html):
    start = time.perf_counter()
    main_text(html)
    assert time.perf_counter() - start < 15


def _sentence(rng):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(12, 40))]
    return " ".join(words)


def _page(rng):
    """A page from parts with known roles, and the lines of its article."""
    lines, parts = [], []
    for _ in range(rng.randint(4, 12)):
        text = _sentence(rng)
        kind = rng.choice(["p", "p", "p", "li", "blockquote", "inline", "break"])
        if kind == "li":
            other = _sentence(rng)
            parts.append(f"<ul><li>{text}</li><li>{other}</li></ul>")
            lines += [text, other]
        elif kind == "inline":
            words = text.split()
            parts.append(f"<p>{' '.join(words[:3])} <a class='related' href='#'><b>{words[3]}</b></a>\n <em>{words[4]}</em> {' '.join(words[5:])}<span hidden>gone</span></p>")
            lines.append(text)
        elif kind == "break":
            half = text.split()
            parts.append(f"<p>{' '.join(half[:6])}<br>{' '.join(half[6:])}</p>")
            lines.append(text)
        else:
            parts.append(f"<{kind}>\n  {text}\t</{kind}>")
            lines.append(text)
    if rng.random() < 0.7:
        title = " ".join(_sentence(rng).split()[:5])
        parts.insert(0, f"<h1 id='{rng.choice(['top', 'related', 'search'])}'>{title}</h1>")
        lines.insert(0, title)
    inner = rng.choice(["", "<div class='ad'>buy this now</div>", "<aside>see also</aside>", "<form><input><p>sign up here please</p></form>"])
    parts.insert(rng.randint(0, len(parts)), inner)
    tag = rng.choice(["article", "main", "div"])
    before = [
        "<nav><a>Home</a> <a>News</a></nav>", "<header><p>The Daily Page</p></header>", "<ul><li><a>One</a></li><li><a>Two</a></li></ul>",
        "<div class='cookie-notice'><p>We use cookies here.</p></div>", "<div class='sidebar'><p>Popular now</p></div>",
    ]
    after = [
        "<footer><p>All rights reserved</p></footer>", f"<section class='comments'><div class='comment'><p>{_sentence(rng)}</p></div></section>",
        "<div id='newsletter-signup'><p>Get our letter</p></div>", "<script>var x = '<p>no</p>';</script>",
    ]
    pick = lambda some: "".join(rng.sample(some, rng.randint(0, len(some))))
    html = f"<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body>{pick(before)}<{tag}>{''.join(parts)}</{tag}>{pick(after)}</body></html>"
    return html, "\n".join(lines)


def test_generated_pages():
    rng = random.Random(11)
    for _ in range(300):
        html, text = _page(rng)
        assert main_text(html) == text
