"""Whole expected texts of pages whose attributes, names or structure mislead."""

import pytest

from odresil.llm.extract import main_text

WORDS = [
    "The river rose all night, and by morning the lower road was under water, so the ferry took the mail across.",
    "People on the far bank waited with carts, blankets and bread, for they had heard the bell before dawn.",
    "By noon the water fell again, slowly at first, and the miller opened both gates to let the rest of it through.",
]
BODY = "".join(f"<p>{w}</p>" for w in WORDS)
TEXT = "\n".join(WORDS)


@pytest.mark.parametrize(
    "tag",
    [
        '<div aria-hidden="false">',
        "<div data-hidden-on=mobile>",
        '<div title="the hidden river">',
        '<div data-id="sidebar">',
        '<div data-role="dialog">',
        '<div data-class="advert" my-style="display:none">',
        '<div title=\'class="sidebar"\'>',
        '<div class="content comments">',
        '<div class="left side">',
        '<div class="social">',
        '<section class="discussion">',
        '<div class="overlay">',
        '<div role="dialog">',
        '<div class="comments"><div class="comment-list">',
    ],
)
def test_the_main_part_is_never_cut(tag):
    close = "".join(f"</{t.split()[0]}>" for t in reversed(tag.strip("<>").split("><")))
    assert main_text(f"<html><body>{tag}{BODY}{close}</body></html>") == TEXT


def test_attributes_inside_paragraphs():
    page = '<article><p>One <a href=x data-id="menu" aria-hidden=false>two</a> <span title="a hidden thing">three</span>, four.</p>' + BODY + "</article>"
    assert main_text(page) == "One two three, four.\n" + TEXT


def test_quotes_in_unquoted_values():
    assert main_text(f"<body><p title=Joe's>{WORDS[0]}</p><p alt=5\">{WORDS[1]}</p><p>{WORDS[2]}</p></body>") == TEXT
    assert main_text(f"<body><p title = \"a > b\" lang='x > y'>{WORDS[0]}</p><p / id=a/b>{WORDS[1]}</p><p>{WORDS[2]}</p></body>") == TEXT


def test_hidden_elements_are_still_cut():
    for tag in ("<div hidden>", "<div HIDDEN=until-found>", "<div aria-hidden=true>", '<div style="color:red; DISPLAY : none">'.replace("DISPLAY", "display")):
        assert main_text(f"<body>{tag}<p>Not to be seen, by anyone, at all.</p></div><div>{BODY}</div></body>") == TEXT


def test_the_first_of_two_attributes_counts():
    assert main_text(f'<body><div class="text" class="sidebar">{BODY}</div></body>') == TEXT


def test_all_of_main_is_kept():
    page = f"<main><section><h2>A</h2>{BODY}</section><section><h2>B</h2><p>Short.</p></section></main>"
    assert main_text(page) == f"A\n{TEXT}\nB\nShort."
    assert main_text(f"<main><h1>Title</h1><div class=post-body>{BODY}</div></main>") == f"Title\n{TEXT}"
    assert main_text(f"<main><h1>Title</h1><div class=lead>A few words first.</div><div class=post-body>{BODY}</div></main>") == f"Title\nA few words first.\n{TEXT}"
    # what is no part of the article goes even there
    page = f"<main><nav><a href=/>Home</a></nav><div>{BODY}</div><aside><p>Other news, of the day.</p></aside><section class=comments><p>First, I say!</p></section></main>"
    assert main_text(page) == TEXT


def test_an_article_in_main_is_the_container():
    page = f"<main><article><h1>T</h1>{BODY}</article><div><p>More from here, and there.</p></div></main>"
    assert main_text(page) == f"T\n{TEXT}"


def test_heading_and_lead_without_main():
    page = f"<body><div><h1>Title</h1><div class='article-lead'>A few words first.</div><div class=post-body>{BODY}</div><h2>More news</h2></div></body>"
    assert main_text(page) == f"Title\nA few words first.\n{TEXT}"


def test_long_comments_below_a_short_article_are_cut():
    comments = "".join(f"<p>I think that {k} is right, or wrong, or both, as ever.</p>" for k in range(40))
    assert main_text(f"<body><div><p>{WORDS[0]}</p><p>{WORDS[1]}</p></div><div class=comments>{comments}</div></body>") == f"{WORDS[0]}\n{WORDS[1]}"


def test_a_page_of_notices_has_no_text():
    assert main_text('<body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="notice"><p>We use cookies, and more.</p></div></body>') == ""


def test_time_is_linear_in_odd_tags():
    import time

    for page in ("<p " + "a=" * 100_000, "<p " + "'\"= " * 100_000 + ">x", "<p a" + " " * 200_000 + ">x", "<" * 200_000, "<a\"" * 100_000):
        start = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - start < 5
