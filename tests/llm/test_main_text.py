"""Main text of hand-made pages: names weigh, densities decide."""

import pytest

from tidemark.llm.html import main_text

STORY = "This is the story of the man who went to the sea, and of the boat that he had found on the shore when it was late."
MORE = "She was with them for a while, and they said that it had not been as they were told by the people in the town."
LAST = "In the end all of it was as it had been before, and he was back on the shore with the boat that was not his own."
REMARK = "I think that this is the best of all the stories that I have read in my life, and it is for you to say if it is not."
ADVERT = "This is the best of all the offers that you have had from us, and it is for you and for all who are with you now."
LINKS = "".join(f"<li><a href='/{i}'>The best of the stories of the day number {i}</a></li>" for i in range(8))
BODY = f"<h1>Late</h1><p>{STORY}</p><p>Short.</p><p>{MORE}</p><p>{LAST}</p>"
WHOLE = "\n\n".join(["Late", STORY, "Short.", MORE, LAST])

WRAPPERS = [
    '<div class="page has-sidebar">%s</div>',
    '<article class="post type-post comments-open">%s</article>',
    '<div id="main" class="share-enabled">%s</div>',
    '<section aria-label="Search results and notice">%s</section>',
    "<form>%s</form>",
    '<form class="page-form"><div>%s</div></form>',
    '<div class="no-ads ad-free">%s</div>',
    '<div id="with-newsletter">%s</div>',
    '<div class="notice">%s</div>',
    '<div class="widget"><div class="teaser">%s</div></div>',
    '<aside>%s</aside>',
    '<div title="the hidden world" data-x="display:none">%s</div>',
    "<main>%s</main>",
    "<main><article>%s</article></main>",
    "<div>%s</div>",
    "<body class=\"sidebar widget\">%s</body>",
    '<div class="feedback-is-open">%s</div>',
]
BESIDE = [
    f"<nav><ul>{LINKS}</ul></nav>",
    f"<ul>{LINKS}</ul>",
    f'<div class="ad">{ADVERT}</div>',
    f'<div class="ad-300x250 top-banner">{ADVERT}</div>',
    f'<div class="cookie-notice">{ADVERT}</div>',
    f'<div role="dialog"><p>{ADVERT}</p></div>',
    f"<aside><p>{ADVERT}</p></aside>",
    f"<footer>&copy; {ADVERT}</footer>",
    f'<div class="site-footer"><p>{ADVERT}</p></div>',
    f'<div id="comments"><article class="comment"><p>{REMARK}</p></article></div>',
    f'<section class="post-comments"><p>{REMARK}</p><p>{REMARK}</p></section>',
    f'<form action="/login"><label>{ADVERT}</label><button>In</button></form>',
    f"<div hidden>{ADVERT}</div>",
    f"<div style='display: none'>{ADVERT}</div>",
    f"<script>var t = '<p>{ADVERT}</p>';</script><style>p {{ }}</style><!-- {ADVERT} -->",
]


@pytest.mark.parametrize("beside", BESIDE)
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_article_without_what_is_beside_it(wrapper, beside):
    page = wrapper % BODY
    if "<body" not in wrapper:
        assert main_text(f"<html><body>{beside}{page}</body></html>") == WHOLE
    assert main_text(f"<html>{page}{beside}</html>") == WHOLE
    assert main_text(f"<html>{wrapper % (BODY + beside)}</html>") == WHOLE


def test_short_article_beside_long_comments():
    page = f'<article><h1>Late</h1><p>Short.</p></article><div id="comments"><p>{REMARK}</p><p>{REMARK}</p><p>{REMARK}</p></div>'
    assert main_text(page) == "Late\n\nShort."


def test_teaser_is_not_the_article():
    got = main_text(f"<article>Teaser of it.</article><div>{BODY}</div>")
    assert got.endswith(WHOLE)


def test_nothing_but_navigation_is_empty():
    assert main_text(f"<nav><ul>{LINKS}</ul></nav>") == ""
    assert main_text(f"<ul>{LINKS}</ul>") == ""
    assert main_text("") == main_text(None) == ""


def test_long_and_deep_pages():
    assert main_text(f"<div>{'<p>' + STORY + '</p>' * 1}</div>" * 3000).count(STORY) == 3000
    deep = "<div class=ad>" * 3000 + f"<p>{STORY}</p>" + "</div>" * 3000
    assert main_text(deep) == STORY
    assert main_text("<div class='" * 3000) is not None
    assert main_text("<div " + "a" * 200_000 + ">" + BODY) == WHOLE
