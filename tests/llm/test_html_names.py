import pytest

from quillmatch.llm.html_paths import extract

TEXT = "<p>A first paragraph, with some text.</p><p>A second one, and more.</p>"
WANT = "A first paragraph, with some text.\nA second one, and more."
REST = '<div class="sidebar"><p>Elsewhere, other text.</p></div><section id="comments"><article class="comment-body"><p>I agree, fully.</p></article></section>'


@pytest.mark.parametrize(
    "tag",
    [
        'article class="post comment-open"', 'article class="post category-privacy"', 'div id="content" class="has-sidebar"', 'div class="article-body widget"',
        'div itemprop="articleBody" class="share"', 'section class="entry-content noSidebar"', 'div class="post tag-cookies comments-closed"', 'article class="promoted"',
    ],
)
def test_names_beside_the_article_keep_it(tag):
    assert extract(f"<body><{tag}>{TEXT}</{tag.split()[0]}>{REST}</body>") == WANT


@pytest.mark.parametrize("tag", ['article class="comment"', 'div class="comment-content"', 'div class="sidebar-content"', 'div class="widget text"', 'div class="content hidden"'])
def test_other_parts_still_go(tag):
    assert extract(f"<body><div>{TEXT}</div><{tag}><p>No part of it, really.</p></{tag.split()[0]}></body>") == WANT


def test_a_small_card_is_not_the_article():
    page = f"<body><div><div>{TEXT * 4}</div></div><article><p>Teaser.</p></article></body>"
    assert extract(page) == "\n".join([WANT] * 4)
    assert extract(f"<body><main><div>{TEXT * 4}</div><article><p>Teaser.</p></article></main></body>").startswith(WANT)


def test_a_heading_beside_the_article():
    assert extract(f"<body><main><h1>Title</h1><p>By me.</p><article>{TEXT}</article></main></body>") == f"Title\n{WANT}"
