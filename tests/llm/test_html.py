from quillmatch.llm.html_paths import extract, main_text


def test_article_without_the_rest():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
        '<!-- ad --><div class="ad">Buy this, now.</div><article><h1>Title</h1><p><b>First &amp; bold\n text.<br><p>Second,  one.</p></article>'
        '<section id="comments"><p>I agree, all of it.</p></section><aside>Side.</aside><form><p>Mail us.</p></form><footer>&copy; me</footer></body></html>'
    )
    assert extract(page) == "Title\nFirst & bold text.\nSecond, one."


def test_ratios_choose_where_nothing_is_named():
    page = "<table><tr><td><a href=1>l1</a> <a href=2>l2</a></td><td><p>Long text, here we go. More, really.</p><p>Another, long one. With text.</p></td></tr></table>"
    assert extract(page) == "Long text, here we go. More, really.\nAnother, long one. With text."


def test_named_containers_and_parts():
    page = '<div id="top-menu"><a href=x>A</a></div><div class="post-content"><h2>T</h2><p>Short.</p></div><div class="cookie-notice">We, use.</div><div class="sidebar"><p>Other, text.</p></div>'
    assert extract(page) == "T\nShort."


def test_odd_pages():
    assert extract(None) == "" and extract("") == "" and extract("<html></html>") == ""
    assert extract("plain a < b") == "plain a < b"
    assert extract("<div>x<script>if(a<b){'</div>'}</script>y</div>") == "xy"
    assert extract("<p>unclosed <b>bold") == "unclosed bold"
    assert extract("<p>" + "word, " * 200_000 + "</p>").count("word") == 200_000
    assert extract("<script>never ends") == ""


def test_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>One, text.</p>", "x"), (1, "u", "<p>One, text.</p>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, main_text(rows).collect()), key=str)
    assert got == sorted([(1, "u", "One, text.", 10), (1, "u", "One, text.", 10), (None, None, "", 0)], key=str)
    assert main_text(rows.limit(0)).count() == 0
