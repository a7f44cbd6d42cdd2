from docquarry.llm.html_extract import extract, main_text

LONG = "The cat sat on the mat and it was the best of the days that we have ever seen in the town."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body>{body}</body></html>"


def test_article_with_boilerplate_around_and_inside():
    html = page(
        f"<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad <p>x</p> --><div class='ad'>{LONG}</div>"
        f"<article><h1>Title &amp; more</h1><p><b>Intro.<br><p>{LONG}\n\n&nbsp; two&#32;<i>it</i>alic</p><p>Be.</p><div class=\"share-buttons\">Share this</div>"
        f"<p>{LONG}</p><form><p>{LONG}</p></form><section id='comments'><p>{LONG}</p></section><p>End</article><aside><p>{LONG}</p></aside><div role=complementary>{LONG}</div><footer>&copy; me</footer>"
    )
    assert main_text(html) == f"Title & more\nIntro.\n{LONG} two italic\nBe.\n{LONG}\nEnd"


def test_page_without_article_uses_the_rules():
    html = page(f"<div id=menu><a href=a>{LONG}</a></div><div><a href=a>{LONG}</a></div><div class=content><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class='cookie-notice'>{LONG}</div><p>Tail</p><div class=x><p><a href=b>{LONG}</a></p></div>")
    assert main_text(html) == f"Head\n{LONG}\nShort.\n{LONG}"


def test_broken_and_empty_pages(spark):
    assert main_text(None) == main_text("") == main_text("<html></html>") == ""
    for bad in ("<", "<!--", "<script>", "<p title='x", "</div></div>", "&", "<a" * 500, "<p \"" * 2000, "<div>" * 3000):
        assert isinstance(main_text(bad), str)
    assert main_text(f"<article>{LONG}<script>x < y") == LONG
    assert main_text(f"<main><p>{LONG}<p>1 < 2 and 3 > 2</main>") == f"{LONG}\n1 < 2 and 3 > 2"
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), "x"), (1, "u", page(f"<article><p>{LONG}</p></article>"), "x"), (2, None, None, None), (None, "v", "", "y")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", LONG, len(LONG)), ("1", LONG, len(LONG)), ("2", "", 0), ("None", "", 0)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
