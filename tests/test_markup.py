"""Links of pages whose markup is not plain."""

import pytest

from tidewheel.sources import feeds
from tidewheel.sources.markup import Links


def links(page, within=feeds.HEADINGS, direct=False, cap=20):
    return [(v["title"], v["href"]) for v in Links(within, direct, cap).links(page)]


@pytest.mark.parametrize("page,want", [
    ("<h2><a href='/a?b=1&amp;c=2'>caf&eacute; &euro;5 &#38;lt; &#x41;&#66;</a></h2>", [("café €5 &lt; AB", "/a?b=1&c=2")]),
    ("<h3><a href=/x>&#9999999; &#xFFFFFF; &#0; &nosuch; &amp;amp;</a></h3>", [("� � � &nosuch; &amp;", "/x")]),
    ("<h2><!-- <a href='/no'>not there</a> --><a title='a > b' href=\"/y\">real <!-- x --> one</a></h2>", [("realone", "/y")]),
    ("<h2><a href='/b'>Foo <b>bar</b> baz</a></h2>", [("Foobarbaz", "/b")]),
    ("<h2><script>'<a href=\"/s\">no</a>'</script><a href=/t>t<script>x</script>u</a></h2><a href=/u>outside</a>", [("tu", "/t")]),
    ("<H4><A HREF='/U'>upper</A></h4><h2>", [("upper", "/U")]),
    ("<h2><div><p><a href=/deep>deep</a></div> <a href=/after>after</a></h2><a href=/out>out</a>", [("deep", "/deep"), ("after", "/after")]),
    ("<h2>a < b <a href=/lt>1 < 2</a><br/><img src=x><a>none</a></h2>", [("1 < 2", "/lt"), ("none", "")]),
    ("<h2><a href=/open>never closed", [("never closed", "/open")]),
    ("<h2><a href=/1 href=/2>first wins</a></h2></h2></li><a href=/3>x</a>", [("first wins", "/1")]),
    ("", []), ("<", []), ("<h2><a", []), ("no markup & more", []),
])
def test_anchors(page, want):
    assert links(page) == want


def test_direct_children_and_the_cap():
    page = "<ul><li><a href=/1>one</a> <b><a href=/2>two</a></b><a href=/3>three</a></li></ul>"
    assert links(page, ("li",), True) == [("one", "/1"), ("three", "/3")]
    assert links(page, ("li",)) == [("one", "/1"), ("two", "/2"), ("three", "/3")]
    assert links(page * 30, ("li",), cap=4) == [("one", "/1"), ("two", "/2"), ("three", "/3"), ("one", "/1")]


def test_a_page_of_many_open_elements_is_linear():
    assert links("<h2>" + "<div>" * 50_000 + "<a href=/x>x</a>" + "</div>" * 50_000) == [("x", "/x")]


def test_bad_pages_do_not_end_the_job(spark):
    pages = [(1, "<h2><a href='/a'>A title of more than thirty signs &#9999999;</a></h2>", "x"), (2, None, "x"), (3, "", "x"),
             (4, "<h2><a href='http://o'>Another title of more than thirty signs</a></h2>", "x")]
    got = feeds.page_links(spark.createDataFrame(pages, "page_id long, html string, title string"), "https://b").orderBy("page_id").collect()
    assert [(r.page_id, r.link_no, r.title, r.link) for r in got] == [
        (1, 0, "A title of more than thirty signs �", "https://b/a"), (4, 0, "Another title of more than thirty signs", "http://o")]
