"""URL filters and HTML extraction."""

import time

from policylake.llm import html_layout, urls
from policylake.llm.html_layout import page_text
from policylake.llm.queries import ORACLES, QUERIES
from tests.oracle_compare import compare, connect


def verdicts(spark, rows, rules=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string, token string")
    found = urls.filter_urls(pages, urls.rule_table(spark) if rules is None else rules)
    return [(r.page_id, r.host, r.path, r.rule, r.verdict, r.pattern) for r in found.collect()]


def test_url_rules(spark):
    rows = [
        (1, "http://EXAMPLE.com/en/x?y=/de/", "c", "c", "c"), (2, "https://www.example.com/en/", "c", "c", "c"),
        (3, "http://notexample.net/es/1", "c", "c", "c"), (4, "http://example.com", "c", "c", "c"), (5, None, "c", "c", "c"),
        (6, "no scheme", "c", "c", "c"), (7, "a://b://c/d", "c", "c", "c"), (8, "x://my.casino-win.org/a", "c", "c", "c"),
        (9, "x://a.org/setup.exe", "c", "c", "c"), (9, "x://a.org/setup.exe", "c", "c", "c"), (10, "http://xcom/a", "c", "c", "c"),
        (11, "http://com/", "c", "c", "c"), (12, "http://example.com/EN/x", "c", "c", "c"), (None, "", "c", "c", "c"),
    ]
    got = sorted(verdicts(spark, rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == [
        (1, "example.com", "/en/x", "example.com/en/", "block", None),
        (2, "www.example.com", "/en/", "www.example.com/en/", "allow", None),
        (3, "notexample.net", "/es/1", "net/es/", "block", None), (4, "example.com", "", None, "allow", None),
        (5, "", "", None, "allow", None), (6, "", "", None, "allow", None), (7, "b:", "//c/d", None, "allow", None),
        (8, "my.casino-win.org", "/a", None, "block", "^casino^"), (9, "a.org", "/setup.exe", None, "block", ".exe^"),
        (9, "a.org", "/setup.exe", None, "block", ".exe^"), (10, "xcom", "/a", None, "allow", None),
        (11, "com", "/", "com/", "allow", None), (12, "example.com", "/EN/x", "com/", "allow", None),
        (None, "", "", None, "allow", None)]


def test_rules_without_tokens_and_without_rows(spark):
    rows = [(1, "http://a.org/bigcasinowin", "c", "c", "c")]
    loose = spark.createDataFrame([("*casino*", "block", False), ("*c*win", "allow", False)], "rule string, action string, site boolean")
    assert verdicts(spark, rows, loose)[0][4:] == ("block", "*casino*")
    none = spark.createDataFrame([], "rule string, action string, site boolean")
    assert verdicts(spark, rows, none)[0][3:] == (None, "allow", None)
    assert verdicts(spark, [], none) == []


def test_index_takes_safe_tokens_only(spark):
    rules = spark.createDataFrame([("^ads^", "block", False), ("a.com/fo", "block", True), ("*ads", "block", False)],
                                  "rule string, action string, site boolean")
    tokens = {r.rule: r.tokens for r in urls.compiled_rules(rules).collect()}
    assert tokens == {"^ads^": ["ads"], "a.com/fo": ["a", "com"], "*ads": []}


def test_url_query_agrees_with_sql(spark, sf):
    ok, message = compare(connect(sf), spark, "op1", QUERIES["op1_url_filters"], ORACLES["op1_url_filters"], sf)
    assert ok, message


def test_layout():
    html = ("<head><title>T &amp; t</title><style>x</style></head><h1>Head</h1>in<b>line</b> text<p>one<p>two  three"
            "<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><div hidden>no</div><div style='display: none'>no</div>"
            "tail<br>line<script>var x='</p>'</script><pre> k\n  v</pre>")
    title, text = page_text(html)
    assert title == "T & t"
    assert text == "Head\n\ninline text\n\none\n\ntwo three\n\n- a\n- b\n  3. x\n  4. y\n\ntail\nline\n\n k\n  v"


def test_tables_are_aligned_and_whole():
    html = ("<table><caption>cap</caption><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td colspan=2>both<tr><td rowspan=2>r<td>2"
            "<tr><td>3<tr><td><table><tr><td>in<td>ner</table><td>4</table>")
    assert page_text(html)[1] == "cap\nName    N\nalpha   1\nboth\nr       2\n        3\nin ner  4"
    long = "w" * 500
    assert long in page_text(f"<table><tr><td>{long}<td>x<tr><td>a<td>b</table>")[1]


def test_broken_and_deep_markup():
    assert page_text(None) == (None, "") and page_text("") == (None, "")
    assert page_text("plain < text &lt; <b") == (None, "plain < text < <b")
    assert page_text("<div>" * 50_000 + "x") == (None, "x")
    assert page_text("</p></div>a</ul>") == (None, "a")
    assert page_text("<!-- a --><p>b<!-- never ends <p>c")[1] == "b"
    assert page_text("<a href=\"" * 3000)[1].startswith("<a href")
    assert len(page_text("<table><tr><td>x" * 2000)[1].split()) == 2000


def test_tags_of_any_size_and_tags_that_never_end():
    many = "".join(f' a{i}="{i}" b' for i in range(20000))
    assert page_text(f"<p{many}>one<p hidden{many}>two")[1] == "one"
    assert page_text('<a title="x>text</a> <p>More')[1].split("\n") == ['<a title="x>text', "", "More"]
    assert page_text('<b>x</b> <p a="<i>y</i>" b')[1] == 'x <p a="<i>y</i>" b'
    started = time.monotonic()
    for open_ in ('<p a="1" ' * 50000, '<p a="1" <q' * 50000, '<p a="1" ' * 50000 + '<q a="> z'):
        assert page_text(open_)[1].count('<p a="1"') == 50000
    assert time.monotonic() - started < 20


def test_head_ends_without_its_tags():
    assert page_text("<head><title>T</title><p>Hello <b>you</b>") == ("T", "Hello you")
    assert page_text("<html><head>\n<meta charset=x><link rel=y><style>s</style>\n Hello<p>there</html>") == (None, "Hello\n\nthere")
    assert page_text("<head><noscript><img src=x>no</noscript><script>no</script><title>T</title></head><div>a") == ("T", "a")
    assert page_text("<head><template><p>no</template>&nbsp;<title>T")[1].strip() == ""


def test_quotes_open_values_only():
    assert page_text("<p class=\"x\"\">one</p><p>two \"q\"")[1] == "one\n\ntwo \"q\""
    assert page_text("<a title=it's>one</a> it's <b>two</b>")[1] == "one it's two"
    assert page_text("<a href=/x?a=\"b>one</a> <i>\"two\"</i>")[1] == "one \"two\""
    assert page_text("<p title = 'a > b' id=\"c > d\"x>one<p don't>two<p =\"x>three")[1] == "one\n\ntwo\n\nthree"
    assert page_text("<p class=\"x\"\" style='display:none'>no</p><p hidden=>no</p><p a=b/ " + "x " * 2000 + ">yes")[1] == "yes"


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, None, "t", "x"), (None, "<p>a", "t", "x"), (1, "<p>a", "t", "x")],
                                  "page_id long, html string, text string, title string")
    rows = html_layout.extract_text(pages).collect()
    assert sorted((r.page_id or 0, r.title, r.text) for r in rows) == [(0, None, "a"), (1, None, ""), (1, None, "a")]
    assert html_layout.extract_text(pages.limit(0)).count() == 0
