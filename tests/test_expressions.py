import html as stdlib_html
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pageloom.functions import html as H, text as T, urls as U


def apply(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


def test_url_parts_keep_port_and_user(spark):
    urls = ["https://WWW.Example.com:8080/a", "http://u@h.org", "https://www.www.x.y/", "no-scheme/path", "https://h/a b?c d"]
    assert apply(spark, urls, U.url_host) == ["example.com:8080", "u@h.org", "www.x.y", "", "h"]
    assert apply(spark, urls, U.url_netloc)[0] == "WWW.Example.com:8080"


BASES = ["https://h.org/a/b/c.html?q=1#f", "http://h.org", "http://h.org/", "https://h.org/a/b/"]
REFS = ["", "x.png", "./x.png", "../x.png", "../../../x.png", "/x/../y.png", "//cdn.org/p.png", "?z=2", "#top",
        "https://o.org/q", "mailto:a@b.c", "sub/./dir/../e.png?v=1#k", "..", "."]


@pytest.mark.parametrize("base", BASES)
def test_resolve_url_like_the_standard_library(spark, base):
    rows = spark.createDataFrame([(i, base, r) for i, r in enumerate(REFS)], "i int, b string, r string")
    got = [r[0] for r in rows.orderBy("i").select(U.resolve_url(F.col("b"), F.col("r"))).collect()]
    expected = [urljoin(base, r) for r in REFS]
    assert got == expected


def test_slugs(spark):
    assert apply(spark, ["Hello, World!", "  --A  b--", "日本語", "Çafé 1"], T.slugify) == ["hello-world", "a-b", "page", "af-1"]
    assert apply(spark, ["http://h/", "http://h?x=1", "http://h/a/B c/", "http://h/a.html"], U.url_slug) == [
        "index", "index", "a-b-c", "a-html"]


def test_raw_file_name_keeps_wide_numbers(spark):
    row = spark.range(1).select(*[U.raw_file_name(F.lit(n), F.lit("http://h/p")) for n in (1, 42, 999, 12345)]).first()
    assert list(row) == ["001-p.html", "042-p.html", "999-p.html", "12345-p.html"]


def test_entities_match_the_standard_library(spark):
    values = ["a &amp; b", "&copy;&middot;", "&amp;copy;", "&#8364;&#x1F600;", "&eacute;&nosuch;&", "x &lt;b&gt; &#39;q&#39;",
              "&hellip; &nbsp;|", "plain", "AT&T", "&amp;lt;"]
    assert apply(spark, values, H.decode_entities) == [stdlib_html.unescape(v) for v in values]


def test_escaping(spark):
    values = ["<a href=\"x\">it's & more</a>", "&amp;"]
    assert apply(spark, values, H.html_escape) == [stdlib_html.escape(v) for v in values]
    assert apply(spark, ["a]]>b"], H.cdata_wrap) == ["<![CDATA[a]]]]><![CDATA[>b]]>"]


def test_titles_and_whitespace(spark):
    values = ["Page | Site", "A - B - C", "Re-use it", " – x", "One — Two", "plain"]
    assert apply(spark, values, T.trim_title_suffix) == ["Page", "A", "Re-use it", "– x", "One", "plain"]
    assert apply(spark, ["  a \n\t b "], T.collapse_ws) == ["a b"]


def test_code_fence(spark):
    assert apply(spark, ["```html\n<p>x</p>\n```", "<p>```</p>", "```\nx"], T.strip_code_fence) == ["<p>x</p>", "<p>```</p>", "x"]


def test_image_names(spark):
    urls = ["http://h/a/my_photo-1.jpg?x", "http://h/%20.png", "http://h/", "http://h/a+b%2Bc.gif", "http://h/x%ZZ.png"]
    assert apply(spark, urls, U.image_title) == ["my photo 1", "image", "image", "a+b+c", "x%ZZ"]
    urls = ["http://h/a%20b.png", "http://h/photo", "http://h/", "http://h/日本.jpg", "http://h/..."]
    assert apply(spark, urls, U.safe_filename) == ["a-b.png", "image.jpg", "image.jpg", ".jpg", "..."]


def test_mime(spark):
    assert apply(spark, ["image/png; q=1", "IMAGE/GIF", "x/y", ""], U.mime_extension) == [".png", ".gif", ".jpg", ".jpg"]
    row = spark.range(1).select(
        U.mime_type(F.lit("image/webp;x"), F.lit("a.png")), U.mime_type(F.lit(""), F.lit("a.png")),
        U.mime_type(F.lit(""), F.lit("a")), U.safe_filename(F.lit("http://h/p"), F.lit("image/png"))).first()
    assert list(row) == ["image/webp", "image/png", "image/jpeg", "image.png"]


def test_dates(spark):
    ts = F.to_timestamp(F.lit("2024-02-29 03:04:05"))
    row = spark.range(1).select(T.rfc1123(ts), T.gmt_stamp(ts)).first()
    assert list(row) == ["Thu, 29 Feb 2024 03:04:05 +0000", "2024-02-29 03:04:05"]


def test_attributes(spark):
    tag = """<img ALT='x src=no' data-src=a.png src="b&amp;c.png" hidden src="second">"""
    row = spark.createDataFrame([(tag,)], "t string").select(
        *[H.attribute(F.col("t"), n) for n in ("src", "alt", "data-src", "hidden", "title")]).first()
    assert list(row) == ["b&c.png", "x src=no", "a.png", "", None]
