"""Selectors with structure, and lists and columns of any depth, on broken markup too."""

from pyspark.sql import functions as F

from pageloom.operators import contract as K, layout as Y, nodes as N
from pageloom.operators.selectors import structural_hits, structural_steps
from pageloom.plans.convert import extracted_rows

HTML = ('<body><article id=a><h1>t</h1><p class="x y">one<p lang=en-US>two <a href="/go?x=1" data-k=\'v, w\'>l</a>'
        '<div class=row><div class="col col-4">c1</div><div class="col">c2<ul><li>i1<li>i2<ul><li>deep</ul></li></ul></div></div>'
        "<p>three<img src=/i.png></article><footer><p>f</p></footer>")
HITS = {
    "article > p + p": 7, "p ~ div.row > .col:nth-child(2)": 16, "ul li > ul": 23, "h1, p": 2, "h2 , article>h1": 2, "[href^='/go']": 9,
    "a[data-k='v, w']": 9, "p[lang|=en]": 7, "li:first-child": 19, "li + li": 21, "li:nth-child(2) li": 24, "footer>p:first-child": 36,
    "article > *": 2, "div[class~=col-4]": 13, "img[src$='.png']": 33, "article>li": None, "body p ~ p ~ p": 31, "h1+h2": None,
    "*[class*=ol-]": 13, " article  >  p ": 5,
}
UNSUPPORTED = ("p:hover", "a b >", "p::before", "a:not(.b)", "> p", "")


def test_structural_selectors(spark):
    rows = [(i, "https://h/", HTML, css) for i, css in enumerate((*HITS, *UNSUPPORTED))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, css string")
    nodes = N.html_nodes(pages, ("url", "css")).withColumn("_steps", structural_steps(F.col("css")))
    found = {r.page_id: r.hit_pos for r in structural_hits(nodes).collect()}
    assert {css: found.get(i) for i, css in enumerate(HITS)} == HITS
    known = {r.css: r.k for r in pages.select("css", structural_steps(F.col("css")).isNotNull().alias("k")).collect()}
    assert all(known[css] for css in HITS) and not any(known[css] for css in UNSUPPORTED)


def test_lists_of_any_depth_and_without_ends(pages_of):
    html = "<main><ul>loose<ul><li>x</ul><li>y<li><li>z<ul></ul></ul><p>end</p><ol><li>a" + "<ul><li>b" * 9
    rows = K.clean_rows(extracted_rows(pages_of(("https://h/", html)), css="main"))
    first, second = [r.markup for r in Y.nested_list_block(rows).orderBy("list_no").collect()]
    for markup in (first, second):
        assert markup.count("<li>") == markup.count("</li>") == markup.count("<!-- wp:list-item -->") == markup.count("<!-- /wp:list-item -->")
        assert markup.count("<ul ") + markup.count("<ol ") == markup.count("</ul>") + markup.count("</ol>") == markup.count("<!-- /wp:list -->")
    assert first.count("<li>") == 5 and "<li>loose\n<!-- wp:list -->" in first
    assert second.count("<ul ") == 9 and second.count("<li>b") == 9 and second.startswith('<!-- wp:list {"ordered":true} -->')


def test_columns_need_a_wrapper_and_lose_nothing(pages_of):
    html = ("<main><div class=row><div class='col-4'><h3>H</h3></div>loose</div><div class=row><p>plain</p></div><div class=col>alone</div>"
            "<div class=columns><div class=col>in<div class=row><div class=col>deep</main>")
    rows = [(r.columns, r.markup) for r in Y.columns_block(extracted_rows(pages_of(("https://h/", html)), css="main")).orderBy("pos").collect()]
    assert [n for n, _ in rows] == [1, 1]
    assert "loose" in rows[0][1] and rows[0][1].count("<!-- wp:column ") == 2 and '{"width":"33.33%"}' in rows[0][1]
    assert "plain" not in rows[0][1] + rows[1][1] and "alone" not in rows[0][1] + rows[1][1]
    assert rows[1][1].count("<!-- wp:columns -->") == rows[1][1].count("<!-- /wp:columns -->") == 2 and "deep" in rows[1][1]
