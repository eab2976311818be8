"""Queries over page structure: nodes, titles, content, links, tables and corpus views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.urls import url_host
from pageloom.operators import content as C, nodes as N, titles as T
from pageloom.sources.tables import augmented_pages, test_pages


def _nodes(spark, sf_dir) -> DataFrame:
    return N.html_nodes(test_pages(spark, sf_dir))


def _aug(spark, sf_dir) -> DataFrame:
    return augmented_pages(test_pages(spark, sf_dir))


def _derive(spark, sf_dir, find: str, put: str) -> DataFrame:
    pages = test_pages(spark, sf_dir)
    return pages.withColumn("html", F.replace(F.col("html"), F.lit(find), F.lit(put)))


def load_pages(spark, sf_dir):
    return test_pages(spark, sf_dir).select("page_id", "url", F.md5("html").alias("html_md5"))


def html_nodes(spark, sf_dir):
    return N.html_nodes(_aug(spark, sf_dir)).select("page_id", "pos", "kind", "tag", "tok")


def node_depth(spark, sf_dir):
    return N.node_depth(_nodes(spark, sf_dir), N.CHROME_TAGS).select("page_id", "pos", "depth")


def element_extents(spark, sf_dir):
    """Extent of every list, navigation and article element."""
    rows = N.element_extents(_nodes(spark, sf_dir)).filter(N.opens("nav", "ul", "li", "article", "div", "footer"))
    return rows.select("page_id", "pos", "tag", "end_pos")


def drop_chrome(spark, sf_dir):
    return N.drop_chrome(_nodes(spark, sf_dir)).select("page_id", "pos", "tok")


def drop_by_id(spark, sf_dir):
    pages = _derive(spark, sf_dir, "<article>",
                    '<div id="email-cta-heading"><div><h1>Join</h1></div>us</div><article>')
    rows = N.drop_by_id(N.html_nodes(pages), "email-cta-heading")
    return rows.groupBy("page_id").agg(
        F.md5(F.expr("listagg(tok, '') within group (order by pos)")).alias("html_md5")
    )


def headings(spark, sf_dir):
    rows = T.headings(N.drop_chrome(N.body_nodes(_nodes(spark, sf_dir))))
    return rows.select("page_id", "heading_id", "text")


def drop_boilerplate_headings(spark, sf_dir):
    pages = _derive(spark, sf_dir, "<article>", "<article><h2> News <i>&amp; Events</i> </h2><h3>News &amp; Events</h3>")
    heads = T.headings(N.drop_chrome(N.body_nodes(N.html_nodes(pages))))
    return T.drop_boilerplate_headings(heads, T.boilerplate_headings_dim(spark)).select("page_id", "heading_id", "text")


def page_title(spark, sf_dir):
    return T.page_titles(test_pages(spark, sf_dir)).select("page_id", "url", "title")


def page_title_cascade(spark, sf_dir):
    """Every level of the cascade: a third of the pages lose their heading, a third their title too."""
    step = F.col("page_id") % 4
    html = (
        F.when(step == 1, F.regexp_replace("html", "<h1>.*</h1>", ""))
        .when(step == 2, F.regexp_replace(F.regexp_replace("html", "<h1>.*</h1>", ""), "<title>.*</title>",
                                          '<meta property="og:title" content=" Social &amp; title ">'))
        .when(step == 3, F.regexp_replace(F.regexp_replace("html", "<h1>.*</h1>", ""), "<title>.*</title>", ""))
        .otherwise(F.col("html"))
    )
    override = F.when(F.col("page_id") % 8 == 4, F.lit("Forced")).when(F.col("page_id") % 8 == 5, F.lit(""))
    pages = test_pages(spark, sf_dir).select("page_id", "url", html.alias("html"), override.alias("title_override"))
    return T.page_titles(pages).select("page_id", "title", "title_source")


def _selectors(spark, sf_dir) -> DataFrame:
    """Selectors for the sites of the corpus: a match, one that never matches, and none."""
    host = url_host(F.col("url"))
    css = F.when(host.endswith(".com"), F.lit("body article")).when(host.endswith(".net"), F.lit("main .entry-content"))
    return test_pages(spark, sf_dir).select(host.alias("host"), css.alias("css")).filter("css is not null").distinct()


def match_selector(spark, sf_dir):
    return C.match_selector(test_pages(spark, sf_dir), _selectors(spark, sf_dir))


def select_first(spark, sf_dir):
    return C.select_first(_nodes(spark, sf_dir), "article").select("page_id", "pos", "tok")


def select_first_class(spark, sf_dir):
    return C.select_first(_nodes(spark, sf_dir), "body div.ad").select("page_id", "pos", "tok")


STRUCTURAL = ("table.t > tbody tr:nth-child(2), div.columns > .column ~ div", "p:hover", "article > p + p",
              "blockquote + blockquote, ul > li > ul")


def select_structural(spark, sf_dir):
    """Selectors with children, siblings, lists and positions, by site; what the page's selector found, and where it came from."""
    host = url_host(F.col("url"))
    css = F.element_at(F.array(*[F.lit(c) for c in STRUCTURAL]), (F.length(host) % len(STRUCTURAL) + 1).cast("int"))
    pages = _aug(spark, sf_dir)
    content = C.content_nodes(pages, selectors=pages.select(host.alias("host"), css.alias("css")).distinct())
    inside = F.expr("listagg(tok, '') within group (order by pos)")
    return content.groupBy("page_id", "content_source").agg(inside.alias("inside")).select(
        "page_id", "content_source", F.when(F.col("content_source") == "selector", F.md5("inside")).alias("inside_md5"))


def text_blocks(spark, sf_dir):
    return C.text_blocks(_nodes(spark, sf_dir)).select("page_id", "block_id", "text", "words", "link_words")


def auto_content(spark, sf_dir):
    rows = C.auto_content(N.html_nodes(_aug(spark, sf_dir)))
    return rows.select("page_id", "pos", "tok")


def site_boilerplate(spark, sf_dir):
    return C.site_boilerplate(C.text_blocks(_nodes(spark, sf_dir)))


def drop_site_boilerplate(spark, sf_dir):
    blocks = C.text_blocks(_nodes(spark, sf_dir))
    return C.drop_site_boilerplate(blocks, C.site_boilerplate(blocks)).select("page_id", "block_id", "host", "text")


def resolve_content(spark, sf_dir):
    content = C.content_nodes(test_pages(spark, sf_dir), selectors=_selectors(spark, sf_dir))
    return C.content_summary(content).select("page_id", "content_source", "text_chars", "is_empty")


def filter_empty_content(spark, sf_dir):
    blanked = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "<article>.*</article>", "<article> </article>"))
    pages = test_pages(spark, sf_dir).withColumn("html", F.coalesce(blanked, F.col("html")))
    summary = C.content_summary(C.content_nodes(pages, css="article"))
    return summary.select(
        "page_id", F.when(F.col("is_empty"), F.lit("skipped")).otherwise("ok").alias("status"),
        F.when(F.col("is_empty"), F.lit("no main content extracted")).alias("message"),
    )


def visible_text(spark, sf_dir):
    rows = N.visible_text(N.drop_chrome(_nodes(spark, sf_dir)), " ")
    return rows.select("page_id", F.md5("text").alias("text_md5"))


def links(spark, sf_dir):
    return C.links(N.html_nodes(_aug(spark, sf_dir)))


def tables(spark, sf_dir):
    return C.tables(N.html_nodes(_aug(spark, sf_dir)))


def duplicate_content(spark, sf_dir):
    body = F.regexp_extract("html", "<article>(.*)</article>", 1)
    twice = F.when(F.col("page_id") % 5 == 0, F.replace(F.col("html"), F.lit("</article>"), F.concat(
        F.lit("</article><article>"), body, F.lit("<p>One more line</p></article>"))))
    pages = test_pages(spark, sf_dir).withColumn("html", F.coalesce(twice, F.col("html")))
    return C.duplicate_content(C.text_blocks(N.html_nodes(pages)))


def meta_duplication(spark, sf_dir):
    first = F.regexp_extract("html", "<p>([^<]+)</p>", 1)
    meta = F.concat(F.lit('<meta name="description" content="'), first, F.lit('"></head>'))
    pages = test_pages(spark, sf_dir).withColumn("html", F.replace(F.col("html"), F.lit("</head>"), meta))
    return C.meta_duplication(N.html_nodes(pages))


def _with_near_copies(spark, sf_dir) -> DataFrame:
    """Articles that repeat their first plain paragraph with another last word, and once more as it is."""
    first = F.regexp_extract("html", "<p>([^<]+)</p>", 1)
    again = F.concat(F.lit("<p>"), F.regexp_replace(first, r"\S+$", "changed"), F.lit("</p><p>"), first, F.lit("</p></article>"))
    return test_pages(spark, sf_dir).withColumn("html", F.replace(F.col("html"), F.lit("</article>"), again))


def duplicate_content_near(spark, sf_dir):
    return C.duplicate_content_near(C.text_blocks(N.html_nodes(_with_near_copies(spark, sf_dir))))


def near_copies(spark, sf_dir):
    """Pairs of nearly equal texts within a site."""
    blocks = C.text_blocks(N.html_nodes(_with_near_copies(spark, sf_dir))).withColumn("host", url_host(F.col("url")))
    return C.near_copies(blocks, "host").withColumn("similarity", F.round("similarity", 4))


def meta_overlap(spark, sf_dir):
    """Descriptions that run from one paragraph into the next, or end in words of their own."""
    end = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(" words that stand nowhere else here")
    first = F.regexp_replace(F.regexp_extract("html", "<p>([^<]+)</p>", 1), r'"', "")
    second = F.regexp_extract(F.regexp_replace("html", r"^(?s:.*?)<p>[^<]+</p>", ""), r"^<p>(\S+ \S+)", 1)
    meta = F.concat(F.lit('<meta name="description" content="'), first, F.lit(" "), second, end, F.lit('"></head>'))
    pages = test_pages(spark, sf_dir).withColumn("html", F.replace(F.col("html"), F.lit("</head>"), meta))
    return C.meta_overlap(N.html_nodes(pages))


def site_boilerplate_merged(spark, sf_dir):
    """Two runs over half of the pages each, one page in both, merged by their sketches."""
    blocks = C.text_blocks(_nodes(spark, sf_dir))
    runs = [C.boilerplate_sketches(blocks.filter(cond)) for cond in ("page_id % 2 = 0 or page_id = 1", "page_id % 2 = 1")]
    return C.shared_texts(C.merge_sketches(*runs))


def suggest_selector_images(spark, sf_dir):
    """The text lies in one part of the article and the images in another: by text alone the first part would win."""
    pics = ('</div><div class="pics"><img src="/1.jpg"><img src="/2.jpg"><p>Two views of the place as it is seen from the road in the morning and in the evening light</p></div></article>')
    pages = _derive(spark, sf_dir, "<article>", '<article><div class="story">')
    return C.suggest_selector(pages.withColumn("html", F.replace(F.col("html"), F.lit("</article>"), F.lit(pics))))


def suggest_selector(spark, sf_dir):
    return C.suggest_selector(test_pages(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    duplicate_content_near, near_copies, meta_overlap, site_boilerplate_merged, suggest_selector_images,
    load_pages, html_nodes, node_depth, element_extents, drop_chrome, drop_by_id, headings,
    drop_boilerplate_headings, page_title, page_title_cascade, match_selector, select_first, select_first_class, select_structural,
    text_blocks, auto_content, site_boilerplate, drop_site_boilerplate, resolve_content, filter_empty_content,
    visible_text, links, tables, duplicate_content, meta_duplication, suggest_selector,
)}
