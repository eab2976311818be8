"""Queries over layout blocks, run reports, schedules and learned patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.urls import url_host
from pageloom.operators import blocks as B, content as C, contract as K, layout as Y, media as M, nodes as N, quality as Q
from pageloom.plans.convert import convert_pages, convert_pages_layout as convert_pages_of_layout, extracted_rows
from pageloom.session import materialize
from pageloom.sources.tables import augmented_pages, test_pages


def _aug(spark, sf_dir) -> DataFrame:
    return augmented_pages(test_pages(spark, sf_dir))


def _nodes(spark, sf_dir) -> DataFrame:
    return N.html_nodes(_aug(spark, sf_dir))


def _blocks(spark, sf_dir) -> DataFrame:
    return B.segment_blocks(B.block_rows(K.clean_rows(extracted_rows(_aug(spark, sf_dir), css="article"))))


def flatten_token_elements(spark, sf_dir):
    title = F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)", 1)
    html = F.concat(F.lit("<p>"), title, F.lit(
        " <b>bold</b> ⟦IMG_0⟧ tail ⟦IMG_77⟧ end ⟦</p><h2>Plain</h2><ul><li>x ⟦IMG_1⟧</li></ul>"))
    pages = test_pages(spark, sf_dir).select("page_id", "url", html.alias("html"))
    indexes = F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))
    media = pages.select(
        "page_id", indexes.alias("img_index"), F.lit("a\"b").alias("alt"),
        F.concat("url", F.lit("/i.png")).alias("url"), F.lit(None).cast("bigint").alias("media_id"),
    )
    return Y.flatten_token_elements(N.html_nodes(pages), media)


def nested_list_block(spark, sf_dir):
    named = F.replace(F.col("html"), F.lit("Two a"), F.concat(F.lit("Sub "), F.col("page_id").cast("string")))
    pages = _aug(spark, sf_dir).withColumn("html", named)
    return Y.nested_list_block(K.clean_rows(extracted_rows(pages, css="article")))


def image_block_caption(spark, sf_dir):
    images = M.extract_images(C.content_nodes(_aug(spark, sf_dir), css="article"), extended=True)
    return images.select("page_id", "img_index", B.image_block_caption(
        F.col("src"), F.col("alt"), F.col("caption")).alias("markup"))


def embed_block(spark, sf_dir):
    return Y.embed_block(_nodes(spark, sf_dir))


def gallery_block(spark, sf_dir):
    return Y.gallery_block(_blocks(spark, sf_dir))


def columns_block(spark, sf_dir):
    html = F.when(F.col("page_id") % 2 == 0, F.replace(F.replace(
        F.col("html"), F.lit('<div class="column">Left'), F.lit('<div class="column col-4">Left')),
        F.lit('<div class="column">Right'), F.lit('<div class="column col-8">Right')))
    pages = _aug(spark, sf_dir).withColumn("html", F.coalesce(html, F.col("html")))
    # Every article gets a second pair, so that all pages take part.
    pair = F.lit('<div class="row"><div class="col col-4">One <b>&amp;</b></div><div class="col col-8">Two</div></div></article>')
    pages = pages.withColumn("html", F.replace(F.col("html"), F.lit("</article>"), pair))
    return Y.columns_block(extracted_rows(pages, css="article")).select("page_id", "columns", "markup")


def _with_end(spark, sf_dir, *parts) -> DataFrame:
    """Augmented pages whose article ends with ``parts`` (strings or columns)."""
    tail = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("</article>"))
    return _aug(spark, sf_dir).withColumn("html", F.replace(F.col("html"), F.lit("</article>"), tail))


def nested_list_deep(spark, sf_dir):
    """Four levels, ordered and unordered, unclosed items, links, an image, and the page's own title in the deepest item."""
    title = F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)", 1)
    pages = _with_end(
        spark, sf_dir, "<ol><li>One <a href='/x?a=1&amp;b=2' class='k'>link</a><ul><li> Two<ol><li>Three <img src='/deep.png'> tail<ul><li><b>",
        title, "</b><li>", F.col("page_id").cast("string"), "</ul>after</li></ol></li><li></li></ul></li><li><i>Last</i></ol>")
    return Y.nested_list_block(K.clean_rows(extracted_rows(pages, css="article"))).filter(F.col("markup").contains("Three"))


def columns_with_blocks(spark, sf_dir):
    """A column with image, list, heading and link, one with columns inside it, loose text, and containers that make no columns."""
    pages = _with_end(
        spark, sf_dir, "<div class='row'><div class='col-4'><h3>Head</h3><p>See <a href='/go'>there</a></p><img src='/c.png' alt='x'><ul><li>a</li><li>b</li></ul></div>"
        "<div class='col-8'>Before<section class='columns'><div class='column'>", F.col("page_id").cast("string"),
        "</div><div class='column'><p>In</p><p>ner</p></div></section>After</div>loose</div><div class='row'><p>plain</p></div><div class='col'>alone</div>")
    rows = Y.columns_block(extracted_rows(pages, css="article"))
    return rows.filter(F.col("markup").contains("Head")).select("page_id", "columns", "markup")


def convert_pages_layout(spark, sf_dir):
    """Whole conversion with nested lists, columns, a gallery, captions, embeds, buttons and placeholders in place."""
    pages = _with_end(spark, sf_dir, "<div class='row'><div class='col-6'><ul><li>x<ol><li>y</li></ol></li></ul></div><div class='col-6'>"
                      "<img src='/1.png'><img src='/2.png'></div></div><p>Watch <iframe src='https://vimeo.com/", F.col("page_id").cast("string"),
                      "'></iframe> or <a class='btn' href='/buy'>buy <b>now</b></a>.</p><div class='map'><p>gone</p></div><p>End</p>")
    done = convert_pages_of_layout(pages, css="article")
    return done.select("page_id", "title", "content_source", "blocks", "images", "status", F.md5("body").alias("body_md5"))


def button_block(spark, sf_dir):
    return Y.button_block(_nodes(spark, sf_dir)).select("page_id", "markup")


# ---------------------------------------------------------------- runs


def _page_events(spark, sf_dir) -> DataFrame:
    """Event log of a run per host: every page once, every third page twice."""
    step = F.col("page_id") % 4
    status = F.when(step == 1, F.lit("failed")).when(step == 2, F.lit("skipped")).otherwise("ok")
    pages = test_pages(spark, sf_dir).withColumn("job_id", url_host(F.col("url")))
    totals = pages.groupBy("job_id").agg((F.count("*") + 1).alias("total"))
    events = pages.join(totals, "job_id").select(
        "job_id", F.timestamp_seconds(F.col("page_id") + 1_700_000_000).alias("ts"), F.col("page_id").alias("idx"), "total",
        "url", status.alias("status"), F.when(status == "ok", F.concat(F.lit("Title "), F.col("page_id"))).alias("title"),
        F.when(status != "ok", F.lit("went wrong")).alias("message"),
    )
    again = events.filter("idx % 3 = 0").withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))
    return events.unionByName(again)


def progress_log(spark, sf_dir):
    return Q.progress_log(_page_events(spark, sf_dir))


def job_progress(spark, sf_dir):
    return Q.job_progress(_page_events(spark, sf_dir))


def politeness_schedule(spark, sf_dir):
    return Q.politeness_schedule(test_pages(spark, sf_dir), 1.5, bucket=64)


def politeness_schedule_hot(spark, sf_dir):
    """Hash ids, one host with a third of the pages, and pages without URL."""
    number = F.col("page_id")
    url = F.when(number % 3 == 0, F.lit("https://hot.example.org/p")).when(number % 7 == 0, F.lit(None)).otherwise(F.col("url"))
    ids = F.concat(F.substring(F.md5(number.cast("string")), 1, 15), F.lit(""))
    pages = test_pages(spark, sf_dir).select(F.conv(ids, 16, 10).cast("bigint").alias("page_id"), url.alias("url"))
    return Q.politeness_schedule(pages, 1.5)


def rate_audit(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Q.rate_audit(events, "user_id", "event_id", 600.0, 86_400)


def _attempts(spark, sf_dir) -> DataFrame:
    """Fetches of up to four attempts each, from the event table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.floor(F.col("event_id") / 4).cast("bigint").alias("fetch_id"), (F.col("event_id") % 4 + 1).alias("attempt"),
        (F.col("event_type") == "purchase").alias("ok"),
        F.concat(F.col("event_type"), F.lit(" at "), F.col("event_id").cast("string")).alias("error"),
    )


def retry_ledger(spark, sf_dir):
    return Q.retry_ledger(_attempts(spark, sf_dir))


def retry_ledger_limited(spark, sf_dir):
    return Q.retry_ledger(_attempts(spark, sf_dir), max_attempts=3)


def manual_attention(spark, sf_dir):
    return Q.manual_attention(_nodes(spark, sf_dir))


def placeholders(spark, sf_dir):
    return Q.placeholders(_nodes(spark, sf_dir)).select("page_id", "pos", "tok")


def _patterns(spark, sf_dir) -> DataFrame:
    """Pattern table from the corpus: shapes of the article with a confidence by how common they are."""
    rows = C.content_nodes(_aug(spark, sf_dir), css="article").filter("kind = 'open'")
    counts = rows.groupBy(Q.shape().alias("shape")).agg(F.count("*").alias("n_confirmed"))
    block = F.when(F.col("shape") == "p", F.lit("paragraph")).when(F.col("shape").rlike("^h[1-6]"), F.lit("heading")).when(
        F.col("shape").rlike("^(ul|ol)"), F.lit("list")).otherwise("group")
    return counts.select("shape", block.alias("block_type"), (F.lit(1.0) / (1 + F.length("shape"))).alias("confidence"),
        "n_confirmed", (F.col("n_confirmed") + F.length("shape")).cast("bigint").alias("n_seen"))


def classify_structures(spark, sf_dir):
    rows = C.content_nodes(test_pages(spark, sf_dir), css="article")
    patterns = _patterns(spark, sf_dir).filter("shape != 'b'")
    return Q.classify_structures(rows, patterns, 0.3).withColumn("confidence", F.round("confidence", 4))


def learn_patterns(spark, sf_dir):
    rows = C.content_nodes(_aug(spark, sf_dir), css="article").filter("kind = 'open'")
    findings = rows.select(Q.shape().alias("shape"), F.lit("group").alias("block_type"), (F.col("pos") % 3 != 0).alias("confirmed"))
    return Q.learn_patterns(_patterns(spark, sf_dir), findings)


def learn_patterns_twice(spark, sf_dir):
    """A shape that is never confirmed, learned in two snapshots: rejections are not forgotten."""
    rows = C.content_nodes(_aug(spark, sf_dir), css="article").filter("kind = 'open'")
    findings = rows.select(Q.shape().alias("shape"), F.lit("group").alias("block_type"), (F.col("tag") == "p").alias("confirmed"))
    empty = _patterns(spark, sf_dir).filter(F.lit(False))
    return Q.learn_patterns(materialize(Q.learn_patterns(empty, findings)), findings)


# Block vocabularies of four page kinds: template, section, block type, heading level.
TEMPLATES = (
    ("article", 1, "heading", 2), ("article", 2, "image", None), ("article", 3, "paragraph", None),
    ("rates", 1, "heading", 3), ("rates", 2, "paragraph", None), ("rates", 3, "table", None), ("rates", 4, "image", None),
    ("quotes", 1, "quote", None), ("quotes", 2, "paragraph", None), ("quotes", 3, "heading", 2),
    ("lists", 1, "heading", 2), ("lists", 2, "list", None), ("lists", 3, "paragraph", None), ("lists", 4, "image", None),
    ("lists", 5, "table", None),
)


def _templates(spark) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "template string, section_pos int, block_type string, level bigint")


def pick_template(spark, sf_dir):
    return Q.pick_template(_blocks(spark, sf_dir), _templates(spark), test_pages(spark, sf_dir))


def pick_template_none(spark, sf_dir):
    """Pages against templates of tables only: most share no block type and still have their row."""
    return Q.pick_template(_blocks(spark, sf_dir), _templates(spark).filter("block_type = 'table'"), test_pages(spark, sf_dir))


def template_conformance(spark, sf_dir):
    blocks = materialize(_blocks(spark, sf_dir).select("page_id", "block_pos", "block_type", "level"))
    return Q.template_conformance(blocks, Q.pick_template(blocks, _templates(spark)), _templates(spark))


def host_report(spark, sf_dir):
    rows = Q.host_report(convert_pages(_aug(spark, sf_dir), css="article"))
    return rows.select("host", "content_source", "pages", "ok", "images")


QUERIES = {f.__name__: f for f in (
    flatten_token_elements, nested_list_deep, columns_with_blocks, convert_pages_layout, nested_list_block, image_block_caption, embed_block, gallery_block, columns_block,
    button_block, progress_log, job_progress, politeness_schedule, rate_audit, retry_ledger, retry_ledger_limited, politeness_schedule_hot, learn_patterns_twice, pick_template_none, manual_attention,
    placeholders, classify_structures, learn_patterns, pick_template, template_conformance, host_report,
)}
