"""Queries over blocks, page conversion and export rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.urls import url_host
from pageloom.operators import blocks as B, contract as K, export as X, media as M
from pageloom.plans.convert import convert_cleaned as run_cleaned, convert_pages, extracted_rows
from pageloom.session import materialize, shared_folder
from pageloom.sources import sinks
from pageloom.sources.tables import augmented_pages, test_pages


def _aug(spark, sf_dir) -> DataFrame:
    return augmented_pages(test_pages(spark, sf_dir))


def _block_rows(spark, sf_dir) -> DataFrame:
    return B.block_rows(K.clean_rows(extracted_rows(_aug(spark, sf_dir), css="article")))


def segment_blocks(spark, sf_dir):
    return B.segment_blocks(_block_rows(spark, sf_dir))


def _of_type(block_type: str):
    def query(spark, sf_dir):
        rows = B.segment_blocks(_block_rows(spark, sf_dir))
        return rows.filter(F.col("block_type") == block_type).select("page_id", "block_pos", "level", "markup")

    query.__name__ = f"{block_type}_block"
    query.__module__ = __name__
    return query


def join_blocks(spark, sf_dir):
    rows = B.join_blocks(_block_rows(spark, sf_dir))
    return rows.select("page_id", "blocks", "images", F.md5("body").alias("body_md5"))


def block_stats(spark, sf_dir):
    pages = _aug(spark, sf_dir)
    blocks = B.segment_blocks(B.block_rows(K.clean_rows(extracted_rows(pages, css="article"))))
    hosts = pages.select("page_id", url_host(F.col("url")).alias("host"))
    return B.block_stats(blocks, hosts)


def _faulty(spark, sf_dir) -> DataFrame:
    """Pages whose article became blank on some and a bare wrapper on others."""
    html = (
        F.when(F.col("page_id") % 5 == 0, F.regexp_replace("html", "<article>.*</article>", "<article> </article>"))
        .when(F.col("page_id") % 5 == 1,
              F.regexp_replace("html", "<article>.*</article>", "<article><div><p> </p></div></article>"))
        .otherwise(F.col("html"))
    )
    return test_pages(spark, sf_dir).withColumn("html", html)


def page_outcomes(spark, sf_dir):
    rows = convert_pages(_faulty(spark, sf_dir), css="article")
    return rows.select("page_id", "url", "title", "status", "message", "images")


def job_summary(spark, sf_dir):
    from pageloom.operators.quality import job_summary as summarize

    return summarize(convert_pages(_faulty(spark, sf_dir), css="article"))


def _converted(spark, sf_dir) -> DataFrame:
    """Converted pages as a stored stage; ids and items both read it."""
    return materialize(convert_pages(_aug(spark, sf_dir), css="article")).filter("status = 'ok'")


def assign_post_ids(spark, sf_dir):
    return X.assign_post_ids(_converted(spark, sf_dir), sideload=True, bucket=64)


def content_items(spark, sf_dir):
    pages = _converted(spark, sf_dir)
    return X.content_items(pages, X.assign_post_ids(pages, sideload=False, bucket=X.DENSE))


def _images(spark, sf_dir) -> DataFrame:
    rows = extracted_rows(_aug(spark, sf_dir), css="article").filter("kind = 'image'")
    return rows.select("page_id", "img_index", F.coalesce("src", F.lit("")).alias("src"), "alt")


def attachment_items(spark, sf_dir):
    ids = X.assign_post_ids(_converted(spark, sf_dir), sideload=True, bucket=X.DENSE)
    return X.attachment_items(_images(spark, sf_dir), ids)


def item_markup(spark, sf_dir):
    pages = _converted(spark, sf_dir)
    ids = X.assign_post_ids(pages, sideload=True, bucket=X.DENSE)
    items = X.content_items(pages, ids).unionByName(X.attachment_items(_images(spark, sf_dir), ids))
    return items.select("post_id", F.md5(X.item_markup()).alias("item_md5"))


def raw_items(spark, sf_dir):
    """Raw backup: extracted content with its images, whatever becomes of the page later."""
    rows = M.raw_html(extracted_rows(_aug(spark, sf_dir), css="article"))
    return rows.select("page_id", "url", F.md5("html").alias("html_md5"))


def slug_collisions(spark, sf_dir):
    pages = _converted(spark, sf_dir)
    return X.slug_collisions(X.content_items(pages, X.assign_post_ids(pages, sideload=False, bucket=X.DENSE)))


def compare_exports(spark, sf_dir):
    pages = _faulty(spark, sf_dir)
    raw = extracted_rows(pages, css="article").filter("has_content").select("page_id", "url").distinct()
    return X.compare_exports(raw, convert_pages(pages, css="article").filter("status = 'ok'"))


def archive_raw_pages(spark, sf_dir):
    path = f"{shared_folder(spark).rstrip('/')}/pageloom/{uuid.uuid4().hex}"
    sinks.archive_raw_pages(test_pages(spark, sf_dir), path)
    return spark.read.parquet(path).select("page_id", "raw_name", F.md5("html").alias("html_md5"))


def export_roundtrip(spark, sf_dir):
    """Items written as sharded import files and read back from them."""
    pages = _converted(spark, sf_dir)
    ids = X.assign_post_ids(pages, sideload=True, bucket=X.DENSE)
    items = X.content_items(pages, ids).unionByName(X.attachment_items(_images(spark, sf_dir), ids))
    path = f"{shared_folder(spark).rstrip('/')}/pageloom/{uuid.uuid4().hex}"
    sinks.write_wxr(items, path, items_per_shard=200)
    rows = sinks.read_export(spark, path)
    return rows.select("post_id", "parent_id", "title", "link", "post_name", "post_type",
                       F.md5("content").alias("content_md5"))


def fallback_paragraph(spark, sf_dir):
    """An element of no known kind at the end of every article."""
    unknown = F.concat(F.lit("<section>Unknown <span>element</span> <i>"), F.col("page_id").cast("string"),
                       F.lit("</i></section></article>"))
    pages = test_pages(spark, sf_dir).withColumn("html", F.replace(F.col("html"), F.lit("</article>"), unknown))
    blocks = B.segment_blocks(B.block_rows(K.clean_rows(extracted_rows(pages, css="article"))))
    return blocks.filter(F.col("markup").contains("Unknown")).select("page_id", "block_type", "markup")


def convert_cleaned(spark, sf_dir):
    """Tokenized articles as an outside cleaner's output, some refused, some missing."""
    pages = _aug(spark, sf_dir)
    rows = extracted_rows(pages, css="article")
    cleaned = M.tokenize_images(rows).filter("page_id % 9 != 4").select(
        "page_id", F.concat(F.lit("```html\n"), "html", F.lit("\n```")).alias("html"), (F.col("page_id") % 9 == 5).alias("refused"))
    media = M.plan_media(rows.filter("kind = 'image'"), "remote")
    done = run_cleaned(pages, cleaned, media)
    return done.select("page_id", "title", "blocks", "images", "status", "message", F.md5("body").alias("body_md5"))


def convert_cleaned_checked(spark, sf_dir):
    """Output of a cleaner that lost, repeated, invented, moved or kept its tokens; one article for every page."""
    title = F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)", 1)
    pages = test_pages(spark, sf_dir).select("page_id", "url", F.concat(
        F.lit("<title>"), title, F.lit("</title><article><p>Text</p><img src='/a.png'><img src='/b.png'></article>")).alias("html"))
    step = F.col("page_id") % 5
    tokens = F.when(step == 0, "<p>⟦IMG_0⟧</p><p>⟦IMG_1⟧</p>").when(step == 1, "<p>⟦IMG_0⟧</p>").when(
        step == 2, "<p>⟦IMG_0⟧</p><p>⟦IMG_0⟧</p><p>⟦IMG_1⟧</p>").when(step == 3, "<p>⟦IMG_0⟧</p><p>⟦IMG_1⟧</p><p>⟦IMG_8⟧</p>").otherwise(
        "<p>⟦IMG_1⟧</p><p>⟦IMG_0⟧</p>")
    cleaned = pages.select("page_id", F.concat(F.lit("<p>Text</p>"), tokens).alias("html"), F.lit(False).alias("refused"))
    media = M.plan_media(extracted_rows(pages, css="article").filter("kind = 'image'"), "remote")
    done = run_cleaned(pages, cleaned, media)
    return done.select("page_id", "blocks", "images", "status", "message")


def convert_pages_clean(spark, sf_dir):
    """Every article with a share bar, a sign-up and a related list; none of them is published."""
    extra = F.lit("<div class='share-bar'><p>Share me</p></div><section id='newsletter'><div><p>Sign up</p></div></section>"
                  "<ul class='related posts'><li>More</li></ul></article>")
    pages = _aug(spark, sf_dir).withColumn("html", F.replace(F.col("html"), F.lit("</article>"), extra))
    rows = convert_pages(pages, css="article", boilerplate=False)
    return rows.select("page_id", "title", "blocks", "images", "status", F.md5("body").alias("body_md5"))


def write_wxr(spark, sf_dir):
    """Shape of every written file: first and last line, and the items between them."""
    pages = _converted(spark, sf_dir)
    path = f"{shared_folder(spark).rstrip('/')}/pageloom/{uuid.uuid4().hex}"
    sinks.write_wxr(X.content_items(pages, X.assign_post_ids(pages, sideload=False, bucket=X.DENSE)), path, items_per_shard=100)
    files = spark.read.text(path, wholetext=True)
    return files.groupBy("shard").agg(
        F.count("*").alias("files"),
        F.sum(F.size(F.regexp_extract_all("value", F.lit("(?m)^    <item>$"), F.lit(0)))).alias("items"),
        F.min(F.col("value").rlike(r'(?s)\A<\?xml version="1.0".*</rss>\s*\z')).alias("complete"),
    ).withColumn("shard", F.col("shard").cast("bigint"))


TYPES = ("paragraph", "heading", "list", "quote", "code", "table", "separator", "image")
QUERIES = {f.__name__: f for f in (
    segment_blocks, *[_of_type(t) for t in TYPES], join_blocks, block_stats, page_outcomes, job_summary,
    assign_post_ids, content_items, attachment_items, item_markup, raw_items, slug_collisions, compare_exports,
    archive_raw_pages, export_roundtrip, write_wxr, fallback_paragraph, convert_cleaned, convert_cleaned_checked,
    convert_pages_clean,
)}
