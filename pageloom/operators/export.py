"""Export rows: dense ids, items, attachments and their XML text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.functions.html import cdata_wrap, html_escape
from pageloom.functions.text import gmt_stamp, or_else, rfc1123, slugify, strip
from pageloom.functions.urls import image_title
from pageloom.operators.skew import bucketed_prefix, ranged_prefix


#: Step of ``bucket`` for page numbers that are known to be dense.
DENSE = 100_000


@dataclass(frozen=True)
class ExportOptions:
    """Settings of one export; ``stamp`` is a parameter so that runs can be repeated."""

    author: str = "admin"
    post_type: str = "page"
    status: str = "publish"
    site_title: str = "Imported Content"
    stamp: str = "2024-01-01 00:00:00"
    sideload: bool = False


def assign_post_ids(pages: DataFrame, sideload: bool, order: str = "page_id", bucket: int | None = None) -> DataFrame:
    """``(page_id, post_id)``: dense ids in page order, leaving room for each page's attachments.

    ``bucket`` may be given where the numbers are known to be dense; any others, such as hashes, are counted
    by sampled ranges.
    """
    weight = F.lit(1) + (F.col("images") if sideload else F.lit(0))
    slim = pages.select("page_id", *([] if order == "page_id" else [order]), "images")
    if bucket is None:
        ranked = ranged_prefix(slim, order, weight, "_before")
    else:
        ranked = bucketed_prefix(slim, order, weight, "_before", bucket)
    return ranked.select("page_id", (F.col("_before") + 1).alias("post_id"))


def _stamp(options: ExportOptions) -> Column:
    return F.to_timestamp(F.lit(options.stamp))


def content_items(pages: DataFrame, ids: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    """One item per converted page; the slug comes from the title, not the address."""
    return pages.join(ids, "page_id").select(
        "post_id", F.lit(0).cast("bigint").alias("parent_id"), F.lit("page").alias("kind"), "title",
        F.col("url").alias("link"), rfc1123(_stamp(options)).alias("pub_date"),
        F.lit(options.author).alias("creator"), F.col("body").alias("content"),
        gmt_stamp(_stamp(options)).alias("post_date"), F.lit("closed").alias("comment_status"),
        F.lit("closed").alias("ping_status"), slugify(F.col("title")).alias("post_name"),
        F.lit(options.status).alias("status"), F.lit(options.post_type).alias("post_type"),
        F.lit(None).cast("string").alias("attachment_url"), F.lit(None).cast("string").alias("alt"),
    )


def attachment_items(images: DataFrame, ids: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    """One item per image reference, numbered after its page in the order of ``img_index``.

    Numbers leave no gap, so they fit the room that ``images`` gave the page, whatever the indexes are.
    """
    title = or_else(strip(F.col("alt")), image_title(F.col("src")))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("img_index"))
    rows = images.join(ids, "page_id").withColumns({"title": title, "_number": number})
    return rows.select(
        (F.col("post_id") + F.col("_number")).alias("post_id"), F.col("post_id").alias("parent_id"),
        F.lit("attachment").alias("kind"), "title", F.col("src").alias("link"),
        rfc1123(_stamp(options)).alias("pub_date"), F.lit(options.author).alias("creator"),
        F.lit("").alias("content"), gmt_stamp(_stamp(options)).alias("post_date"),
        F.lit("closed").alias("comment_status"), F.lit("closed").alias("ping_status"),
        slugify(F.col("title")).alias("post_name"), F.lit("inherit").alias("status"),
        F.lit("attachment").alias("post_type"), F.col("src").alias("attachment_url"), "alt",
    )


def _element(name: str, value: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"        <{name}{attrs}>"), value, F.lit(f"</{name}>"))


def item_markup() -> Column:
    """XML text of one item row; usable on its own."""
    fields = [
        _element("title", html_escape(F.col("title"))),
        _element("link", html_escape(F.col("link"))),
        _element("pubDate", F.col("pub_date")),
        _element("dc:creator", cdata_wrap(F.col("creator"))),
        _element("guid", html_escape(F.col("link")), ' isPermaLink="false"'),
        _element("description", F.lit("")),
        _element("content:encoded", cdata_wrap(F.col("content"))),
        _element("excerpt:encoded", cdata_wrap(F.lit(""))),
        _element("wp:post_id", F.col("post_id").cast("string")),
        _element("wp:post_date", F.col("post_date")),
        _element("wp:post_date_gmt", F.col("post_date")),
        _element("wp:comment_status", F.col("comment_status")),
        _element("wp:ping_status", F.col("ping_status")),
        _element("wp:post_name", cdata_wrap(F.col("post_name"))),
        _element("wp:status", F.col("status")),
        _element("wp:post_parent", F.col("parent_id").cast("string")),
        _element("wp:menu_order", F.lit("0")),
        _element("wp:post_type", F.col("post_type")),
        _element("wp:post_password", F.lit("")),
        _element("wp:is_sticky", F.lit("0")),
    ]
    attachment = F.concat(
        F.lit("\n"), _element("wp:attachment_url", html_escape(F.col("attachment_url"))),
        F.lit("\n        <wp:postmeta>\n            <wp:meta_key>_wp_attachment_image_alt</wp:meta_key>\n"
              "            <wp:meta_value>"), cdata_wrap(F.col("alt")),
        F.lit("</wp:meta_value>\n        </wp:postmeta>"),
    )
    return F.concat(
        F.lit("    <item>\n"), F.concat_ws("\n", *fields), F.coalesce(attachment, F.lit("")), F.lit("\n    </item>")
    )


# Namespaces of the export format.
NAMESPACES = (
    ("excerpt", "http://wordpress.org/export/1.2/excerpt/"),
    ("content", "http://purl.org/rss/1.0/modules/content/"),
    ("wfw", "http://wellformedweb.org/CommentAPI/"),
    ("dc", "http://purl.org/dc/elements/1.1/"),
    ("wp", "http://wordpress.org/export/1.2/"),
)
FOOTER = "</channel>\n</rss>"


def envelope_header(options: ExportOptions) -> Column:
    """Everything before the first item."""
    spaces = "\n".join(f'    xmlns:{name}="{uri}"' for name, uri in NAMESPACES)
    author = cdata_wrap(F.lit(options.author))
    return F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"\n{spaces}>\n<channel>\n    <title>'),
        html_escape(F.lit(options.site_title)),
        F.lit("</title>\n    <link>https://example.com</link>\n    <description>Migrated content</description>\n"
              "    <pubDate>"), rfc1123(_stamp(options)),
        F.lit("</pubDate>\n    <language>en-US</language>\n    <wp:wxr_version>1.2</wp:wxr_version>\n"
              "    <wp:author>\n        <wp:author_login>"), author,
        F.lit("</wp:author_login>\n        <wp:author_display_name>"), author,
        F.lit("</wp:author_display_name>\n    </wp:author>"),
    )


def slug_collisions(items: DataFrame) -> DataFrame:
    """``(post_name, items, first_post_id)`` of names more than one page would get."""
    return (
        items.groupBy("post_name").agg(F.count("*").alias("items"), F.min("post_id").alias("first_post_id"))
        .filter(F.col("items") > 1)
    )


def compare_exports(raw_pages: DataFrame, block_pages: DataFrame) -> DataFrame:
    """``(page_id, url)`` of pages in the raw export that the block export lost."""
    return raw_pages.select("page_id", "url").join(block_pages.select("page_id"), "page_id", "left_anti")
