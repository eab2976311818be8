"""Queries over single columns: URLs, names, text and escaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.functions import html as H, text as T, urls as U
from pageloom.operators.nodes import html_nodes
from pageloom.sources.tables import augmented_pages, test_pages


def _doc_title():
    return F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)", 1)


def _urls(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    return test_pages(spark, sf_dir).select("page_id", build(F.col("url")).alias(name))


def url_host(spark, sf_dir):
    return _urls(spark, sf_dir, "host", U.url_host)


def url_netloc(spark, sf_dir):
    return _urls(spark, sf_dir, "netloc", U.url_netloc)


def url_slug(spark, sf_dir):
    return _urls(spark, sf_dir, "slug", U.url_slug)


def raw_file_name(spark, sf_dir):
    pages = test_pages(spark, sf_dir)
    return pages.select("page_id", U.raw_file_name(F.col("page_id") + 1, F.col("url")).alias("raw_name"))


# Reference forms resolved against every page address.
REFERENCES = ("", "/The", "//cdn.example.org/a.png", "?q=1", "#top", "a.png", "../pic/a.png", "./b/./c.jpg",
              "mailto:x@example.org", "https://example.org/z")


def resolve_url(spark, sf_dir):
    refs = F.posexplode(F.array(*[F.lit(r) for r in REFERENCES])).alias("n", "ref")
    rows = test_pages(spark, sf_dir).select("page_id", "url", refs)
    return rows.select(
        "page_id", F.col("n").cast("bigint"), U.resolve_url(F.col("url"), F.col("ref")).alias("resolved")
    )


def slugify(spark, sf_dir):
    return test_pages(spark, sf_dir).select("page_id", T.slugify(_doc_title()).alias("slug"))


def cdata_wrap(spark, sf_dir):
    html = F.replace(F.col("html"), F.lit("</p>"), F.lit("]]></p>"))
    return test_pages(spark, sf_dir).select("page_id", F.md5(H.cdata_wrap(html)).alias("wrapped_md5"))


def html_escape(spark, sf_dir):
    return test_pages(spark, sf_dir).select("page_id", F.md5(H.html_escape(F.col("html"))).alias("escaped_md5"))


def trim_title_suffix(spark, sf_dir):
    pages = test_pages(spark, sf_dir)
    suffixed = F.concat(H.decode_entities(_doc_title()), F.lit(" – "), U.url_host(F.col("url")))
    return pages.select(
        "page_id", T.trim_title_suffix(H.decode_entities(_doc_title())).alias("title"),
        T.trim_title_suffix(suffixed).alias("trimmed"),
    )


def collapse_ws(spark, sf_dir):
    text = F.regexp_replace("html", "<[^>]*>", " \n ")
    return test_pages(spark, sf_dir).select("page_id", F.md5(T.collapse_ws(text)).alias("text_md5"))


def strip_code_fence(spark, sf_dir):
    fenced = F.concat(F.lit("```html\n"), F.col("html"), F.lit("\n```"))
    return test_pages(spark, sf_dir).select("page_id", F.md5(T.strip_code_fence(fenced)).alias("html_md5"))


def decode_entities(spark, sf_dir):
    rows = html_nodes(test_pages(spark, sf_dir)).filter((F.col("kind") == "text") & F.col("tok").contains("&"))
    return rows.select("page_id", "pos", H.decode_entities(F.col("tok")).alias("text"))


def wxr_dates(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", T.rfc1123(F.col("ts")).alias("pub_date"), T.gmt_stamp(F.col("ts")).alias("post_date"))


def _image_refs(spark, sf_dir) -> DataFrame:
    tags = F.posexplode(F.regexp_extract_all("html", F.lit("<(?:img|graphic)[^>]*>"), F.lit(0))).alias("n", "tag")
    rows = augmented_pages(test_pages(spark, sf_dir)).select("page_id", "url", tags)
    src = F.regexp_extract("tag", '(?:src|url)="([^"]*)"', 1)
    resolved = U.resolve_url(F.col("url"), src)
    return rows.filter(src != "").select("page_id", F.col("n").cast("bigint"), resolved.alias("src"))


def image_title(spark, sf_dir):
    return _image_refs(spark, sf_dir).select("page_id", "n", U.image_title(F.col("src")).alias("title"))


# Content types as servers send them, assigned to the images in turn.
CONTENT_TYPES = ("image/jpeg", "image/png; charset=binary", "", "image/webp", "application/x-unknown")


def _typed_refs(spark, sf_dir) -> DataFrame:
    kinds = F.array(*[F.lit(c) for c in CONTENT_TYPES])
    return _image_refs(spark, sf_dir).withColumn(
        "content_type", F.get(kinds, ((F.col("page_id") + F.col("n")) % len(CONTENT_TYPES)).cast("int"))
    )


def safe_filename(spark, sf_dir):
    rows = _typed_refs(spark, sf_dir)
    no_dot = F.regexp_replace("src", r"\.(jpg|png)", "")
    return rows.select(
        "page_id", "n", U.safe_filename(F.col("src"), F.col("content_type")).alias("file_name"),
        U.safe_filename(no_dot, F.col("content_type")).alias("typed_name"),
    )


def mime_type(spark, sf_dir):
    rows = _typed_refs(spark, sf_dir)
    return rows.select(
        "page_id", "n", U.mime_extension(F.col("content_type")).alias("extension"),
        U.mime_type(F.col("content_type"), U.safe_filename(F.col("src"))).alias("mime"),
    )


QUERIES = {f.__name__: f for f in (
    url_host, url_netloc, url_slug, raw_file_name, resolve_url, slugify, cdata_wrap, html_escape,
    trim_title_suffix, collapse_ws, strip_code_fence, decode_entities, wxr_dates, image_title, safe_filename,
    mime_type,
)}
