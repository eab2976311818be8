"""Queries over URL lists, selector lists, sitemaps and the bundle, all derived from the page table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.html import html_escape
from pageloom.functions.urls import url_host
from pageloom.operators import export as X, media as M
from pageloom.plans.convert import convert_pages, extracted_rows
from pageloom.session import materialize, shared_folder
from pageloom.sources import lists as L, sinks, sitemaps as S
from pageloom.sources.tables import test_pages

URLS_PER_MAP = 100
MAPS_PER_INDEX = 1000


def read_url_list(spark, sf_dir):
    """List lines in every shape: comments, blanks, padding, titles, titles with a bar, empty titles."""
    step, url = F.col("page_id") % 6, F.col("url")
    line = (
        F.when(step == 0, F.concat(F.lit("# "), url)).when(step == 1, F.lit("   "))
        .when(step == 2, F.concat(F.lit("  "), url, F.lit("\t")))
        .when(step == 3, F.concat(url, F.lit(" | Rates"))).when(step == 4, F.concat(url, F.lit("|A | B ")))
        .otherwise(F.concat(url, F.lit(" |")))
    )
    return L.parse_url_lines(test_pages(spark, sf_dir).select(F.col("page_id").alias("line_no"), line.alias("line")))


def inline_urls(spark, sf_dir):
    urls = F.array(F.concat(F.lit(" "), F.col("url"), F.lit("\n")), F.lit(""), F.lit("# note"), F.lit("  "), F.col("url"))
    return L.request_urls(test_pages(spark, sf_dir).select(F.col("page_id").alias("request_id"), urls.alias("urls")))


def _site_urls(spark, sf_dir) -> DataFrame:
    """Site roots, so that many pages share a URL."""
    site = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    return test_pages(spark, sf_dir).select(site.alias("url"), F.col("page_id").alias("ordinal"))


def dedup_urls_ordered(spark, sf_dir):
    return L.dedup_urls_ordered(_site_urls(spark, sf_dir))


def cap_urls(spark, sf_dir):
    return L.cap_urls(L.dedup_urls_ordered(_site_urls(spark, sf_dir)), 40)


def selectors_table(spark, sf_dir):
    host = url_host(F.col("url"))
    line = (
        F.when(F.col("page_id") % 3 == 0, F.concat(host, F.lit(" = article.a"), (F.col("page_id") % 5).cast("string")))
        .when(F.col("page_id") % 3 == 1, F.concat(host, F.lit("=a[x=1] ")))
        .otherwise(F.concat(host, F.lit(" = ")))
    )
    return L.selectors_table(test_pages(spark, sf_dir).select(F.col("page_id").alias("line_no"), line.alias("line")))


def _sitemap_docs(spark, sf_dir) -> DataFrame:
    """One URL map per host and hundred page numbers, and indexes over those, each with itself as a child.

    Groups are bounded by the numbers they cover, however many pages a host has.
    """
    pages = test_pages(spark, sf_dir).select(
        "page_id", "url", url_host(F.col("url")).alias("host"),
        F.floor(F.col("page_id") / URLS_PER_MAP).cast("bigint").alias("part"),
    )
    escaped = html_escape(F.col("url"))
    entry = F.when(
        F.col("page_id") % 3 == 0,
        F.concat(F.lit("<url><image:image><image:loc>https://x.example/i.png</image:loc></image:image><loc> "), escaped,
                 F.lit(" </loc></url><url><loc> </loc></url>")),
    ).otherwise(F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc><lastmod>2024-01-01</lastmod></url>")))
    name = F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap-"), F.col("part").cast("string"), F.lit(".xml"))
    maps = pages.withColumn("_e", entry).groupBy("host", "part").agg(
        F.expr("listagg(_e, '') within group (order by page_id)").alias("_body")
    )
    head = "\n ﻿<?xml version=\"1.0\" encoding=\"UTF-8\"?>\n"
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    url_maps = maps.select(name.alias("doc_url"), F.concat(
        F.lit(f'{head}<urlset {space} xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'), "_body",
        F.lit("</urlset>")).alias("body"))
    index_no = F.floor(F.col("part") / MAPS_PER_INDEX).cast("string")
    index_url = F.concat(F.lit("https://"), F.col("host"), F.lit("/index-"), index_no, F.lit(".xml"))
    child = F.concat(F.lit("<sitemap><loc>"), name, F.lit("</loc></sitemap>"))
    indexes = maps.select(index_url.alias("doc_url"), "part", child.alias("_c")).groupBy("doc_url").agg(
        F.expr("listagg(_c, '') within group (order by part)").alias("_body")
    ).select("doc_url", F.concat(
        F.lit(f"<sitemapindex {space}><sitemap><loc>"), "doc_url", F.lit("</loc></sitemap>"), "_body",
        F.lit("</sitemapindex>")).alias("body"))
    return url_maps.unionByName(indexes)


def sitemap_entries(spark, sf_dir):
    return S.sitemap_entries(_sitemap_docs(spark, sf_dir)).filter("root = 'urlset'").select("doc_url", "root", "loc")


def bad_sitemaps(spark, sf_dir):
    docs = _sitemap_docs(spark, sf_dir)
    cut = F.when(F.col("doc_url").contains("sitemap-1"), F.replace(F.col("body"), F.lit("</urlset>"), F.lit("")))
    return S.bad_sitemaps(docs.withColumn("body", F.coalesce(cut, F.col("body"))))


def read_gzip_sitemaps(spark, sf_dir):
    """Documents compressed by Spark's own text writer, then read as files."""
    docs = _sitemap_docs(spark, sf_dir)
    path = f"{shared_folder(spark).rstrip('/')}/pageloom/{uuid.uuid4().hex}"
    flat = F.regexp_replace("body", "[\n﻿]", "")
    docs.select(flat.alias("value")).write.option("compression", "gzip").text(path)
    bodies = S.read_sitemaps(spark, f"{path}/*.gz")
    lines = bodies.select(F.explode(F.split("body", "\n")).alias("body")).filter("body != ''")
    return lines.groupBy(F.md5("body").alias("body_md5")).agg(F.count("*").alias("documents"))


def expand_sitemaps(spark, sf_dir):
    entries = materialize(S.sitemap_entries(_sitemap_docs(spark, sf_dir)))
    roots = entries.filter("root = 'sitemapindex'").select(F.col("doc_url").alias("root_url")).distinct()
    return S.expand_sitemaps(entries, roots)


def bundle_add(spark, sf_dir):
    rows = _site_urls(spark, sf_dir)
    pages = rows.select(F.col("url").alias("link"), F.concat(F.lit("t"), F.col("ordinal").cast("string")).alias("title"),
                        F.col("ordinal").cast("string").alias("content"), F.col("ordinal").alias("added"))
    return L.bundle_add(pages.filter("added % 2 = 0"), pages.filter("added % 2 = 1"))


def bundle_remove(spark, sf_dir):
    secure = _site_urls(spark, sf_dir).filter("url like 'https%'").select(F.col("url").alias("link")).distinct()
    return L.bundle_remove(bundle_add(spark, sf_dir), secure)


def write_dual_export(spark, sf_dir):
    """Both exports of pages of which some end up empty, read back from their files."""
    from pageloom.plans.blocks_export import _faulty

    pages = _faulty(spark, sf_dir)
    converted = materialize(convert_pages(pages, css="article"))
    good = converted.filter("status = 'ok'")
    bodies = M.raw_html(extracted_rows(pages, css="article").filter("has_content")).withColumnRenamed("html", "body")
    raw = materialize(bodies.join(converted.select("page_id", "title", "images"), "page_id"))
    items = X.content_items(good, X.assign_post_ids(good, sideload=False, bucket=X.DENSE))
    raw_items = X.content_items(raw, X.assign_post_ids(raw, sideload=False, bucket=X.DENSE))
    path = f"{shared_folder(spark).rstrip('/')}/pageloom/{uuid.uuid4().hex}"
    sinks.write_dual_export(items, raw_items, path, items_per_shard=100)
    both = sinks.read_export(spark, path).withColumn("export", F.lit("blocks")).unionByName(
        sinks.read_export(spark, f"{path}-raw").withColumn("export", F.lit("raw")))
    return both.select("export", "post_id", "title", "link")


QUERIES = {f.__name__: f for f in (
    read_url_list, inline_urls, dedup_urls_ordered, cap_urls, selectors_table, sitemap_entries, bad_sitemaps,
    read_gzip_sitemaps, expand_sitemaps, bundle_add, bundle_remove, write_dual_export,
)}
