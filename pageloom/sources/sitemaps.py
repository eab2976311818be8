"""Sitemaps: reading, parsing, and following indexes to page URLs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from pageloom.functions.text import strip
from pageloom.session import materialize

_SCHEMA = "url array<struct<loc: array<string>>>, sitemap array<struct<loc: array<string>>>, _corrupt_record string"


def _gunzip_udf():
    """Arrow UDF; a local function, so that executors need no copy of this package."""
    import gzip

    def unpack(content: bytes) -> bytes:
        try:
            return gzip.decompress(content)
        except (OSError, EOFError):
            return content

    def unpack_batch(content: pd.Series) -> pd.Series:
        return content.map(unpack)

    return F.pandas_udf(unpack_batch, T.BinaryType())


def gunzip_bodies(docs: DataFrame) -> DataFrame:
    """``(doc_url, body)`` as text from ``(doc_url, content binary)``.

    Compressed by name (``.gz``) or by magic bytes; content that does not unpack stays as it is.
    Only compressed documents pass through Python.
    """
    packed = F.col("doc_url").endswith(".gz") | (F.substring("content", 1, 2) == F.unhex(F.lit("1F8B")))
    plain = docs.filter(~packed)
    unpacked = docs.filter(packed).withColumn("content", _gunzip_udf()("content"))
    body = F.expr("try_validate_utf8(cast(content as string))")
    return plain.unionByName(unpacked).select("doc_url", body.alias("body"))


def read_sitemaps(spark: SparkSession, path: str, base_url: str = "") -> DataFrame:
    """``(doc_url, body)`` from files; the address is ``base_url`` plus the file name."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", "[^/]*$", 0)
    return gunzip_bodies(files.select(F.concat(F.lit(base_url), name).alias("doc_url"), "content"))


def _parsed(docs: DataFrame) -> DataFrame:
    trimmed = F.regexp_replace("body", r"^[\x{FEFF}\s]+", "")
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
    root = F.lower(F.regexp_extract("body", r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<![^>]*>|\s)*<(?:[\w-]+:)?([\w-]+)", 1))
    parsed = docs.select("doc_url", trimmed.alias("body")).withColumn("_x", F.from_xml("body", F.lit(_SCHEMA), options))
    return parsed.select("doc_url", root.alias("root"), "_x")


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """``(doc_url, root, pos, loc)``: first non-empty direct ``<loc>`` of each ``<url>``/``<sitemap>``."""
    entries = F.concat(F.coalesce("_x.url", F.array()), F.coalesce("_x.sitemap", F.array()))
    rows = _parsed(docs).filter(F.col("_x._corrupt_record").isNull()).select(
        "doc_url", "root", F.posexplode(entries).alias("pos", "_entry")
    )
    filled = F.filter("_entry.loc", lambda loc: strip(loc) != "")
    return rows.select(
        "doc_url", "root", F.col("pos").cast("bigint").alias("pos"), strip(F.get(filled, F.lit(0))).alias("loc")
    ).filter(F.col("loc").isNotNull())


def bad_sitemaps(docs: DataFrame) -> DataFrame:
    """``(doc_url)`` of documents that are not well-formed XML."""
    return _parsed(docs).filter(F.col("_x").isNull() | F.col("_x._corrupt_record").isNotNull()).select("doc_url")


def _ranked(rows: DataFrame) -> DataFrame:
    """Add ``_rank``, the place from 1 in ``(visit, pos)`` order per root.

    In two levels: within a visited document, whose entries are one cell of the source, and over the documents
    before it; so a root with very many URLs is not one task.
    """
    per_visit = rows.groupBy("root_url", "visit").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("root_url").orderBy("visit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_visit.select("root_url", "visit", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("root_url", "visit").orderBy("pos"))
    return rows.join(offsets, ["root_url", "visit"]).withColumn("_rank", F.col("_offset") + inside).drop("_offset")


def _visits(entries: DataFrame, roots: DataFrame, max_sitemaps: int | None) -> tuple[DataFrame, DataFrame]:
    """``(root_url, doc_url, visit)`` of the sitemaps visited, and ``(root_url, doc_url)`` of those left out."""
    children = entries.filter(F.col("root") == "sitemapindex").select("doc_url", "pos", F.col("loc").alias("_child"))
    first = F.lit(0).cast("bigint").alias("visit")
    visited = materialize(roots.select("root_url", F.col("root_url").alias("doc_url"), first).distinct())
    frontier, left_out = visited, visited.filter(F.lit(False)).select("root_url", "doc_url")
    while True:
        found = frontier.join(children, "doc_url").groupBy("root_url", F.col("_child").alias("doc_url")).agg(
            F.min(F.struct("visit", "pos")).alias("_order")
        )
        fresh = found.join(visited, ["root_url", "doc_url"], "left_anti").select("root_url", "doc_url", "_order.*")
        done = visited.groupBy("root_url").agg(F.max("visit").alias("_last"))
        level = materialize(_ranked(fresh).join(done, "root_url").select(
            "root_url", "doc_url", (F.col("_last") + F.col("_rank")).cast("bigint").alias("visit")))
        if max_sitemaps is not None:
            left_out = left_out.unionByName(level.filter(F.col("visit") >= max_sitemaps).select("root_url", "doc_url"))
            level = level.filter(F.col("visit") < max_sitemaps)
        frontier = level
        if frontier.isEmpty():
            return visited, left_out
        visited = visited.unionByName(frontier)


def _found_urls(entries: DataFrame, visited: DataFrame) -> DataFrame:
    """``(root_url, url, ordinal)`` of the distinct page URLs in visited sitemaps."""
    pages = entries.filter(F.col("root") != "sitemapindex").select("doc_url", "pos", F.col("loc").alias("url"))
    urls = visited.join(pages, "doc_url").groupBy("root_url", "url").agg(F.min(F.struct("visit", "pos")).alias("_order"))
    return _ranked(urls.select("root_url", "url", "_order.*")).select(
        "root_url", F.col("_rank").cast("bigint").alias("ordinal"), "url")


def expand_sitemaps(entries: DataFrame, roots: DataFrame, max_sitemaps: int | None = None,
                    max_urls: int | None = None) -> DataFrame:
    """``(root_url, ordinal, url)``: page URLs below each root, in discovery order.

    Breadth first for all roots at once. Per root each sitemap is visited once, in queue order. ``max_sitemaps`` and
    ``max_urls`` limit a root, which :func:`expansion_limits` reports; without them nothing is left out. Every level
    is written out, so cycles end and the plan does not grow.
    """
    visited, _ = _visits(entries, roots, max_sitemaps)
    urls = _found_urls(entries, visited)
    return urls if max_urls is None else urls.filter(F.col("ordinal") <= max_urls)


def expansion_limits(entries: DataFrame, roots: DataFrame, max_sitemaps: int | None = None,
                     max_urls: int | None = None) -> DataFrame:
    """``(root_url, sitemaps, urls, sitemaps_left_out, urls_left_out, truncated)`` of an expansion with these limits.

    What is below a sitemap that was left out is not counted.
    """
    visited, left_out = _visits(entries, roots, max_sitemaps)
    over = F.lit(False) if max_urls is None else F.col("ordinal") > max_urls
    urls = _found_urls(entries, visited).groupBy("root_url").agg(
        F.count_if(~over).alias("urls"), F.count_if(over).alias("urls_left_out"))
    seen = visited.groupBy("root_url").agg(F.count("*").alias("sitemaps"))
    missed = left_out.distinct().groupBy("root_url").agg(F.count("*").alias("sitemaps_left_out"))
    none = F.lit(0).cast("bigint")
    return seen.join(urls, "root_url", "left").join(missed, "root_url", "left").select(
        "root_url", "sitemaps", F.coalesce("urls", none).alias("urls"),
        F.coalesce("sitemaps_left_out", none).alias("sitemaps_left_out"), F.coalesce("urls_left_out", none).alias("urls_left_out"),
        (F.coalesce("sitemaps_left_out", none) + F.coalesce("urls_left_out", none) > 0).alias("truncated"))
