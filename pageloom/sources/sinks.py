"""Writing exports and archives, and reading exports back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.functions.urls import raw_file_name
from pageloom.operators.export import FOOTER, ExportOptions, envelope_header, item_markup
from pageloom.session import materialize


def export_lines(items: DataFrame, options: ExportOptions = ExportOptions(), items_per_shard: int = 50_000) -> DataFrame:
    """``(shard, seq, value)``: every shard a complete document, attachments with their page.

    The shard comes from the page's id, so its size is bounded by ``items_per_shard`` plus one
    page's attachments.
    """
    page_id = F.when(F.col("kind") == "attachment", F.col("parent_id")).otherwise(F.col("post_id"))
    shard = F.floor((page_id - 1) / F.lit(items_per_shard)).cast("bigint")
    body = items.select(shard.alias("shard"), F.col("post_id").alias("seq"), item_markup().alias("value"))
    # One document's frame needs no scan: shards without a page cannot occur, ids are dense.
    shards = items.select(shard.alias("shard")).distinct()
    header = shards.select("shard", F.lit(-1).cast("bigint").alias("seq"), envelope_header(options).alias("value"))
    footer = shards.select("shard", F.lit(2**62).cast("bigint").alias("seq"), F.lit(FOOTER).alias("value"))
    return header.unionByName(body).unionByName(footer)


def write_wxr(items: DataFrame, path: str, options: ExportOptions = ExportOptions(),
              items_per_shard: int = 50_000) -> None:
    """Sharded import files under ``path/shard=N``, each one importable on its own.

    The items are written out first, so that frame and body read them instead of working them out again.
    """
    _write_stored(materialize(items), path, options, items_per_shard)


def _write_stored(items: DataFrame, path: str, options: ExportOptions, items_per_shard: int) -> None:
    lines = export_lines(items, options, items_per_shard)
    (lines.repartition("shard").sortWithinPartitions("shard", "seq").select("shard", "value")
     .write.mode("overwrite").partitionBy("shard").text(path))


def write_dual_export(items: DataFrame, raw_items: DataFrame, path: str,
                      options: ExportOptions = ExportOptions(), items_per_shard: int = 50_000) -> None:
    """The block export under ``path`` and the raw backup under ``path-raw``.

    The raw backup keeps pages that later failed, and has no attachments. Nothing is written for
    an export without items.
    """
    for rows, target in ((items, path), (raw_items, f"{path}-raw")):
        stored = materialize(rows)
        if not stored.isEmpty():
            _write_stored(stored, target, options, items_per_shard)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Items of an export, read back as rows."""
    schema = ("title string, link string, pubDate string, creator string, encoded array<string>, post_id bigint, "
              "post_name string, status string, post_parent bigint, post_type string, attachment_url string")
    rows = (
        spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true")
        .option("ignoreSurroundingSpaces", "false").schema(schema).load(path)
    )
    return rows.select(
        "post_id", F.col("post_parent").alias("parent_id"), "title", "link", "post_name", "status", "post_type",
        F.coalesce(F.get("encoded", F.lit(0)), F.lit("")).alias("content"), "attachment_url",
    )


def archive_raw_pages(pages: DataFrame, path: str, table: str | None = None, buckets: int = 0) -> None:
    """Untouched pages with their archive name, before anything else can fail.

    With ``table`` and ``buckets`` the archive is bucketed by ``page_id``: later runs read it
    with ``html_nodes(..., partitioned=True)`` and need no exchange.
    """
    named = archive_names(pages)
    if table:
        named.write.mode("overwrite").bucketBy(buckets, "page_id").sortBy("page_id").option("path", path).saveAsTable(table)
    else:
        named.write.mode("overwrite").parquet(path)


def archive_names(pages: DataFrame, ordinal: str = "page_id") -> DataFrame:
    """Pages with ``raw_name``; list numbers start at one."""
    number = F.col(ordinal) + 1 if ordinal == "page_id" else F.col(ordinal)
    return pages.withColumn("raw_name", raw_file_name(number, F.col("url")))
