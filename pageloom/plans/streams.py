"""Streaming queries, run over the files that are there and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.urls import url_host
from pageloom.operators.content import content_nodes
from pageloom.operators.media import extract_images
from pageloom.plans.convert import convert_pages
from pageloom.session import shared_folder
from pageloom.sources.tables import augmented_pages
from pageloom.streaming import pages as S


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/pageloom/{uuid.uuid4().hex}"


def _pages(spark, sf_dir) -> DataFrame:
    return S.stream_table(spark, sf_dir, "pages.parquet", S.PAGE_SCHEMA)


def stream_pages(spark, sf_dir):
    folder = _folder(spark)
    query = S.stream_pages(_pages(spark, sf_dir), lambda df: convert_pages(augmented_pages(df), css="article"),
                           f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    return rows.select("page_id", "title", "blocks", "images", F.md5("body").alias("body_md5"))


def stream_job_progress(spark, sf_dir):
    folder = _folder(spark)
    step = F.col("page_id") % 4
    events = _pages(spark, sf_dir).select(
        url_host(F.col("url")).alias("job_id"), F.when(step.isin(1, 2), F.lit("failed")).otherwise("ok").alias("status"))
    S.stream_job_progress(events, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return S.latest_progress(spark, f"{folder}/out")


def stream_event_dedup(spark, sf_dir):
    """Every event of the event table sent twice."""
    folder = _folder(spark)
    events = S.stream_table(spark, sf_dir, "events.parquet", "event_id bigint, ts timestamp, user_id bigint, event_type string")
    S.stream_event_dedup(events.union(events), ["event_id"], f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type")


def stream_new_assets(spark, sf_dir):
    folder = _folder(spark)

    def images_of(df: DataFrame) -> DataFrame:
        return extract_images(content_nodes(augmented_pages(df), css="article"))

    S.stream_new_assets(images_of, _pages(spark, sf_dir), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("src")


QUERIES = {f.__name__: f for f in (stream_pages, stream_job_progress, stream_event_dedup, stream_new_assets)}
