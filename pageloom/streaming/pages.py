"""Structured Streaming versions: pages, progress, event lines and assets as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.session import materialize
from pageloom.sources.snapshots import read_snapshot, versions

PAGE_SCHEMA = "page_id bigint, url string, html string"


def stream_table(spark: SparkSession, folder: str, glob: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """Tables of a folder as a stream: each is a file, or a folder of part files."""
    # As a pattern of its own, a plain name may be either; as a path, a stream takes folders only.
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder.rstrip('/')}/{{{glob}}}")
    )


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append"):
    """Start a query over what is there; its state, if any, lies in RocksDB, so it is not bounded by an executor's memory."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (
            stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(handle).start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)


def _write_batch(df: DataFrame, batch_id: int, target: str) -> None:
    """One folder per batch, overwritten when the batch runs again, so a retry adds nothing."""
    df.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")


def stream_pages(pages: DataFrame, convert: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Convert pages as they land with the batch functions; windows over a page need whole pages, which a batch has."""
    return _run(pages, checkpoint, lambda df, batch_id: _write_batch(convert(df), batch_id, target))


PROGRESS_SCHEMA = "job_id string, done bigint, succeeded bigint, failed bigint, total bigint, last_batch bigint"


def stream_job_progress(events: DataFrame, target: str, checkpoint: str, idle_batches: int = 100):
    """Running counts per job from events (job_id, status, and ``total`` events to come, if known).

    ``<target>/active`` holds the jobs under way, a version per batch made from the one before and the batch's own rows. A job leaves it when it has
    all its events, or none for ``idle_batches``; its counts then go to ``<target>/settled``, which no batch reads again. A
    batch that runs again replaces what it wrote. Counts combine before their shuffle, so a busy job is spread.
    """
    total = F.max("total") if "total" in events.columns else F.lit(None).cast("bigint")

    def handle(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        own = df.groupBy("job_id").agg(
            F.count("*").alias("done"), F.count_if(F.col("status") == "ok").alias("succeeded"),
            F.count_if(~F.coalesce(F.col("status") == "ok", F.lit(False))).alias("failed"), total.cast("bigint").alias("total"),
            F.lit(batch_id).cast("bigint").alias("last_batch"))
        if batch_id:
            own = own.union(spark.read.schema(PROGRESS_SCHEMA).parquet(f"{target}/active/version={batch_id:09d}"))
        counted = own.groupBy("job_id").agg(
            *[F.sum(c).alias(c) for c in ("done", "succeeded", "failed")], *[F.max(c).alias(c) for c in ("total", "last_batch")])
        done = F.coalesce(F.col("done") >= F.col("total"), F.lit(False)) | (F.lit(batch_id) - F.col("last_batch") >= idle_batches)
        marked = materialize(counted.withColumn("_settled", done))
        _write_batch(marked.filter("_settled").drop("_settled"), batch_id, f"{target}/settled")
        marked.filter("not _settled").drop("_settled").write.mode("overwrite").parquet(f"{target}/active/version={batch_id + 1:09d}")

    return _run(events, checkpoint, handle)


def active_jobs(spark: SparkSession, target: str) -> DataFrame:
    """Jobs under way with their counts since they became active."""
    active = read_snapshot(spark, f"{target}/active", PROGRESS_SCHEMA)
    return spark.createDataFrame([], PROGRESS_SCHEMA) if active is None else active


def latest_progress(spark: SparkSession, target: str) -> DataFrame:
    """``(job_id, done, succeeded, failed)`` of every job: what was settled (in parts, where a job came to life again) and what is active."""
    if not versions(spark, f"{target}/active"):
        return active_jobs(spark, target).select("job_id", "done", "succeeded", "failed")
    rows = spark.read.schema(PROGRESS_SCHEMA).parquet(f"{target}/settled").drop("batch_id").union(active_jobs(spark, target))
    return rows.groupBy("job_id").agg(*[F.sum(c).alias(c) for c in ("done", "succeeded", "failed")])


def split_late(events: DataFrame, delay: str, on_time: str, late: str, checkpoint: str):
    """Write events to ``on_time``, or to ``late`` if they are more than ``delay`` older than the newest of all batches before theirs.

    Every event is in one of both. ``seen`` in ``on_time`` is that newest time; it never falls from batch to batch, so that a
    watermark on it drops nothing. A batch knows the newest time from the small file of the batch before.
    """
    marks = f"{checkpoint}_marks"

    def handle(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = materialize(df)
        own = rows.agg(F.max("ts").alias("newest"), F.min("ts").alias("oldest"))
        before = spark.read.schema("newest timestamp").parquet(f"{marks}/batch_id={batch_id - 1}") if batch_id else None
        newest = before.first()["newest"] if before is not None else None
        found = own.first()
        known = [t for t in (newest, found["newest"]) if t is not None]
        spark.createDataFrame([(max(known) if known else None,)], "newest timestamp").coalesce(1).write.mode("overwrite").parquet(
            f"{marks}/batch_id={batch_id}")
        limit = F.lit(newest).cast("timestamp") - F.expr(f"interval {delay}")
        too_late = F.coalesce(F.col("ts") < limit, F.lit(False))
        seen = newest if newest is not None else found["oldest"]
        _write_batch(rows.filter(too_late), batch_id, late)
        _write_batch(rows.filter(~too_late).withColumn("seen", F.lit(seen).cast("timestamp")), batch_id, on_time)

    return _run(events, checkpoint, handle)


def stream_event_dedup(events: DataFrame, keys: list[str], target: str, checkpoint: str, delay: str | None = None,
                       late: str | None = None):
    """Each event line once, however late it comes.

    The state then holds every key. ``delay`` bounds it to that much event time: events that come later than that are
    written to ``late`` (``<target>_late`` if not given; :func:`late_events`), whether they are new or not, and all others come out once.
    """
    def handle(df: DataFrame, batch_id: int) -> None:
        _write_batch(df.drop("seen"), batch_id, target)

    if delay is None:
        return _run(events.dropDuplicates(keys), checkpoint, handle)
    on_time = f"{checkpoint}_on_time"
    split_late(events, delay, on_time, late or f"{target}_late", f"{checkpoint}_split").awaitTermination()
    schema = events.schema.add("seen", "timestamp")
    kept = events.sparkSession.readStream.schema(schema).parquet(f"{on_time}/batch_id=*")
    return _run(kept.withWatermark("seen", delay).dropDuplicatesWithinWatermark(keys), checkpoint, handle)


def late_events(spark: SparkSession, late: str, schema: str) -> DataFrame:
    """The side output of :func:`stream_event_dedup`, with the batch each event came in."""
    return spark.read.schema(f"{schema}, batch_id bigint").parquet(late)


def stream_new_assets(images_of: Callable[[DataFrame], DataFrame], pages: DataFrame, target: str, checkpoint: str):
    """Each image source once over the whole run.

    A first query writes the sources of each batch of pages (windows over a page need whole pages, so this is batch work); a second one
    keeps those it has not seen, by its state in RocksDB. A batch looks up its own sources and reads none of the earlier ones;
    a batch or file that comes again adds nothing.
    """
    found = f"{checkpoint}_sources"
    _run(pages, f"{checkpoint}_pages", lambda df, batch_id: _write_batch(images_of(df).select("src").distinct(), batch_id, found)).awaitTermination()
    sources = pages.sparkSession.readStream.schema("src string").parquet(f"{found}/batch_id=*")
    return _run(sources.dropDuplicates(["src"]), checkpoint, lambda df, batch_id: _write_batch(df, batch_id, target))


def known_assets(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(src)``: every source seen so far, read from the state of :func:`stream_new_assets`."""
    return spark.read.format("statestore").load(checkpoint).select("key.src")
