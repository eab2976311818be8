"""Joins, ranks and lags that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.session import materialize

SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str, salt_from: str,
                salts: int = SALTS) -> DataFrame:
    """Join to a table with unique keys, spreading each left key over ``salts`` tasks.

    ``how`` is left, inner, left_semi or left_anti. The right side is repeated ``salts``
    times, so it should be the smaller one; its keys must be unique, as each row of a key counts
    (callers aggregate by ``on`` first). When Spark's own size check lets it broadcast the right side, that goes out once:
    Spark would size the copies like the one table they come from, and a broadcast needs no salt.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    if not right.isStreaming and _broadcastable(right):
        return left.join(right, on, how)
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def _broadcastable(table: DataFrame) -> bool:
    """Whether Spark's estimate of ``table`` is within its limit for broadcasts."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which a NULL key equals a NULL key; the keys come from ``left``."""
    renamed = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"_on_{c}"])
    return left.join(renamed, condition, how).drop(*[f"_on_{c}" for c in on])


def bucketed_prefix(df: DataFrame, order: str, weight: Column, name: str, bucket: int = 100_000,
                    by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of ``weight`` over all earlier rows (by unique integer ``order``), per ``by`` keys.

    Two levels: sums per bucket of ``bucket`` order values, a running sum over the buckets,
    then a running sum inside each bucket. No task holds more than one bucket's rows or one
    key's buckets, so a key with a third of all rows is spread like any other. Meant for list
    ordinals and other dense numbers; :func:`ranged_prefix` takes any.
    """
    rows = df.withColumn("_weight", weight.cast("bigint")).withColumn(
        "_bucket", F.floor(F.col(order) / F.lit(bucket)).cast("bigint")
    )
    keys = list(by)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_sum"))
    over_buckets = Window.partitionBy(*keys).orderBy("_bucket") if keys else Window.orderBy("_bucket")
    before = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        null_safe_join(rows, offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .drop("_weight", "_bucket", "_offset")
    )


def ranged_prefix(df: DataFrame, order: str, weight: Column, name: str, by: tuple[str, ...] = (),
                  parts: int | None = None) -> DataFrame:
    """Like :func:`bucketed_prefix` for sparse or uneven ``order`` values, such as hashes.

    Buckets are ``parts`` sampled ranges of equal size. They are written out before use, since
    sampling again could cut elsewhere; ``df`` should hold only the columns needed here. A row without an
    ``order`` value comes first.
    """
    count = parts or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_weight", weight.cast("bigint")).repartitionByRange(count, order)
    rows = materialize(ranged.withColumn("_bucket", F.spark_partition_id()))
    keys = list(by)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        null_safe_join(rows, offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .drop("_weight", "_bucket", "_offset")
    )


def bucketed_lag(df: DataFrame, by: str, order: Column, value: str, name: str, bucket_of: Column,
                 tie: str) -> DataFrame:
    """Previous ``value`` of the same key in ``(order, tie)`` order, per time bucket.

    The first row of a bucket takes the last value of the key's previous bucket.
    """
    rows = df.withColumn("_bucket", bucket_of).withColumn("_order", F.struct(order, F.col(tie)))
    inside = Window.partitionBy(by, "_bucket").orderBy("_order")
    last = rows.groupBy(by, "_bucket").agg(F.max_by(value, "_order").alias("_last"))
    previous = last.select(
        by, "_bucket", F.lag("_last").over(Window.partitionBy(by).orderBy("_bucket")).alias("_carried")
    )
    return (
        null_safe_join(rows, previous, [by, "_bucket"])
        .withColumn(name, F.coalesce(F.lag(value).over(inside), F.col("_carried")))
        .drop("_bucket", "_order", "_carried")
    )
