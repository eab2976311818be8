"""Mix sources to target weights: fractional repetition with hash-seeded copies. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.llm.common import fresh, join_to_keys, materialize, row_key
from pageloom.operators.skew import ranged_prefix

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _source_key(source: Column) -> Column:
    """A null source is one of its own, apart from every real name."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """Target per source from rows (source, size): (source_key, source, source_size, target, rate).

    Sources in code-point order, null last, take ``weights`` in turn and share ``budget`` times all
    sizes by weight. No target passes ``cap`` times its source; the excess goes to the others by
    weight until none passes it. That settles at ``least(cap * size, level * weight)``, so the level
    is found in one ordered pass over the sources instead of by repeating. A source without words
    gets target and rate 0. The windows run over one row per source.
    """
    totals = sizes.groupBy(_source_key(F.col("source")).alias("source_key")).agg(
        F.first(F.col("source").cast("string")).alias("source"), F.sum("size").alias("source_size")
    )
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ratio = Window.orderBy("ratio", "source_key")
    whole = Window.partitionBy(F.lit(0))
    shared = (
        totals.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("_capped", F.coalesce(
            F.sum("most").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(whole) * F.lit(float(budget)))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_open"))
        .withColumn("level", F.min(F.when(F.col("_level") <= F.col("ratio"), F.struct("ratio", "_level"))).over(whole)
                    .getField("_level"))
    )
    target = F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most"))
    return shared.select(
        "source_key", "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def draw(key: Column, seed: str) -> Column:
    """Number in [0, 1) from the seed and a row's key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def numbered_keys(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``key``: id, hash of the text, and the number of the row among equal ones (from 0), in one string.

    Equal rows are found by their keys; only they are numbered, in ranges of sampled bounds, so that any number of copies spreads over
    tasks. Which of them gets which number does not matter, as they are equal.
    """
    number = fresh(docs, "equal_number")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    equal = materialize(keyed.groupBy(key).count().filter("count > 1").select(key))
    count = equal.count()
    if not count:
        return keyed.withColumn(key, F.concat(key, F.lit(":0")))
    hit, order = fresh(keyed, "equal_hit"), fresh(keyed, "equal_order")
    marked = join_to_keys(keyed, equal.withColumn(hit, F.lit(True)), key, "left", F.monotonically_increasing_id(), count)
    alone = marked.filter(F.col(hit).isNull()).drop(hit).withColumn(key, F.concat(key, F.lit(":0")))
    copies = materialize(marked.filter(F.col(hit)).drop(hit).withColumn(order, F.monotonically_increasing_id()))
    copies = ranged_prefix(copies, order, F.lit(1), number, (key,)).drop(order)
    return alone.unionByName(copies.withColumn(key, F.concat(key, F.lit(":"), F.col(number).cast("string"))).drop(number))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0,
             seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (their names made fresh on a clash).

    Each document is taken floor(rate) times, plus once more with probability of the fraction, drawn
    from ``seed``, doc_id, text and the number of the row among equal ones: a rerun gives the same rows, whatever the partitioning, and rows without
    id or with a repeated one are drawn one by one. Null or empty text has size 0 and the copies of its source. The per-source
    sums combine before their shuffle, and the documents meet a broadcast table of sources (by
    shuffling with split keys, if there are over ``BROADCAST_ROWS`` sources); documents are not shuffled
    by source. Of equal rows, only their keys are counted, and only they are shuffled.
    """
    names = {n: fresh(docs, n) for n in ("size", "source_size", "target", "rate", "copies")}
    key, spread = fresh(docs, "source_key"), fresh(docs, "draw")
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = materialize(source_targets(sized, weights, budget, cap)).select(
        F.col("source_key").alias(key), *[F.col(n).alias(names[n]) for n in ("source_size", "target", "rate")]
    )
    marked = numbered_keys(docs, spread).withColumn(spread, draw(F.col(spread), seed)).withColumn(
        key, _source_key(F.col("source"))).withColumn(names["size"], word_count(F.col("text")))
    rate = F.col(names["rate"])
    copies = F.floor(rate).cast("int") + (F.col(spread) < rate - F.floor(rate)).cast("int")
    joined = join_to_keys(marked, targets, key, "inner", spread)
    return joined.withColumn(names["copies"], copies).select(*docs.columns, *names.values())


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as :func:`mix_plan` says, with ``copy_no`` from 1."""
    plan = mix_plan(docs, **options)
    copies, number = plan.columns[-1], fresh(docs, "copy_no")
    return plan.filter(F.col(copies) > 0).withColumn(
        number, F.explode(F.sequence(F.lit(1), F.col(copies)))
    ).select(*docs.columns, number)
