"""Exact similarity joins of sets: only sets that share one of their rarest elements meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.session import materialize


def word_shingles(text: Column, n: int = 5) -> Column:
    """Hashes of the runs of ``n`` words of a text, each once; of the whole text if it has fewer."""
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) < n, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))),
                                     lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(n)), " ")))))), F.lit(0))


def ranked(sets: DataFrame, by: list[str], counted: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """``sets`` (id, *by, tokens) with ``tokens`` from rare to frequent, as counted within ``by`` over ``counted`` (the sets themselves).

    Where the sets of one ``by`` are ``bounded``, they are dealt by it once, as whole arrays, and counted where they are.
    """
    if bounded:
        rows = sets.repartition(*by).select("id", *by, F.explode("tokens").alias("token"))
        placed = rows.withColumn("n", F.count("*").over(Window.partitionBy(*by, "token")))
    else:
        rows = sets.select("id", *by, F.explode("tokens").alias("token"))
        source = rows if counted is None else counted.select(*by, F.explode("tokens").alias("token"))
        counts = source.groupBy(*by, "token").agg(F.count("*").alias("n"))
        # Not salted: there are nearly as many counts as rows, and adaptive execution splits a frequent token's.
        placed = rows.join(counts, [*by, "token"], "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")))
    return placed.groupBy(*by, "id").agg(order.alias("pairs")).select(
        "id", *by, F.transform("pairs", lambda p: p["token"]).alias("tokens"))


def prefixes(sets: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """(id, *by, size, token): of each ranked set so many of the rarest that two sets as similar as ``threshold`` share one."""
    size = F.size("tokens")
    kept = size - F.ceil(size * F.lit(threshold) - 1e-9).cast("int") + 1
    return sets.select("id", *by, size.alias("size"), F.explode(F.slice("tokens", F.lit(1), F.least(kept, size))).alias("token"))


def candidates(left: DataFrame, right: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """(*by, a, b) of ranked sets that share an element of their prefixes and whose sizes allow the similarity."""
    x = prefixes(left, threshold, by).withColumnsRenamed({"id": "a", "size": "size_a"})
    y = prefixes(right, threshold, by).withColumnsRenamed({"id": "b", "size": "size_b"})
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold - 1e-9
    return x.join(y, [*by, "token"]).filter(fits).select(*by, "a", "b").distinct()


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``pairs`` with ``similarity``: shared elements by all elements of both."""
    x = left.select(*by, F.col("id").alias("a"), F.col("tokens").alias("_x"))
    y = right.select(*by, F.col("id").alias("b"), F.col("tokens").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    met = pairs.join(x, [*by, "a"]).join(y, [*by, "b"]).withColumn("_both", both)
    return met.select(*by, "a", "b", (F.col("_both") / (F.size("_x") + F.size("_y") - F.col("_both"))).alias("similarity"))


def similar_pairs(sets: DataFrame, threshold: float, by: list[str], bounded: bool = False) -> DataFrame:
    """(*by, a, b, similarity), a < b: all pairs within ``by`` whose Jaccard similarity is ``threshold`` or more.

    ``sets`` has unique ``id`` within ``by`` and ``tokens`` without repeats; equal sets should be one row, so that a group of
    copies makes no pairs. ``bounded`` as in :func:`ranked`. What is counted and joined are numbers: a set's own and a hash of its
    ``by`` with the token; ids and ``by`` come back with the sets, and a pair across ``by`` is none.
    """
    named = materialize(sets.withColumn("_no", F.monotonically_increasing_id()))
    group = F.xxhash64(*by)
    if bounded:
        keyed = named.select(F.col("_no").alias("id"), group.alias("_by"), "tokens")
        order = materialize(ranked(keyed, ["_by"], bounded=True))
        pairs = candidates(order, order, threshold, ["_by"])
    else:
        keyed = named.select(F.col("_no").alias("id"), F.transform("tokens", lambda t: F.xxhash64(*by, t)).alias("tokens"))
        order = materialize(ranked(keyed, []))
        pairs = candidates(order, order, threshold, [])
    pairs = pairs.filter("a < b").select("a", "b")
    x = named.select(F.col("_no").alias("a"), *by, F.col("id").alias("_a"), F.col("tokens").alias("_x"))
    y = named.select(F.col("_no").alias("b"), *[F.col(c).alias(f"_{c}_y") for c in by], F.col("id").alias("_b"), F.col("tokens").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    met = pairs.join(x, "a").join(y, "b")
    for c in by:
        met = met.filter(F.col(c) == F.col(f"_{c}_y"))
    found = met.withColumn("_both", both).withColumn("similarity", F.col("_both") / (F.size("_x") + F.size("_y") - F.col("_both")))
    return found.filter(F.col("similarity") >= threshold - 1e-9).select(
        *by, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "similarity")
