"""Benchmark decontamination by n-gram windows. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.common import BROADCAST_ROWS, fresh, materialize, row_key

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Window hashes that may go into the set shipped with every task.
SET_ROWS = 50_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; ``lower`` serves texts that hold ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def benchmark_words(text: Column) -> Column:
    """Words in lower case; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), SEPARATORS), ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(length, window, items): each distinct window of the items and the sorted ids that hold it.

    An item of fewer than ``n`` words is one window; one without words has none. Ids are compared as strings.
    """
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), benchmark_words(F.col("text")).alias("words"))
    sized = words.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    windows = sized.withColumn("start", F.explode(starts)).select(
        "item", "length", F.concat_ws(" ", F.slice("words", "start", "length")).alias("window")
    )
    return windows.groupBy("length", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _candidates(length: int, hashes: list[int] | None) -> str:
    """SQL text: windows of ``length`` of the words ``w`` that may be in the set, as structs."""
    starts = f"CASE WHEN size(w) >= {length} THEN sequence(1, size(w) - {length - 1}) ELSE cast(array() AS array<int>) END"
    if hashes is not None:  # one text for thousands of numbers, which Spark turns into a hash set
        starts = f"filter({starts}, i -> xxhash64(slice(w, i, {length})) IN ({', '.join(f'{h}L' for h in hashes)}))"
    return (f"transform({starts}, i -> named_struct('start', i, 'length', {length},"
            f" 'window', concat_ws(' ', slice(w, i, {length}))))")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per document row: doc_id, row_key, n_words, n_hit, items (ids as strings, sorted), spans.

    A word inside any occurrence of a window is hit; ``spans`` holds (start, length), words counted
    from 1. The hashes of all windows form a set that goes to every task (if there are at most
    ``SET_ROWS``; else all windows of the documents are candidates); a document window in it is compared
    word by word with the windows of the benchmark in a join, broadcast up to ``BROADCAST_ROWS`` windows.
    Texts are not shuffled, and the scan writes only counts and candidates. Null or empty texts have
    no words; equal rows get equal results; an empty benchmark hits nothing. Items with null text or id:
    no text has no window, a null id is left out of ``items`` (its windows still hit).
    """
    windows = materialize(item_windows(benchmark, n))
    found = windows.groupBy("length").count().collect()  # at most n rows
    total = sum(r["count"] for r in found)
    hashes: dict[int, list[int] | None] = {r["length"]: None for r in found}
    if total <= SET_ROWS:
        for length in hashes:
            own = windows.filter(F.col("length") == length).select(F.xxhash64(F.split("window", " ")).alias("h")).distinct()
            hashes[length] = [r["h"] for r in own.collect()]

    none = "cast(array() AS array<struct<start:int,length:int,window:string>>)"
    found_in = ", ".join([none, *(_candidates(k, hashes[k]) for k in sorted(hashes))])
    # The one-element array binds the words, so that they are split once and not for each window.
    scanned = F.expr(f"transform(array(words), w -> named_struct('n', size(w), 'c', concat({found_in})))[0]")
    scan = materialize(
        docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), benchmark_words(F.col("text")).alias("words"))
        .select("doc_id", "row_key", scanned.alias("s"))
        .select("doc_id", "row_key", F.col("s.n").alias("n_words"), F.col("s.c").alias("candidates"))
    )
    sets = F.broadcast(windows) if total <= BROADCAST_ROWS else windows
    hits = (
        scan.filter(F.size("candidates") > 0).select("row_key", F.explode("candidates").alias("c"))
        .select("row_key", F.col("c.start").alias("start"), F.col("c.window").alias("window"))
        .join(sets, "window")
        .groupBy("row_key").agg(
            F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - 1 - F.greatest(a["end"], s["start"] - 1))).alias("n"),
            F.greatest(a["end"], s["start"] + s["length"] - 1).alias("end")))["n"]
    return scan.drop("candidates").join(hits.withColumn("hit", covered), "row_key", "left").select(
        "doc_id", "row_key", F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = 10) -> DataFrame:
    """``docs`` without contaminated rows (``document``) or without the hit words (``span``).

    A removed word takes the separators before it along; n_chars, if there, follows the new text.
    Rows without hits come back unchanged, null texts included.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode}")
    key, spans = fresh(docs, "row_key"), fresh(docs, "spans")
    report = contamination(docs, benchmark, n).filter("n_hit > 0").select(
        F.col("row_key").alias(key), F.col("spans").alias(spans)).dropDuplicates([key])
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    if mode == "document":
        return keyed.join(report, key, "left_anti").select(*docs.columns)
    word, rest = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]"
    parts = F.regexp_extract_all(F.col("text"), F.lit(f"{rest}*{word}|{rest}+"), F.lit(0))
    left = F.filter(F.transform(parts, lambda p, i: F.when(
        ~F.exists(F.col(spans), lambda s: (i + 1 >= s["start"]) & (i + 1 < s["start"] + s["length"])), p)),
        lambda p: p.isNotNull())
    cut = keyed.join(report, key, "left").withColumn(
        "text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(left, "")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text")))
    return cut.select(*docs.columns)
