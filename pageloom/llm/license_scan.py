"""License scans: MinHash over overlapping windows retrieves templates, exact containment verifies. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.common import BROADCAST_ROWS, materialize, row_key
from pageloom.llm.decontaminate import benchmark_words

SHINGLE, CONTAINED, HASHES = 5, 0.8, 64

# Fixed texts of license notices (public wording).
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
                " documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
                " that the following conditions are met",
}


def shingles(words: Column, size: Column | int = SHINGLE) -> Column:
    """Hashes of the shingles of a bound array of words, in order; of fewer words, the whole sequence; none of none."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - size + 1))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))


def minhash(hashes: Column, count: int = HASHES) -> Column:
    """Minima of a bound array of shingle hashes under ``count`` hash functions."""
    return F.array(*[F.array_min(F.transform(hashes, _function(k))) for k in range(count)])


def _function(k: int):
    """Hash function number ``k``."""
    return lambda h: F.xxhash64(h, F.lit(k))


def template_table(templates: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(license, size, scale, words_in, hashes): distinct shingles of each template and the window size that suits it.

    A template of fewer words than a shingle is one shingle of its own length ``words_in``. Templates without words
    or name are left out.
    """
    words = F.col("words")
    sized = templates.select("license", benchmark_words(F.col("text")).alias("words")).filter(
        "license IS NOT NULL AND size(words) > 0").withColumn("words_in", F.least(F.size(words), F.lit(shingle)))
    hashed = sized.withColumn("hashes", F.array_distinct(shingles(words, F.col("words_in"))))
    size = F.size("hashes")
    return hashed.select("license", "words_in", "hashes", size.alias("size"),
                         F.pow(2, F.ceil(F.log2(size.cast("double")))).cast("int").alias("scale"))


def license_matches(docs: DataFrame, templates: DataFrame, shingle: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """One row per document row: doc_id, licenses (sorted), n_matches, best (largest containment).

    The shingles of a text are cut into windows of twice a template's size (in powers of two) at steps of that
    size, so a template lies whole in one of them and makes up a third of it or more, less what is missing. One
    MinHash value is a band: with ``HASHES`` = 64 bands the chance to meet a template of which 0.8 is there is
    above 1 - (1 - 0.8 / 3.2)**64, that is 1 - 1e-8. A band can only meet if the window holds the very shingle
    that is the template's minimum, so windows without any of those are skipped before the MinHash; that loses
    none. Retrieved templates are verified by the exact share of their distinct shingles that the window holds. Words
    are those of ``benchmark_words``. Null and empty texts match nothing; repeated rows get equal results; without
    templates nothing matches. The templates' bands are broadcast up to ``BROADCAST_ROWS`` rows, beyond that joined by shuffling.
    """
    known = materialize(template_table(templates, shingle))
    bands = materialize(known.select(
        "license", "words_in", "scale", "size", "hashes",
        F.posexplode(F.transform(F.array("hashes"), lambda h: minhash(h))[0]).alias("band", "value")))
    sizes = known.groupBy("words_in", "scale").count().collect()  # at most shingle * log2(longest template) rows
    total = bands.count()
    minima = {}
    for r in sizes:
        own = known.filter((F.col("words_in") == r["words_in"]) & (F.col("scale") == r["scale"]))
        # Shingles that are the minimum of a template under some function.
        least = own.select("hashes", F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1))).alias("k")).select(F.array_min(F.transform(
            "hashes", lambda h: F.struct(F.xxhash64(h, F.col("k")).alias("v"), h.alias("h"))))["h"].alias("h")).distinct()
        minima[r["words_in"], r["scale"]] = [x["h"] for x in least.collect()] if total <= BROADCAST_ROWS else None

    none = F.array().cast("array<struct<words_in:int,scale:int,hashes:array<bigint>>>")

    def windows(hashes: Column, words_in: int, scale: int) -> Column:
        starts = F.when(F.size(hashes) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(hashes) - scale + 1), F.lit(scale))).otherwise(
            F.array().cast("array<int>"))
        wanted = minima[words_in, scale]
        if wanted is not None:
            at = F.filter(F.transform(hashes, lambda h, i: F.when(h.isin(wanted), i)), lambda i: i.isNotNull())
            hit = F.transform(F.array(at), lambda at: F.filter(
                starts, lambda s: F.exists(at, lambda i: (i + 1 >= s) & (i + 1 < s + 2 * scale))))[0]
            starts = F.when(F.size(at) > 0, hit).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(
            F.lit(words_in).alias("words_in"), F.lit(scale).alias("scale"),
            F.array_distinct(F.slice(hashes, s, 2 * scale)).alias("hashes")))

    def scan(words: Column) -> Column:
        found = [none]
        for words_in in sorted({k[0] for k in minima}):
            found.append(F.transform(F.array(shingles(words, words_in)), of_length(words_in))[0])
        return F.concat(*found)

    def of_length(words_in: int):
        scales = sorted(s for w, s in minima if w == words_in)
        return lambda hashes: F.concat(none, *[windows(hashes, words_in, s) for s in scales])

    keyed = materialize(docs.select(
        "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
        F.transform(F.array(benchmark_words(F.col("text"))), scan)[0].alias("windows")))
    probes = keyed.filter(F.size("windows") > 0).select("row_key", F.inline("windows")).select(
        "row_key", "words_in", "scale", F.col("hashes").alias("held"),
        F.posexplode(F.transform(F.array("hashes"), lambda h: minhash(h))[0]).alias("band", "value"))
    side = F.broadcast(bands) if total <= BROADCAST_ROWS else bands
    share = F.size(F.array_intersect("hashes", "held")) / F.col("size")
    met = probes.join(side, ["words_in", "scale", "band", "value"]).withColumn("share", share).filter(F.col("share") >= contained)
    found = met.groupBy("row_key", "license").agg(F.max("share").alias("share")).groupBy("row_key").agg(
        F.array_sort(F.collect_list("license")).alias("licenses"), F.max("share").alias("best"))
    return keyed.select("doc_id", "row_key").join(found, "row_key", "left").select(
        "doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        F.coalesce(F.size("licenses"), F.lit(0)).cast("bigint").alias("n_matches"), F.coalesce("best", F.lit(0.0)).alias("best"))


def notice_table(spark) -> DataFrame:
    """The fixed notices as a table of templates."""
    return spark.createDataFrame(sorted(NOTICES.items()), "license string, text string")
