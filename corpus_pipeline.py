"""Training-corpus pipeline: each stage takes (spark, docs, sf_dir) and works on what the stage before it kept."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pageloom.llm.cdc_dedup import dedup_substrings  # noqa: E402
from pageloom.llm.common import materialize, tables  # noqa: E402
from pageloom.llm.decontaminate import decontaminate  # noqa: E402
from pageloom.llm.simhash_dedup import keep_one  # noqa: E402
from pageloom.llm.source_mix import mix_sources  # noqa: E402
from pageloom.llm.toxicity import drop_toxic, learn_grammar  # noqa: E402


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below 0.7, by weights learned from the labelled ones among them."""
    (labels,) = tables(spark, sf_dir, "labels")
    return drop_toxic(docs, learn_grammar(docs, labels, train=(3, 1, False)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash, as the operator defines them."""
    return keep_one(docs, shingle=3, distance=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that came before are cut out of the texts."""
    return dedup_substrings(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    (benchmark,) = tables(spark, sf_dir, "benchmark")
    return decontaminate(docs, benchmark, mode="document")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources; ``copy_no`` counts from 1."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("decontamination", remove_leaks),
    ("source_mix", mix),
]

#: SQL expresses neither the learned toxicity weights nor chunk and shingle digests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each is written as Parquet and read again by the next."""
    (docs,) = tables(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
