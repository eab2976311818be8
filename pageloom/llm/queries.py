"""Queries of the training-data operators, each over its whole table, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm.binary_codes import embedding_links
from pageloom.llm.byte_cnn import identify, learn_languages
from pageloom.llm.cdc_dedup import dedup_substrings
from pageloom.llm.common import remainder, tables
from pageloom.llm.cotraining import quality
from pageloom.llm.decontaminate import contamination
from pageloom.llm.gru_lm import lm_scores
from pageloom.llm.license_scan import license_matches, notice_table
from pageloom.llm.prefix_trie import conversation_trie
from pageloom.llm.quality_rules import language_references, quality_rules
from pageloom.llm.simhash_dedup import simhash_groups
from pageloom.llm.source_mix import mix_plan
from pageloom.llm.statements import SQL as STATEMENTS
from pageloom.llm.token_alignment import align, read_files
from pageloom.llm.toxicity import learn_grammar, toxicity

#: Where the public tokenizers' files lie.
TOKENIZERS = "/opt/tokenizers"


def _held_out(modulus: int, value: int):
    return (remainder(F.col("doc_id"), modulus) == value).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = tables(spark, sf_dir, "documents", "labels")
    scored = toxicity(documents, learn_grammar(documents, labels, train=(3, 1, False)))
    return scored.select("doc_id", _held_out(3, 1), "score", "predicted", "hits")


def op2_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (documents,) = tables(spark, sf_dir, "documents")
    return dedup_substrings(documents, report=True).select(
        "doc_id", "chunks", "chunks_cut", "words_cut", F.char_length("text").cast("bigint").alias("kept_chars"),
        F.md5("text").alias("kept_md5"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = tables(spark, sf_dir, "documents", "labels")
    return quality(documents, labels, train=(5, 0, False)).select(
        "doc_id", _held_out(5, 0), "score", "predicted", "text_score", "meta_score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    (documents,) = tables(spark, sf_dir, "documents")
    return simhash_groups(documents, shingle=3, distance=2).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (vectors,) = tables(spark, sf_dir, "embeddings")
    return embedding_links(vectors, cosine=0.95)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    (documents,) = tables(spark, sf_dir, "documents")
    return license_matches(documents, notice_table(spark)).select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"), "n_matches", "best")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    (documents,) = tables(spark, sf_dir, "documents")
    return mix_plan(documents.select("doc_id", "source", "text"), weights=(3, 1, 2), budget=1.5, cap=2.0, seed="mix").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    (documents,) = tables(spark, sf_dir, "documents")
    return lm_scores(documents, train_part=(10, 0, False)).select(
        "doc_id", _held_out(10, 0), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    return contamination(documents, benchmark, n=10).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    (documents,) = tables(spark, sf_dir, "documents")
    return identify(documents, learn_languages(documents, train=(5, 0, False))).select(
        "doc_id", _held_out(5, 0), "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    (conversations,) = tables(spark, sf_dir, "conversations")
    return conversation_trie(conversations).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    (documents,) = tables(spark, sf_dir, "documents")
    files = read_files(spark, f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    return align(documents.select(F.col("doc_id").cast("bigint"), "text"), *files)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    (documents,) = tables(spark, sf_dir, "documents")
    return quality_rules(documents, language_references(documents)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "nearest", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_cdc_dedup, op3_cotraining, op4_simhash, op5_binary_codes, op6_license_scan, op7_source_mix, op8_gru_lm,
    op9_decontaminate, op10_byte_cnn, op11_prefix_trie, op12_token_alignment, op13_quality_rules, pipeline)}

_MIX = """
WITH sized AS (
    SELECT doc_id, coalesce('s' || source, 'n') AS k, source,
        coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-') || ':'
            || (row_number() OVER (PARTITION BY doc_id, md5(text)) - 1) AS own,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
    FROM documents
), totals AS (
    SELECT k, first(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY k
), turns AS (
    SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM totals
), ordered AS (
    SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / w AS ratio,
        1.5::DOUBLE * sum(source_size) OVER () AS whole FROM turns
), levels AS (
    SELECT *, (whole - coalesce(sum(most) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered
), targets AS (
    SELECT k, source_size, coalesce(least(most, w * (SELECT min_by(level, ratio) FROM levels WHERE level <= ratio)), most) AS target
    FROM levels
), rates AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
)
SELECT doc_id, size, source_size, target,
    (size * (floor(rate)::BIGINT + (('0x' || substr(md5('mix:' || own), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
        < rate - floor(rate))::BIGINT))::BIGINT AS taken
FROM sized JOIN rates USING (k)
"""

_WORDS = (r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
          r" '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '')")

_LEAKS = f"""
WITH items AS (
    SELECT item_id::VARCHAR AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
    FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), places AS (
    SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), hits AS (
    SELECT DISTINCT r, p.n, i, item FROM places p JOIN windows g ON g.n = p.n AND g.g = array_to_string(p.w[i:i + p.n - 1], ' ')
), covered AS (
    SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

SQL = {"op7_source_mix": _MIX, "op9_decontaminate": _LEAKS, **STATEMENTS}
