import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from pageloom.llm.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[2]


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "do", "ki", "lu", "me", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, toxic ones, copies, a shared passage, and a benchmark item inside two documents."""
    rng = random.Random(9)
    where = str(tmp_path_factory.mktemp("tables"))
    item, passage = prose(rng, 30), prose(rng, 80)
    docs = {i: prose(rng, 150) for i in range(60)}
    for i in range(100, 130):
        docs[i] = prose(rng, 60) + " zorbly " + prose(rng, 20) + " zorbed. " + prose(rng, 20) + " zorba"
    for i in range(5):
        docs[200 + i] = docs[i]
    for i in (300, 301):
        docs[i] = f"{prose(rng, 60)} {item} {prose(rng, 60)}"
    for i in range(400, 405):
        docs[i] = f"{prose(rng, 60)} {passage} {prose(rng, 60)}"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    labels = [(i, 1, int(100 <= i < 130)) for i in docs]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, docs, item, passage


def test_each_stage_takes_its_effect(spark, folder, tmp_path):
    where, docs, item, passage = folder
    kept, seen = spark.read.parquet(f"{where}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, where)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == kept.columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
    clean = {i for i in docs if i < 60}
    assert set(seen["toxicity"]) == {i for i in docs if not 100 <= i < 130}
    assert set(seen["near_duplicates"]) == set(seen["toxicity"]) - {200 + i for i in range(5)}
    cut = seen["substring_dedup"]
    assert {i for i in cut if passage in cut[i]} == {400} and all(cut[i] == docs[i] for i in clean)
    assert set(seen["decontamination"]) == set(cut) - {300, 301}
    assert clean <= set(seen["decontamination"])
    counts = kept.groupBy("doc_id").count().collect()
    assert 1 <= max(r["count"] for r in counts) <= 2


def test_run_agrees_with_the_stages(spark, folder):
    where, *_ = folder
    rows = corpus_pipeline.run(spark, where).collect()
    again = corpus_pipeline.run(spark, where).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and rows
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in QUERIES and set(SQL) <= set(QUERIES)


LEFT = {
    "no folder": lambda root: None,
    "empty folder": lambda root: (root / "pageloom/llm").mkdir(),
    "leftovers": lambda root: (root / "pageloom/llm/__pycache__").mkdir(parents=True),
    "no xxhash": None,
}


@pytest.mark.parametrize("left", LEFT)
def test_entry_works_without_the_folder(tmp_path, left):
    """The rest of the library loads where the folder is gone, empty, or lacks a package it needs."""
    root, code = tmp_path / "repo", ""
    ignored = [".git", "tests"] + (["llm", "corpus_pipeline.py"] if LEFT[left] else [])
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(*ignored))
    if LEFT[left]:
        LEFT[left](root)
    else:
        code = "import sys\nsys.modules['xxhash'] = None\n"
    code += (
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries())\n"
        "assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_pipeline_of_odd_rows(spark, odd_docs, tmp_path):
    """Nulls, empty and repeated rows, one very long text and extra columns go through all stages; so do empty tables."""
    labels = spark.createDataFrame([(5, 1, 0), (8, 0, 1)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "no such words"), (2, None)], "item_id bigint, text string")
    for name, docs, rows in (("odd", odd_docs, True), ("empty", odd_docs.limit(0), False)):
        where = f"{tmp_path}/{name}"
        docs.write.parquet(f"{where}/documents.parquet")
        labels.filter(str(rows)).write.parquet(f"{where}/labels.parquet")
        bench.filter(str(rows)).write.parquet(f"{where}/benchmark.parquet")
        out = corpus_pipeline.run(spark, where)
        assert out.columns[: len(docs.columns)] == docs.columns
        got = [r["doc_id"] for r in out.collect()]
        assert (set(got) <= {1, 2, 3, None, 5, 6, 7, 8} and {5, 6} & set(got)) if rows else not got
