import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pageloom.llm.decontaminate import contamination, decontaminate
from pageloom.llm.license_scan import NOTICES, license_matches, notice_table
from pageloom.llm.source_mix import mix_plan, mix_sources, source_targets


def shared(sizes, budget=1.5, cap=2.0, weights=(3, 1, 2)):
    """Share and reshare until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), budget * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_those_of_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 40, 300, 2000]) for s in [*"abcdefg", "é", "Z", None][: 3 + 2 * seed]}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    want = shared(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_repeats_and_reruns_agree(spark, docs_of):
    docs = docs_of(*[(i, "w " * (i % 50 + 1), "en", f"s{i % 3}") for i in range(900)])
    plan = mix_plan(docs)
    rows = plan.collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix_plan(docs.repartition(7)).collect()))
    assert all(0 <= r["copies"] <= 2 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    taken = plan.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.12 * r["target"] for r in taken)
    mixed = mix_sources(docs)
    assert mixed.columns == [*docs.columns, "copy_no"]
    assert mixed.count() == sum(r["copies"] for r in rows)


def test_mix_draws_every_row(spark, docs_of):
    """Rows without id, with one id, and equal in all: each draws for itself, and reruns agree."""
    rows = [(None, f"w{i} " * 10, "en", "a") for i in range(400)] + [(7, f"w{i} " * 10, "en", "a") for i in range(400)]
    rows += [(None, "same " * 10, "en", "a")] * 400 + [(8, "same " * 10, "en", "a")] * 400 + [(9000 + i, "x " * 30, "en", "b") for i in range(300)]
    docs = docs_of(*rows)
    plan = mix_plan(docs, weights=(2, 1), budget=1.5).select("doc_id", "text", "size", "target", "copies", "source")
    got = sorted(map(str, plan.collect()))
    assert len(got) == len(rows)
    assert got == sorted(map(str, mix_plan(docs.repartition(5), weights=(2, 1), budget=1.5).select(*plan.columns).collect()))
    for key in ("doc_id is null and text not like 'same%'", "doc_id = 7", "doc_id is null and text like 'same%'", "doc_id = 8"):
        copies = [r["copies"] for r in plan.filter(key).collect()]
        assert len(set(copies)) == 2, key
    taken = plan.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.06 * r["target"] for r in taken)


def test_mix_of_odd_rows(spark, odd_docs):
    plan = mix_plan(odd_docs)
    assert plan.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert plan.count() == odd_docs.count()
    assert {r["doc_id"]: r["size_1"] for r in plan.collect()} == {1: 0, 2: 0, 3: 0, None: 5, 5: 5, 6: 60_000, 7: 6, 8: 1}
    assert mix_sources(odd_docs).columns == [*odd_docs.columns, "copy_no_1"]
    assert mix_plan(odd_docs.limit(0)).count() == 0 and mix_sources(odd_docs.limit(0)).count() == 0


def brute_hits(text, items, n=10):
    """(n_words, n_hit, items) by comparing every window."""
    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        windows = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(own) - k + 1):
            if tuple(own[i:i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


def leak_case(seed):
    rng = random.Random(seed)
    vocab = ["Aa", "bb", "c1", "é", "Zz", "dd"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 2, 3, 5, 12, 14])))) for i in range(12)] + [(90, None), (91, "!!")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 6, 40])))
             + ("; " + rng.choice(items[:12])[1].upper() + ". " if i % 3 == 0 else "")) for i in range(60)] + [(100, None)]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_contamination_is_that_of_every_window(spark, docs_of, seed):
    docs, items = leak_case(seed)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in contamination(docs_of(*docs), bench).collect()}
    assert got == {d: brute_hits(t, items) for d, t in docs}


def test_contamination_without_the_set_is_the_same(spark, docs_of, monkeypatch):
    from pageloom.llm import decontaminate as module

    docs, items = leak_case(7)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(str, contamination(docs_of(*docs), bench).collect()))
    monkeypatch.setattr(module, "SET_ROWS", 0)
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert sorted(map(str, contamination(docs_of(*docs), bench).collect())) == want


def test_decontaminate_documents_and_spans(spark, docs_of):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = docs_of((1, f"Before, it. {item.upper()}! After all."), (2, "Nothing of it."), (3, None), (4, item))
    assert sorted(r["doc_id"] for r in decontaminate(docs, bench).collect()) == [2, 3]
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminate(docs, bench, "span").collect()}
    assert cut == {1: ("Before, it! After all.", 22), 2: ("Nothing of it.", 14), 3: (None, None), 4: ("", 0)}
    with pytest.raises(ValueError):
        decontaminate(docs, bench, "other")


def test_contamination_of_odd_rows(spark, odd_docs):
    bench = spark.createDataFrame([(1, "three four five"), (None, "x")], "item_id bigint, text string")
    rows = contamination(odd_docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["n_hit"], tuple(r["items"])) for r in rows if r["n_hit"]) == [
        ("5", 3, ("1",)), ("5", 3, ("1",)), ("8", 1, ())]
    assert decontaminate(odd_docs, bench).columns == odd_docs.columns
    assert decontaminate(odd_docs, bench).count() == odd_docs.count() - 3
    assert contamination(odd_docs.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in contamination(odd_docs, bench.limit(0)).collect()} == {0}


def test_licenses_are_found_and_verified(spark, docs_of):
    filler = " ".join(f"filler{i}" for i in range(300))
    text = NOTICES["mit-text"]
    broken = text.replace("person", "somebody", 1)
    docs = docs_of((1, f"{filler}\n{NOTICES['mit']}\n{filler}"), (2, text.upper()), (3, f"{filler} {broken} {filler}"), (4, filler),
                   (5, "Permission is hereby granted, free of charge"), (6, None), (7, NOTICES["mit"] + " " + NOTICES["gpl-3.0"]))
    got = {r["doc_id"]: (list(r["licenses"]), round(r["best"], 2)) for r in license_matches(docs, notice_table(spark)).collect()}
    shingles = len(re.findall(r"\w+", text)) - 4
    assert got[3] == (["mit-text"], round((shingles - 5) / shingles, 2))
    assert {k: v[0] for k, v in got.items()} == {1: ["mit"], 2: ["mit-text"], 3: ["mit-text"], 4: [], 5: [], 6: [], 7: ["gpl-3.0", "mit"]}


def test_licenses_without_the_set_are_the_same(spark, docs_of, monkeypatch):
    from pageloom.llm import license_scan as module

    docs = docs_of((1, "a b c d e f g. All rights reserved."), (2, NOTICES["bsd-text"]), (3, "nothing"))
    want = sorted(map(str, license_matches(docs, notice_table(spark)).collect()))
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert sorted(map(str, license_matches(docs, notice_table(spark)).collect())) == want


def test_licenses_of_odd_rows(spark, odd_docs):
    table = spark.createDataFrame([("x", "x"), ("none", None), (None, "x"), ("five", "one two three four five")], "license string, text string")
    got = license_matches(odd_docs, table).collect()
    assert sorted((str(r["doc_id"]), tuple(r["licenses"])) for r in got if r["n_matches"]) == [("5", ("five",)), ("5", ("five",)), ("8", ("x",))]
    assert license_matches(odd_docs.limit(0), table).count() == 0
    assert {r["n_matches"] for r in license_matches(odd_docs, table.limit(0)).collect()} == {0}


def test_native_operators_run_no_python(spark, docs_of):
    docs = docs_of((1, "a b", "en", "s"), (2, "c", "en", "t"))
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    for df in (mix_sources(docs), decontaminate(docs, bench), decontaminate(docs, bench, "span"), license_matches(docs, notice_table(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_items_digest_matches_the_contract(spark, docs_of):
    bench = spark.createDataFrame([(10, "a b"), (9, "a b")], "item_id bigint, text string")
    row = contamination(docs_of((1, "a b c")), bench).select(F.sha2(F.array_join("items", ","), 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"10,9").hexdigest()
