import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.llm import gru_lm
from pageloom.llm.byte_cnn import WINDOW, identify, learn_languages, text_windows
from pageloom.llm.cotraining import META_VIEW, TEXT_VIEW, co_train, quality, text_view
from pageloom.llm.toxicity import (INSULT, THREAT, Lexical, clause_words, drop_toxic, learn_grammar, matches, seed_grammar, toxicity)

SYLLABLES = {"en": ["th", "ing", "and", "er", "wh"], "de": ["sch", "ung", "keit", "ä", "pf"], "fr": ["eau", "é", "oi", "que", "ç"]}


def words_of(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, docs_of):
    """240 documents; every fourth is toxic: 'zorb...' words in several clauses, with any ending."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        lang = "en de fr".split()[i % 3]
        words = words_of(rng, lang, rng.randint(30, 80))
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "zorb" + rng.choice(SYLLABLES[lang]))
        rows.append((i, " ".join(w + ("." if rng.random() < 0.1 else "") for w in words), lang, f"s{i % 2}"))
        labels.append((i, int(i % 3 != 0), int(i % 4 == 0)))
    return docs_of(*rows).cache(), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def symbols(text, grammar=None):
    lexical = Lexical(grammar or seed_grammar())
    return matches([lexical[w] for w in clause_words(text.encode())])


def test_transducers_mark_negation_report_and_target():
    def flags(text):
        return [(k, n, r, t) for k, _, n, r, t in symbols(text)]
    assert flags("a plain day") == []
    assert flags("what an Idiot") == [(INSULT, False, False, False)]
    assert flags("you are an idiot") == [(INSULT, False, False, True)]
    assert flags("idiot you are") == [(INSULT, False, False, True)]
    assert flags("not an idiot") == [(INSULT, True, False, False)]
    assert flags("not here. an idiot") == [(INSULT, False, False, False)]
    assert flags("he said that idiot left; a moron stayed") == [(INSULT, False, True, True), (INSULT, False, False, False)]
    assert flags("i will kill you") == [(THREAT, False, False, True)]
    assert flags("not one two three four five idiot") == [(INSULT, False, False, False)]


def test_learned_stems_find_held_out_toxic_documents(corpus):
    docs, labels = corpus
    grammar = learn_grammar(docs, labels, train=(3, 1, False))
    assert any(b"zorb".startswith(s) or s.startswith(b"zorb") for s in grammar.stems)
    got = {r["doc_id"]: r for r in toxicity(docs, grammar).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50
    assert all(got[i]["predicted"] == int(i % 4 == 0) and 0 <= got[i]["score"] <= 1 for i in held)
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) for r in got.values())
    kept = drop_toxic(docs, grammar)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["predicted"]}


def test_held_out_labels_teach_nothing(corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert learn_grammar(docs, labels).weights == learn_grammar(docs, flipped).weights


def test_toxicity_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(5, 1), (5, None), (None, 1), (8, 7)], "doc_id bigint, toxic int")
    grammar = learn_grammar(odd_docs, labels)
    assert grammar == seed_grammar()
    rows = toxicity(odd_docs, grammar).collect()
    assert len(rows) == 9 and len({r["score"] for r in rows}) == 1 and {r["predicted"] for r in rows} == {0}
    assert drop_toxic(odd_docs, grammar).schema == odd_docs.schema and drop_toxic(odd_docs, grammar).count() == 9
    assert toxicity(odd_docs.limit(0), grammar).count() == 0
    assert learn_grammar(odd_docs.limit(0), labels.limit(0)) == grammar


def test_windows_cover_the_whole_text():
    text = "Äb c1, d" * 400
    windows = text_windows(text.encode())
    assert windows.shape[1] == WINDOW
    assert windows.tobytes().decode("utf-8").rstrip() == ("Äb c d" * 400)
    assert len(text_windows(b"")) == 1


def test_languages_of_held_out_documents(corpus):
    docs, _ = corpus
    net = learn_languages(docs)
    got = {r["doc_id"]: r for r in identify(docs, net).collect()}
    right = [r["lang_pred"] == "en de fr".split()[i % 3] for i, r in got.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(right) > 30 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    again = {r["doc_id"]: r["lang_pred"] for r in identify(docs.repartition(5), learn_languages(docs.repartition(5))).collect()}
    assert again == {i: r["lang_pred"] for i, r in got.items()}


def test_languages_of_odd_rows(odd_docs):
    net = learn_languages(odd_docs)
    rows = identify(odd_docs, net).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert all(r["lang_pred"] in ("en", "de") for r in rows if r["doc_id"] not in (1, 2, 3))
    assert learn_languages(odd_docs.limit(0)) is None
    assert {r["lang_pred"] for r in identify(odd_docs, None).collect()} == {"und"}
    assert identify(odd_docs.limit(0), net).count() == 0


def counted(docs):
    """Counts that the base score is made of, from the training texts."""
    counts = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 10 != 0:
            counts.update(gru_lm.tokens(t.encode() if t is not None else None))
    return counts


def test_lm_base_scores_and_gain(spark, docs_of, monkeypatch):
    monkeypatch.setattr(gru_lm, "KNOWN", 300)  # so that rarer words take the join
    rng = random.Random(2)
    rows = []
    for i in range(300):
        lang = "en de fr".split()[i % 3]
        rows.append((i, " ".join(w for w in words_of(rng, lang, rng.randint(5, 120)))))
    rows += [(400, None), (410, ""), (420, "NEW Words only-here")]
    counts = counted(rows)
    total, distinct = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in gru_lm.lm_scores(docs_of(*rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        own = gru_lm.tokens(t.encode() if t is not None else None)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert got[i]["n_tokens"] == len(own) and got[i]["n_known"] == sum(counts[w] > 0 for w in own)
        assert got[i]["train_tokens"] == total and abs(got[i]["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert got[i]["score"] < 0
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0 and i < 300]
    assert sum(got[i]["score"] for i in held) > 0.97 * sum(got[i]["base_score"] for i in held)


def test_lm_words_cut_by_arrow_are_the_tokens(monkeypatch):
    monkeypatch.setattr(gru_lm, "SPLIT_BYTES", 1 << 12)  # many parts
    rng = random.Random(4)
    odd = ["".join(chr(rng.choice([0, 9, 10, 11, 12, 13, 28, 32, 65, 90, 97, 133, 160, 0x130, 0x2003, 0x1F600])) for _ in range(rng.randint(0, 9)))
           for _ in range(5000)] + ["", None, " ", "\n\n", " a", "A "]
    vocab = gru_lm.Vocabulary({w: k for k, w in enumerate([b"", b"a", b"aa", b"za"])}, np.array([9, 5, 3, 2]), 3, {b"aza": 4, b"z": 7, b"a": 2}, 99, 9,
                              np.full(gru_lm.GROUPS, 5.0), np.full(gru_lm.GROUPS, 0.5))
    for kind in (pa.string(), pa.large_string()):
        texts = pa.array(odd, kind).slice(3)
        cut, inputs = [], []
        for part in gru_lm.split_texts(texts):
            words = part.distinct.to_pylist()
            assert len(set(words)) == len(words)
            cut += [[words[k] for k in text] for text in gru_lm.by_text(part.tokens, part.sizes)]
            inputs += gru_lm.by_text(gru_lm.encode(part, vocab)[0][part.tokens], part.sizes)
        want = [gru_lm.tokens(t) for t in texts.cast(pa.large_binary()).to_pylist()]
        assert cut == want
        # A word with an output is itself, any other its group: by the last three bytes, else the last one, else the first group.
        group = lambda w: 3 + vocab.endings.get(w[-3:], vocab.endings.get(w[-1:], 0))
        assert [i.tolist() for i in inputs] == [[[b"", b"a", b"aa"].index(w) if w in (b"", b"a", b"aa") else group(w) for w in t] for t in want]


def test_every_training_text_teaches_the_network(spark, docs_of, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(words_of(rng, "en", 2000))) for i in range(160)]  # more than the 200,000 tokens of a former sample
    taught = {}

    def seen(name, function):
        def run(training, *rest):
            taught[name] = training.count()
            return function(training, *rest)
        return run

    monkeypatch.setattr(gru_lm, "train", seen("network", gru_lm.train))
    monkeypatch.setattr(gru_lm, "_ending_groups", seen("endings", gru_lm._ending_groups))
    gru_lm.lm_scores(docs_of(*rows))
    training = sum(zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows)
    assert taught == {"network": training, "endings": training}


def test_shards_are_dealt_over_the_rounds_once(spark, docs_of, monkeypatch):
    rng = random.Random(13)
    docs = docs_of(*[(i, " ".join(words_of(rng, "en", 100))) for i in range(90)])
    counts = gru_lm.word_counts(docs).collect()
    words = sorted((bytes(r["word"]) for r in counts), key=lambda w: (w != b"", w))[:64]
    numbers = {bytes(r["word"]): r["n"] for r in counts}
    vocab = gru_lm.Vocabulary({w: k for k, w in enumerate(words)}, np.array([numbers[w] for w in words]), len(words), {}, 9090,
                              len(counts), np.full(gru_lm.GROUPS, 5.0), np.full(gru_lm.GROUPS, 0.5))
    monkeypatch.setattr(gru_lm, "SHARD", 1000)
    given = []
    original = gru_lm.materialize
    monkeypatch.setattr(gru_lm, "materialize", lambda df: given.append(original(df)) or given[-1])
    flat = gru_lm.train(docs, vocab, 9090)
    rows = given[0].collect()
    assert len(rows) == 90 and sum(len(r["ids"]) // 2 for r in rows) == 9090 and {r["shard"] for r in rows} == set(range(9))
    part = [r for r in rows if r["shard"] % 3 == 0]
    batch = pa.RecordBatch.from_pylist(sorted(({"shard": r["shard"], "ids": bytes(r["ids"])} for r in part), key=lambda r: (r["shard"], r["ids"])))
    start = gru_lm.Network(vocab).flat()
    out = pa.Table.from_batches(list(gru_lm._train_shards([batch.slice(0, 7), batch.slice(7)], vocab, start, 0.2, 1024)))
    assert set(out["weight"].to_pylist()) == {float(sum(len(r["ids"]) // 2 for r in part))}
    assert np.isfinite(flat).all() and not np.allclose(flat, start)


def test_network_is_a_distribution_and_carries_its_state():
    counts = np.arange(100, 0, -1)
    vocab = gru_lm.Vocabulary({f"w{i}".encode(): i for i in range(100)}, counts, 100, {}, 5050, 100, np.full(gru_lm.GROUPS, 5.0), np.full(gru_lm.GROUPS, 0.5))
    net = gru_lm.Network(vocab)
    ids = np.arange(100 + gru_lm.GROUPS, dtype=np.int32)
    h = np.repeat(np.random.default_rng(0).normal(0, 0.5, (1, gru_lm.HIDDEN)).astype(np.float32), len(ids), axis=0)
    assert abs(np.exp(net.log_probability(h, ids)).sum() - 1) < 1e-4
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 100, n).astype(np.int32) for n in (1, 7, 300, 50, 2)]
    together = gru_lm.score_texts(texts, net)
    alone = [gru_lm.score_texts([t], net)[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-2)


def test_scores_are_those_of_a_plain_loop():
    vocab = gru_lm.Vocabulary({f"w{i}".encode(): i for i in range(70)}, np.arange(70, 0, -1), 70, {}, 999, 70, np.full(gru_lm.GROUPS, 5.0), np.full(gru_lm.GROUPS, 0.5))
    assert b"pageloom" not in pickle.dumps(vocab.plain())
    net = gru_lm.Network(gru_lm.Vocabulary(*vocab.plain()))
    p, size = {k: v.astype(float) for k, v in net.p.items()}, gru_lm.HIDDEN
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 70 + gru_lm.GROUPS, n).astype(np.int32) for n in (1, 3, 120, 17)]

    def squash(x):
        return x / (1 + abs(x))

    def softmax(x):
        return np.exp(x) / np.exp(x).sum()

    want = []
    for text in texts:
        h, total = np.zeros(size), 0.0
        for token in text.tolist():
            cls = token // gru_lm.CLASS if token < 70 else net.fixed + token - 70
            total += math.log(softmax(h @ p["cls"] + p["cls_bias"])[cls])
            if token < 70:
                part = slice(cls * gru_lm.CLASS, (cls + 1) * gru_lm.CLASS)
                total += math.log(softmax(p["word"][part] @ h + p["word_bias"][part])[token % gru_lm.CLASS])
            a, g = p["emb"][token] + p["bias"], h @ p["gate"]
            z, r = (0.5 * (1 + squash(a[k * size: (k + 1) * size] + g[k * size: (k + 1) * size])) for k in (0, 1))
            n = squash(a[2 * size:] + r * g[2 * size:])
            h = (1 - z) * n + z * h
        want.append(total)
    assert np.allclose(gru_lm.score_texts(texts, net), want, rtol=1e-4)


def test_gradients_match_differences():
    vocab = gru_lm.Vocabulary({f"w{i}".encode(): i for i in range(70)}, np.arange(70, 0, -1), 70, {}, 999, 70, np.full(gru_lm.GROUPS, 5.0), np.full(gru_lm.GROUPS, 0.5))
    net = gru_lm.Network(vocab)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 75, (3, 6)).astype(np.int32)
    fresh, live = np.zeros((3, 6), bool), np.ones((3, 6), bool)
    fresh[:, 0] = fresh[1, 3] = True
    live[2, 4:] = False

    def loss():
        before, _, _ = net.states(ids, fresh, np.zeros((3, gru_lm.HIDDEN)))
        total = 0.0
        for h, x in zip(before.reshape(-1, gru_lm.HIDDEN)[live.T.ravel()].astype(float), ids.T.ravel()[live.T.ravel()]):
            c = x // gru_lm.CLASS if x < net.own else net.fixed + x - net.own
            z = h @ net.p["cls"] + net.p["cls_bias"]
            total -= z[c] - np.log(np.exp(z).sum())
            if x < net.own:
                part = slice(c * gru_lm.CLASS, (c + 1) * gru_lm.CLASS)
                z = net.p["word"][part] @ h + net.p["word_bias"][part]
                total -= z[x - c * gru_lm.CLASS] - np.log(np.exp(z).sum())
        return total

    grad, _ = net.gradients(ids, fresh, live, np.zeros((3, gru_lm.HIDDEN)))
    for name, place in (("gate", (3, 5)), ("gate", (2, 40)), ("cls", (3, 1)), ("bias", (4,)), ("bias", (20,)), ("bias", (40,)), ("word", (int(ids[0, 2]) % 70, 3))):
        at = net.p[name][place]
        net.p[name][place] = at + 1e-3
        up = loss()
        net.p[name][place] = at - 1e-3
        down = loss()
        net.p[name][place] = at
        assert abs((up - down) / 2e-3 - grad[name][place]) < 1e-3


def test_lm_of_odd_rows(odd_docs):
    rows = gru_lm.lm_scores(odd_docs).collect()
    assert len(rows) == 9 and all(np.isfinite([r["score"], r["base_score"]]).all() for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {1: 1, 2: 1, 3: 1, None: 6, 5: 6, 6: 60_001, 7: 7, 8: 2}
    assert gru_lm.lm_scores(odd_docs.limit(0)).count() == 0
    nothing = gru_lm.lm_scores(odd_docs.filter("doc_id = 8").withColumn("doc_id", F.lit(10))) if zlib.crc32(b"10") % 10 == 0 else None
    assert nothing is None or nothing.count() == 1


def test_co_training_uses_the_pool_and_separates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 80).astype(float)
    pool = rng.integers(0, 2, 2000).astype(float)
    make = lambda label, width, gap: rng.normal(size=(len(label), width)) + gap * label[:, None] * (np.arange(width) < 4)
    test = rng.integers(0, 2, 1000).astype(float)
    labelled, unlabelled, seen = ((make(z, TEXT_VIEW, 1.2), make(z, META_VIEW, 1.0)) for z in (y, pool, test))
    score, text, meta = co_train(*labelled, y, *unlabelled).combine(*seen)
    right = lambda p: ((p > 0.5) == test).mean()
    assert right(score) > max(right(text), right(meta))
    alone = co_train(*labelled, y, np.zeros((0, TEXT_VIEW)), np.zeros((0, META_VIEW)))
    assert right(score) > 0.85 and right(score) > right(alone.combine(*seen)[0]) + 0.05


def test_quality_on_held_out_documents(spark, docs_of):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        words = words_of(rng, "en", 60)
        rows.append((i, " ".join(words) + "." if good else " ".join(w + "&&&" for w in words), "en", "good" if good else "bad"))
        if i % 2:
            labels.append((i, int(good)))
    scored = quality(docs_of(*rows), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    right = [r["predicted"] == int(r["doc_id"] % 3 != 0) for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(right) > 50 and np.mean(right) > 0.95


def test_quality_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(5, 1), (8, None)], "doc_id bigint, quality int")
    rows = quality(odd_docs, labels).collect()
    assert len(rows) == 9 and {r["score"] for r in rows} == {0.5}
    assert quality(odd_docs.limit(0), labels.limit(0)).count() == 0
    assert text_view(None) == text_view(b"  ") == [0.0] * TEXT_VIEW
