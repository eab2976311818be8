import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pageloom.llm.binary_codes import codes, embedding_links, estimates, rotation
from pageloom.llm.cdc_dedup import chunk_ends, chunks, dedup_substrings, gear_hash, windows
from pageloom.llm.components import components
from pageloom.llm.simhash_dedup import fingerprint, grid_links, keep_one, simhash_groups


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    links = {"chain": [(i, i + 1) for i in range(40)], "star": [(9, i) for i in range(60)],
             "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)], "none": []}[kind]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {n for p in links if p[0] != p[1] for n in p}
    assert got == union(nodes, [p for p in links if p[0] != p[1]])


def slow_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " ", "One", "one two", "A b c d e f a b c d e f É é", "x " * 50_000):
        assert fingerprint(text if text is None else text.encode()) & (2**64 - 1) == slow_fingerprint(text)


@pytest.mark.parametrize("seed", range(3))
def test_grid_finds_each_pair_once(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    prints = set(base)
    for b in base:
        for _ in range(60):
            p = b
            for _ in range(rng.choice([1, 2, 2, 3, 4])):
                p ^= 1 << rng.choice([*range(8), *range(64)])
            prints.add(p)
    prints = sorted(prints)
    rows = [(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(prints)]
    got = [(r["a"], r["b"]) for r in grid_links(spark.createDataFrame(rows, "fp bigint, node bigint")).collect()]
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_groups_and_survivors(spark, docs_of):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(5)]
    rows = [(10 * k + j, t if j == 0 else t.replace("w7 ", "w8 ", j - 1)) for k, t in enumerate(base) for j in range(4)]
    rows += [(200 + i, base[0].upper()) for i in range(30)] + [(300, None), (301, "")]
    groups = {r["doc_id"]: r["component_id"] for r in simhash_groups(docs_of(*rows)).collect()}
    prints = {d: slow_fingerprint(t) for d, t in rows}
    ids = sorted(prints)
    assert groups == union(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {r["doc_id"] for r in keep_one(docs_of(*rows)).collect()} == set(groups.values())


def test_simhash_of_odd_rows(odd_docs):
    groups = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash_groups(odd_docs).collect())
    assert groups == sorted([("1", "1"), ("2", "1"), ("3", "1"), ("None", "None"), ("5", "5"), ("5", "5"), ("6", "6"), ("7", "7"), ("8", "8")])
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "5", "6", "7", "8", "None"]
    assert simhash_groups(odd_docs.limit(0)).count() == 0 and keep_one(odd_docs.limit(0)).count() == 0


def test_gear_hash_rolls():
    data = np.frombuffer(bytes(random.Random(0).randrange(256) for _ in range(300)), np.uint8)
    from pageloom.llm.cdc_dedup import _GEAR

    h, want = 0, []
    for b in data:
        h = (2 * h + int(_GEAR[b])) % 2**32
        want.append(h)
    assert gear_hash(data).tolist() == want


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "do", "ki", "lu", "me"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_chunks_cover_the_text_and_resist_insertions():
    rng = random.Random(5)
    text = prose(rng, 2000)
    stops, words = chunk_ends(text.encode())
    assert stops[-1] == len(text) and words.sum() == 2000 and (np.diff(stops) > 0).all()
    before = {c[0] for c in chunks(text.encode())}
    after = {c[0] for c in chunks((text[:3000] + " inserted words here" + text[3000:]).encode())}
    assert len(before - after) < 6
    assert chunks(None) == [] and chunks(b"") == [] and len(chunks(b"  \n")) == 1


def test_repeated_passages_are_cut_once(spark, docs_of):
    rng = random.Random(6)
    passage = prose(rng, 70)
    rows = [(i, f"{prose(rng, 100)} {passage} {prose(rng, 100)}") for i in range(12)]
    rows += [(50, prose(rng, 150)), (51, rows[0][1]), (52, None), (53, "")]
    got = {r["doc_id"]: r for r in dedup_substrings(docs_of(*rows), report=True).collect()}
    assert got[0]["text"] == rows[0][1] and got[50]["text"] == rows[13 - 1][1] and got[52]["text"] is None and got[53]["text"] == ""
    for i in range(1, 12):
        left = got[i]["text"]
        assert passage not in left and 200 <= len(left.split()) < 230 and got[i]["n_chars"] == len(left)
        assert left.split()[:95] == rows[i][1].split()[:95] and left.split()[-95:] == rows[i][1].split()[-95:]
    assert len(got[51]["text"].split()) == 0


def test_short_repeats_stay(spark, docs_of):
    rng = random.Random(8)
    line = prose(rng, 12)
    rows = [(i, f"{prose(rng, 60)}\n{line}\n{prose(rng, 60)}") for i in range(8)]
    assert {r["doc_id"]: r["text"] for r in dedup_substrings(docs_of(*rows)).collect()} == dict(rows)


def test_common_phrases_are_no_passage(spark, docs_of):
    rng = random.Random(9)
    # Any four words in a row are common, and no 25 come twice.
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "zeta"]) for _ in range(300))) for i in range(40)]
    words = [t.split() for _, t in rows]
    runs = [tuple(w[k: k + 25]) for w in words for k in range(276)]
    assert len(set(runs)) == len(runs)
    got = {r["doc_id"]: r for r in dedup_substrings(docs_of(*rows), report=True).collect()}
    assert {i: r["text"] for i, r in got.items()} == dict(rows)
    assert sum(r["words_cut"] for r in got.values()) == 0


def test_windows_cover_every_repeated_run():
    rng = random.Random(10)
    for _ in range(50):
        own = [(rng.randrange(1 << 40), 0, rng.choice([2, 3, 5, 9, 40])) for _ in range(rng.randint(1, 30))]
        spans = [(i, j) for _, i, j in windows(own)]
        assert len(set(spans)) == len(spans) and all(sum(c[2] for c in own[i:j]) >= 25 for i, j in spans)
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                inside = {k for a, b in spans if i <= a and b <= j for k in range(a, b)}
                assert inside == (set(range(i, j)) if sum(c[2] for c in own[i:j]) >= 25 else set())


def test_a_repeat_in_its_own_document_leaves_one(spark, docs_of):
    line = "one two three four five six seven eight nine ten eleven twelve."
    got = dedup_substrings(docs_of((1, " ".join([line] * 12)))).collect()[0]["text"]
    assert 25 <= len(got.split()) < 60 and got.startswith(line)


def test_marks_never_reach_another_text_of_the_id(spark, docs_of):
    rng = random.Random(11)
    passage = prose(rng, 60)
    unique = [prose(rng, 300) for _ in range(4)]
    rows = [(1, f"{passage} {prose(rng, 40)}"), (2, f"{prose(rng, 40)} {passage}"), (2, unique[0]), (2, unique[1]),
            (None, f"{prose(rng, 30)} {passage} {prose(rng, 30)}"), (None, unique[2]), (None, unique[3]), (7, unique[3])]
    for limit in (None, 0):
        if limit is not None:
            import pageloom.llm.common as common
            before, common.BROADCAST_ROWS = common.BROADCAST_ROWS, limit
        got = [r["text"] for r in dedup_substrings(docs_of(*rows).repartition(3)).collect()]
        if limit is not None:
            common.BROADCAST_ROWS = before
        assert len(got) == len(rows) and set(unique[:3]) <= set(got)
        assert sum(passage in t for t in got) == 1 and sum(unique[3] in t for t in got) == 1


def test_texts_without_white_space_are_cut(spark, docs_of):
    rng = random.Random(12)
    passage, heads = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1500)), ["".join(
        chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(400)) for _ in range(3)]
    rows = [(i, h + passage + h[::-1]) for i, h in enumerate(heads)]
    got = {r["doc_id"]: r["text"] for r in dedup_substrings(docs_of(*rows)).collect()}
    assert got[0] == rows[0][1]
    for i in (1, 2):
        assert 800 <= len(got[i]) < 900 and got[i].startswith(heads[i][:380]) and got[i].endswith(heads[i][::-1][-380:])
    same = ("a" * 5000).encode()
    stops, words = chunk_ends(same)
    assert stops[-1] == 5000 and words.sum() >= 5000 // 72 and (np.diff(stops, prepend=0) > 0).all()
    whole = passage.encode()
    for stop in chunk_ends(whole)[0]:
        whole[:stop].decode()


def plain_cut(docs, least=25):
    """Texts after cutting by comparing the words of every window of chunks with all that came before, for unique ids in order."""
    seen, out = {}, {}
    for doc, text in sorted(docs):
        own = chunks(text.encode())
        marked = [False] * len(own)
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                size = sum(c[2] for c in own[i:j])
                if size >= least and (size - own[i][2] < least or size - own[j - 1][2] < least):
                    first = seen.setdefault(tuple(c[0] for c in own[i:j]), (doc, i))
                    if first != (doc, i):
                        start = max(i, first[1] + j - i) if first[0] == doc else i
                        for k in range(start, j):
                            marked[k] = True
        kept, at, i, data = b"", 0, 0, text.encode()
        while i < len(own):
            j = i
            while j < len(own) and marked[j]:
                j += 1
            if j > i and sum(c[2] for c in own[i:j]) >= least:
                kept += data[at: own[i - 1][1] if i else 0]
                at = own[j - 1][1]
            i = max(j, i + 1)
        out[doc] = (kept + data[at:]).decode()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cuts_are_those_of_all_windows(spark, docs_of, seed):
    rng = random.Random(100 + seed)
    parts = [prose(rng, rng.choice([10, 30, 60])) for _ in range(8)] + ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200))]
    rows = [(i, " ".join(rng.choice([rng.choice(parts), prose(rng, rng.choice([3, 20]))]) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    assert {r["doc_id"]: r["text"] for r in dedup_substrings(docs_of(*rows).repartition(4)).collect()} == plain_cut(rows)


def test_one_row_of_a_repeated_id_stays_whatever_the_order(spark, docs_of):
    rows = [(3, "b second text of its own"), (3, "a first text of its own"), (3, "c third one"), (4, "alone")]
    for n in (1, 3):
        assert sorted(r["text"] for r in keep_one(docs_of(*rows).repartition(n)).collect()) == ["a first text of its own", "alone"]


def test_cdc_of_odd_rows(odd_docs):
    out = dedup_substrings(odd_docs, report=True)
    assert out.columns == [*odd_docs.columns, "chunks_1", "chunks_cut", "words_cut"]
    rows = out.collect()
    assert sorted(str(r["text"])[:20] for r in rows) == sorted(str(r["text"])[:20] for r in odd_docs.collect())
    assert dedup_substrings(odd_docs.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    x[1::2] = x[::2] + 0.2 * rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits, factor = codes(x)
    value, bound = estimates(x @ rotation(64, 5), bits, factor)
    error = (value - x @ x.T)[~np.eye(400, dtype=bool)]
    assert abs(error.mean()) < 0.005
    assert (np.abs(value - x @ x.T) <= bound[None]).mean() > 0.9999


def brute_links(rows, cosine=0.95):
    good = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.array(v) / np.linalg.norm(v)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine]
    return {i: sum(i in p for p in links) for i, _ in rows}, union([i for i, _ in rows], links)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def test_embedding_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        center = rng.normal(size=24)
        for j in range(rng.integers(1, 9)):
            rows.append((len(rows), (center + 0.22 * rng.normal(size=24) * (j > 1)).tolist()))
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [1.0, None]), (905, [3.0, 4.0]), (906, [3.0, 4.1]),
             (907, [float("inf")] + [1.0] * 23)]
    links, roots = brute_links(rows)
    got = {r["vec_id"]: r for r in embedding_links(vectors(spark, rows)).collect()}
    assert sum(links.values()) > 100
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == roots
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_a_large_group_is_split_into_blocks(spark, monkeypatch):
    from pageloom.llm import binary_codes as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rng = np.random.default_rng(4)
    center = rng.normal(size=16)
    rows = [(i, (center + 0.12 * rng.normal(size=16)).tolist()) for i in range(90)] + [(100 + i, center.tolist()) for i in range(20)]
    links, roots = brute_links(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_links(vectors(spark, rows)).collect()}
    assert got == {i: (links[i], roots[i]) for i in links}


def test_embeddings_of_odd_rows(spark):
    df = vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (2, [2.0, 4.0])]).withColumn("id", F.lit(7)).withColumn("links", F.lit("x"))
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in embedding_links(df).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 2, "1"), ("None", 0, "None")]
    assert embedding_links(df.limit(0)).count() == 0
