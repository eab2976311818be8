"""The prefix trie, the token alignment and the quality rules against plain versions of each."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import prefix_trie as trie_module
from pageloom.llm.prefix_trie import _common, conversation_trie, with_turns
from pageloom.llm.quality_rules import (CLASSES, class_counts, class_table, dup_lines, js_distance, language_references,
                                        quality_rules, repeat_words)
from pageloom.llm.queries import TOKENIZERS
from pageloom.llm.token_alignment import TokenizerA, TokenizerB, align, merge_path, pieces_of, text_windows

CONVERSATION = "conv_id bigint, turn bigint, role string, text string"
FILES = [f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"]


def every_prefix(rows, every=100, most=6):
    """Nodes of the trie by walking every prefix of every rebuilt conversation."""
    def key(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32] + f"{len(text):08x}"

    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, every)), [])[:h] + turns[h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * len(path[-1][1] if path else "") + sum(saved[c] for c in children[path])
    return sorted(str((
        min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), leaves[path], saved[path],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if rebuilt[c] == path).encode()).hexdigest())) for path, m in members.items())


def nodes_of(frame):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(str(tuple(r)) for r in frame.select(*names).collect())


def conversation_rows(seed, count=260):
    """Few texts, so that paths share heads; a third of the conversations are the same one; some turns are odd."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 700), count):
        if rng.random() < 0.33:
            rows += [(c, t, "user", f"same {t}") for t in range(7)]
            continue
        for t in range(rng.choice([1, 2, 4, 9, 14])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "bé", "日本", "c" * 20])))
    return rows + [(None, 0, "user", "nobody's"), (5000, None, None, None), (5101, 0, "user", "a")]


@pytest.mark.parametrize("seed", range(3))
def test_trie_is_that_of_every_prefix(spark, seed):
    rows = conversation_rows(seed)
    frame = spark.createDataFrame(rows, CONVERSATION)
    want = every_prefix(rows)
    for shards in (1, 7, 40):
        assert nodes_of(conversation_trie(frame.repartition(3), shards=shards)) == want


def test_trie_with_a_small_skeleton_joins_shards(spark, monkeypatch):
    monkeypatch.setattr(trie_module, "SKELETON_NODES", 3)
    rows = conversation_rows(9)
    assert nodes_of(conversation_trie(spark.createDataFrame(rows, CONVERSATION), shards=30)) == every_prefix(rows)


def test_trie_of_long_equal_and_missing_conversations(spark):
    rows = [(c, t, "user", f"t{t}") for c in (300, 301, 302) for t in range(700)] + [(301, 700, "user", "more")]
    rows += [(c, 0, "user", "hi") for c in range(1000, 1600)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION + ", path int, shard string")
    assert nodes_of(conversation_trie(frame, shards=5)) == every_prefix(rows)
    assert conversation_trie(frame.limit(0)).count() == 0
    # A conversation without a turn left: its base is absent, and h drops its only turn.
    lone = next(c for c in range(901, 999) if zlib.crc32(str(c).encode()) % 6)
    assert nodes_of(conversation_trie(spark.createDataFrame([(lone, 0, "u", "x")], CONVERSATION))) == every_prefix([(lone, 0, "u", "x")])


def test_trie_nodes_meet_their_turns(spark):
    frame = spark.createDataFrame([(100, 0, "user", "hello"), (100, 1, None, None)], CONVERSATION)
    got = {(r["depth"], r["role"], r["text"]) for r in with_turns(conversation_trie(frame), frame).collect()}
    assert got == {(0, None, None), (1, "user", "hello"), (2, "", "")}


def test_common_turns():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (b"".join(bytes([rng.choice([1, 1, 1, 2])]) * 20 for _ in range(rng.randrange(9))) for _ in range(2))
        want = 0
        while want < min(len(a), len(b)) // 20 and a[20 * want: 20 * want + 20] == b[20 * want: 20 * want + 20]:
            want += 1
        assert _common(a, b) == want


def all_links(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per text, by comparing tokens with each other."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in plain}
    for number, c in enumerate(c for c in range(256) if c not in plain):
        letters[chr(256 + number)] = c

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def spans(tokens):
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        return list(zip([0, *ends], ends))

    found, counts = [], Counter()
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append(None)
            continue
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        links = [(x, y) for x, (s, e) in zip(ids_a, at_a) for y, (u, v) in zip(ids_b, at_b) if s < v and u < e]
        ends = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups = [("".join(","), x, y) for x, y in zip([0, *ends], ends)]
        text_of = ";".join(
            ",".join(str(i) for i, (_, e) in zip(ids_a, at_a) if x < e <= y) + "|" + ",".join(str(i) for i, (_, e) in zip(ids_b, at_b) if x < e <= y)
            for _, x, y in groups)
        found.append((len(ids_a), len(ids_b), len(ends), links, hashlib.sha256(text_of.encode()).hexdigest()))
        counts.update(links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (
        *f[:3], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for f in found]


ODD_TEXTS = ["", None, "x", " lead", "trail ", "a  b", "▁ x", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語のテキスト。 そう", "\x00 nul",
             "é ﬁ １", "\n\n\t", "👩‍👩‍👧 ok", "ab " * 90, "日本" * 60, "a" * 300, "The same text, twice.", "The same text, twice."]


@pytest.mark.parametrize("size, hot", [(1 << 16, 1 << 20), (16, 40), (7, 0)])
def test_alignment_is_that_of_all_links(spark, size, hot):
    files = [open(f, "rb").read() for f in FILES]
    rng = random.Random(size)
    words = ["the", "Quick", "brünn", "über-", "x1", "2027", "don't", "日本", "\n", "naïve", "...", "tokenization"]
    texts = ODD_TEXTS + [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 150]))) for _ in range(25)]
    docs = spark.createDataFrame([(i // 2 if i > 3 else None, t, i, "n") for i, t in enumerate(texts)], "doc_id bigint, text string, n_a int, sha string")
    got = align(docs.repartition(3), *files, size=size, hot=hot)
    assert got.columns == ["doc_id", "n_a", "sha", "n_a_1", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = {r["n_a"]: tuple(r)[3:] for r in got.collect()}
    want = all_links(texts)
    assert rows == dict(enumerate(want))
    assert align(docs.limit(0), *files).count() == 0


def test_merge_path_pieces_are_even_and_whole():
    rng = np.random.default_rng(3)
    for _ in range(40):
        cuts_a, cuts_b = (np.unique(rng.integers(1, 400, rng.integers(1, 200))) for _ in range(2))
        ends_a, ends_b = (np.unique(np.append(c, 400)) for c in (cuts_a, cuts_b))
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        for d in range(0, len(both) + 1, 13):
            i, j = merge_path(ends_a, ends_b, d)
            assert i + j in (d, d + 1)
            assert sorted([*ends_a[:i], *ends_b[:j]]) == both[: i + j].tolist()
        lengths = np.arange(401)
        ids_a, ids_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        pieces = pieces_of(ids_a, ids_b, lengths, lengths, 20)
        sizes = [(int(a.sum()) - p[0] - p[1], int(b.sum()) - p[2] - p[3]) for a, b, *p in pieces]
        assert all(x == y > 0 for x, y in sizes) and sum(x for x, _ in sizes) == 400
        assert all(len(a) + len(b) <= 20 + 4 for a, b, *_ in pieces)


def test_windows_and_encoders_agree_with_whole_texts():
    from tokenizers import Tokenizer

    a, b = TokenizerA(open(FILES[0], "rb").read()), TokenizerB(open(FILES[1], "rb").read())
    assert b.cuts_at_spaces
    text = "Some words, don't you see? 12 apples  and  more\nlines of text here " * 40
    parts = text_windows(text, 50)
    assert len(parts) > 20 and " ".join(parts) == text
    assert [i for p in parts for i in a.encode(" " + p).tolist()] == a.encode(" " + text).tolist()
    assert [i for p in parts for i in b.encode(p).tolist()] == b.encode(text).tolist()
    other = Tokenizer.from_file(FILES[0])
    other.encode_special_tokens = True
    rng = random.Random(5)
    for _ in range(300):
        odd = "".join(rng.choice("aZ é日 ​́\n\t 19'.!<|>\U0001f600م") for _ in range(rng.randrange(1, 40)))
        assert a.encode(odd).tolist() == other.encode(odd, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        broken = json.loads(open(FILES[0], "rb").read())
        broken["model"]["merges"][:2] = broken["model"]["merges"][1::-1]
        TokenizerA(json.dumps(broken).encode())


def plain_rules(text):
    words = "".join(c if c not in " \t\n\r\x0b\x0c" else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            sum(line in lines[:i] for i, line in enumerate(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def prose(rng, words, size):
    out = []
    for k in range(size):
        out.append(rng.choice(words) if rng.random() < 0.5 else "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8))))
        if k % 12 == 11:
            out[-1] += "."
    return " ".join(out)


def test_rules_keep_prose_and_reject_what_diverges(spark, docs_of):
    rng = random.Random(4)
    english, german = ["the", "of", "and", "to", "in", "is", "it"], ["der", "die", "und", "in", "das", "zu", "für"]
    clean = [(i, prose(rng, english if i % 2 else german, rng.choice([60, 200, 400])), "en" if i % 2 else "de", "s") for i in range(120)]
    junk = [(200, " ".join(w + "$$$" for w in prose(rng, english, 200).split()), "en", "s"),
            (201, prose(rng, english, 200).upper() + "!!", "en", "s"),
            (202, " | ".join(prose(rng, ["unoriset"], 200).split()), "en", "s"), (203, " ".join(str(rng.random()) for _ in range(90)), "de", "s")]
    other = [(300, prose(rng, english, 100), None, "s"), (301, junk[0][1], None, "s"), (302, "日本 " * 3 + prose(rng, ["日本", "語"], 80), "ja", "s"),
             (303, "the of and " * 40, "en", "s"), (304, "too short", "en", "s"), (305, None, "en", "s"), (306, "", None, None)]
    docs = docs_of(*clean, *junk, *other)
    references = language_references(docs, lang_share=0.01)
    assert list(references) == ["de", "en"]
    rows = {r["doc_id"]: r for r in quality_rules(docs, references).collect()}
    for doc, text, *_ in [*clean, *junk, *other]:
        r = rows[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_rules(text)
    assert all(rows[i]["kept"] and rows[i]["nearest"] == lang for i, _, lang, _ in clean)
    assert not any(rows[i]["kept"] for i in (200, 201, 202, 203, 301, 303, 304, 305, 306))
    assert rows[300]["kept"] and rows[300]["nearest"] == "en"
    assert rows[302]["kept"]  # a language without a reference is judged by the base rules alone
    assert all(r["kept"] == (not r["base_failed"]) for r in quality_rules(docs, {}).collect())


def test_references_count_every_word(spark, docs_of):
    rng = random.Random(8)
    texts = [prose(rng, ["The", "(of)", "and", "|", "12"], 300) for _ in range(40)]
    docs = docs_of(*[(i, t, "en", "s") for i, t in enumerate(texts)], (99, None, "en", "s"), (98, "a b c", None, "s"))
    classes, common, total = language_references(docs, word_share=0.01)["en"]
    words = [w.strip(".,;:!?'\"()-").lower() for t in texts for w in t.split()]
    counts = Counter(w if any(c.isalpha() for c in w) else "" for w in words)
    assert total == len(words)
    assert {k.decode(): v for k, v in common.items()} == {k: v for k, v in counts.items() if k == "" or v >= 0.01 * total}
    whole = "".join(texts)
    assert classes[CLASSES.index("lower")] == sum("a" <= c <= "z" for c in whole)
    assert classes.sum() == len(whole)


def test_small_rules():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randrange(14))]
        text = rng.choice([" ", "\n", "\n "]).join(words)
        assert (repeat_words([w.encode() for w in words]), dup_lines(text.encode())) == (plain_rules(text)[4], plain_rules(text)[3])
    text = "aZ0 \t.#\x01é©Ж日ก😀".encode()
    assert class_counts([text, b""], class_table()).tolist() == [[1, 1, 1, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1], [0] * 13]
    p = np.array([[1.0, 1.0, 2.0], [0.0, 0.0, 0.0], [4.0, 0.0, 0.0]])
    want = [0.0, 0.0, math.sqrt(0.5 * 1 * math.log2(1 / 0.625) + 0.5 * (0.25 * math.log2(0.25 / 0.625) + 0.25 + 0.5))]
    assert np.allclose(js_distance(p, np.array([2.0, 2.0, 4.0])), want)


def test_rules_of_odd_rows(spark, odd_docs):
    got = quality_rules(odd_docs, language_references(odd_docs))
    assert got.columns[: len(odd_docs.columns)] == odd_docs.columns and got.count() == odd_docs.count()
    assert quality_rules(odd_docs.limit(0), language_references(odd_docs.limit(0))).count() == 0
    assert not any(r["kept"] for r in got.filter(F.length("text") < 100).collect())
