"""Quality rules: base rules, and the divergence of character classes and common words from language references."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import byte_column, fresh, map_batches, materialize

#: A word is common in a language if it makes up this share of its words or more, so a language has at most 1 / WORD_SHARE.
WORD_SHARE = 1 / 1000
#: A language has a reference if its documents hold this share of all words or more, so there are at most 1 / LANG_SHARE.
LANG_SHARE = 1 / 1000
#: Words that a task gathers before it names those that may be common.
GATHERED = 1 << 18
#: Largest Jensen-Shannon distance (0 to 1) of classes and of common words that passes.
CLASS_LIMIT, WORD_LIMIT = 0.28, 0.5
#: Characters and words from which on the two distances count.
CLASS_LEAST, WORD_LEAST = 200, 50
#: Base rules: words a text needs, and the percentage of its words that may stand in repeated windows.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3

_STOPS, _SYMBOLS = b".,;:!?'\"()-", b"#*$%&|<>"
#: Class of a character, by its first byte; bytes inside a character have none.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "control", "latin_sign", "latin", "other_two", "three_low",
           "three_high", "four")


def class_table() -> np.ndarray:
    """Class number of each first byte; ``len(CLASSES)`` for bytes that continue a character."""
    table = np.full(256, CLASSES.index("symbol"), np.int64)
    table[:32] = table[127] = CLASSES.index("control")
    table[9:14] = table[32] = CLASSES.index("space")
    table[48:58], table[65:91], table[97:123] = (CLASSES.index(c) for c in ("digit", "upper", "lower"))
    table[list(_STOPS)] = CLASSES.index("stop")
    table[128:192], table[192:195], table[195:203], table[203:224] = (
        len(CLASSES), *(CLASSES.index(c) for c in ("latin_sign", "latin", "other_two")))
    table[224:227], table[227:240], table[240:] = (CLASSES.index(c) for c in ("three_low", "three_high", "four"))
    return table


def plain_word(word: bytes) -> bytes:
    """A word without stops around it and with A-Z lower-cased, as the common words are compared."""
    return word.strip(_STOPS).lower()


_LETTER = re.compile(rb"[a-z\x80-\xff]")


def _has_letter(word: bytes) -> bool:
    return _LETTER.search(word) is not None


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    runs = list(zip(*[words[k:] for k in range(window)]))
    counts = Counter(runs)
    if len(counts) == len(runs):
        return 0
    total, reach = 0, 0
    for start, run in enumerate(runs):
        if counts[run] > 1:
            total += start + window - max(start, reach)
            reach = start + window
    return total


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of each row of counts ``p`` to the counts ``q``.

    Rows without a count have distance 0.
    """
    totals = p.sum(axis=1, keepdims=True)
    p, q = p / np.maximum(totals, 1), q / max(q.sum(), 1)
    middle = (p + q) / 2

    def entropy(x):
        return -np.sum(x * np.log2(np.where(x > 0, x, 1)), axis=-1)

    found = np.sqrt(np.clip(entropy(middle) - (entropy(p) + entropy(q)) / 2, 0, 1))
    return np.where(totals[:, 0] > 0, found, 0)


def class_counts(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Characters of each class, a row per text."""
    size, wide = np.array([len(t) for t in texts]), len(CLASSES) + 1
    codes = np.repeat(np.arange(len(texts)), size) * wide + table[np.frombuffer(b"".join(texts), np.uint8)]
    return np.bincount(codes, minlength=len(texts) * wide).reshape(len(texts), wide)[:, :-1]


def _gathered(docs: DataFrame, count, schema: str, limit: int = GATHERED) -> DataFrame:
    """``mapInArrow`` that adds up ``count(lang, text) -> words`` into counters per language, let go every ``limit`` words."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def batches_of(state):
        rows = count.rows(state)
        return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in target], schema=target)

    def run(batches):
        state, held = defaultdict(Counter), 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), byte_column(batch, "text")):
                held += count.add(state, lang, text)
                if held > limit:
                    yield batches_of(state)
                    state, held = defaultdict(Counter), 0
        yield batches_of(state)

    return docs.mapInArrow(run, schema)


class _Candidates:
    """Words that may be common, and classes: a word common overall is common in some part, too."""

    def __init__(self, share: float):
        self.share, self.table = share, class_table()

    def add(self, state, lang, text):
        words = text.split()
        state[lang].update(filter(_has_letter, map(plain_word, words)))
        state[lang, "classes"] += Counter(dict(enumerate(class_counts([text], self.table)[0].tolist())))
        state[lang, "words"][0] += len(words)
        return len(words) + 1

    def rows(self, state):
        out = {"lang": [], "word": [], "class": [], "n": []}
        for key, counts in state.items():
            if isinstance(key, tuple):
                if key[1] == "classes":
                    for k, n in counts.items():
                        for name, value in zip(out, (key[0], None, k, n)):
                            out[name].append(value)
                continue
            least = self.share / 2 * state[key, "words"][0]
            for word, n in counts.items():
                if n >= least:
                    for name, value in zip(out, (key, word.decode(), None, n)):
                        out[name].append(value)
        return out


class _Exact:
    """Exact counts of the candidate words of each language, and of its words without a letter (as the empty word)."""

    def __init__(self, candidates: dict[str, set[bytes]]):
        self.candidates = candidates

    def add(self, state, lang, text):
        mine = self.candidates[lang]
        state[lang].update(w if w in mine else b"" for w in map(plain_word, text.split()) if w in mine or not _has_letter(w))
        return 1

    def rows(self, state):
        rows = [(lang, word.decode(), n) for lang, counts in state.items() for word, n in counts.items()]
        return {name: [r[k] for r in rows] for k, name in enumerate(("lang", "word", "n"))}


def language_references(docs: DataFrame, word_share: float = WORD_SHARE, lang_share: float = LANG_SHARE) -> dict[str, tuple]:
    """{lang: (class counts, {common word: count}, words)} over all documents, for languages with ``lang_share`` of all words.

    The empty word stands for all words without a letter.
    Documents with null lang or text do not count. Candidates for common words are those with half of ``word_share`` in some part
    of the documents (a word with the whole share is never missed), then they are counted in all documents. What comes to
    the driver is bounded by the shares: a language has at most 2 / ``word_share`` candidates.
    """
    own = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    sizes = materialize(own.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("bigint").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    words = {r["lang"]: r["n"] for r in sizes.filter((F.col("n") >= lang_share * total) & (F.col("n") > 0)).collect()}
    if not words:
        return {}
    spark = docs.sparkSession
    listed = spark.createDataFrame(list(words.items()), "lang string, total bigint")
    mine = own.join(F.broadcast(listed.select("lang")), "lang", "left_semi")
    found = materialize(_gathered(mine, _Candidates(word_share), "lang string, word string, class int, n bigint").groupBy(
        "lang", "word", "class").agg(F.sum("n").alias("n")))
    likely = found.filter("word is not null").join(F.broadcast(listed), "lang").filter(F.col("n") >= word_share / 2 * F.col("total"))
    candidates = defaultdict(set)
    for r in likely.select("lang", "word").collect():
        candidates[r["lang"]].add(r["word"].encode())
    classes = {lang: np.zeros(len(CLASSES), np.int64) for lang in words}
    for r in found.filter("class is not null").collect():
        classes[r["lang"]][r["class"]] = r["n"]
    exact = _gathered(mine, _Exact({lang: candidates[lang] for lang in words}), "lang string, word string, n bigint", limit=1 << 16)
    common = {lang: {} for lang in words}
    for r in exact.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        if not r["word"] or r["n"] >= word_share * words[r["lang"]]:
            common[r["lang"]][r["word"].encode()] = r["n"]
    return {lang: (classes[lang], common[lang], words[lang]) for lang in sorted(words)}


class Rules:
    """Base rules and distances of a batch of texts."""

    def __init__(self, references: dict[str, tuple]):
        self.table, self.langs, self.words, self.columns = class_table(), list(references), {}, []
        self.classes = [references[lang][0].astype(float) for lang in self.langs]
        for lang in self.langs:
            _, common, total = references[lang]
            place = [self.words.setdefault(w, len(self.words)) for w in common]
            counts = np.array([*common.values(), total - sum(common.values())], float)
            self.columns.append((np.array(place, np.int64), counts))

    def score(self, texts: list[bytes]) -> dict[str, list]:
        split = [t.split() for t in texts]
        n_words = np.array([len(w) for w in split], np.int64)
        classes = class_counts(texts, self.table)
        bytes_of = np.bincount(
            np.repeat(np.arange(len(texts)), [len(t) for t in texts])[
                np.isin(np.frombuffer(b"".join(texts), np.uint8), np.frombuffer(_SYMBOLS, np.uint8))], minlength=len(texts))
        counts = np.zeros((len(texts), len(self.words)), np.int64)
        for k, words in enumerate(split):
            found = [i for i in map(self.words.get, (w if _has_letter(w) else b"" for w in map(plain_word, words))) if i is not None]
            counts[k] = np.bincount(found, minlength=len(self.words)) if found else 0
        class_far, word_far = np.zeros((2, len(texts), len(self.langs)))
        for k, (place, reference) in enumerate(self.columns):
            own = counts[:, place]
            class_far[:, k] = js_distance(classes.astype(float), self.classes[k])
            word_far[:, k] = js_distance(np.column_stack([own, n_words - own.sum(axis=1)]).astype(float), reference)
        chars = classes.sum(axis=1)
        return {
            "n_words": n_words, "word_chars": chars - classes[:, CLASSES.index("space")], "n_symbols": bytes_of,
            "n_dup_lines": [dup_lines(t) for t in texts], "n_repeat_words": [repeat_words(w) for w in split],
            "chars": chars, "class_far": class_far, "word_far": word_far,
        }


def quality_rules(docs: DataFrame, references: dict[str, tuple], class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, nearest, class_distance, word_distance
    and kept (made fresh on a clash).

    ``nearest`` is the reference with the least sum of both distances, whatever the lang of the row; distances are those to it. A document is kept if it
    passes the base rules and both distances stay within their limits. Guards: a distance counts only from
    ``CLASS_LEAST`` characters or ``WORD_LEAST`` words on (short texts differ from any reference by chance); a document in a language that has no reference is not judged
    by distance, and none is where there are no references. Null texts have no words, like empty ones, and fail the base rules. ``references`` come from :func:`language_references`,
    whose size is bounded, and go to all tasks.
    """
    names = {n: fresh(docs, n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                                         "nearest", "class_distance", "word_distance", "kept")}
    columns = list(docs.columns)
    kinds = dict(zip(("base_failed", "nearest", "class_distance", "word_distance", "kept"), ("boolean", "string", "double", "double", "boolean")))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema],
                        *[f"`{n}` {kinds.get(k, 'bigint')}" for k, n in names.items()]])
    rules = Rules(references)
    known = set(references)
    lang_column = "lang" if "lang" in columns else None

    def run(batch):
        got = rules.score([t or b"" for t in byte_column(batch, "text")])
        class_far, word_far = got.pop("class_far"), got.pop("word_far")
        chars, rows = got.pop("chars"), np.arange(batch.num_rows)
        repeat = np.array(got["n_repeat_words"])
        failed = (got["n_words"] < LEAST_WORDS) | (100 * repeat > REPEAT_PERCENT * got["n_words"])
        out = {k: list(map(int, v)) for k, v in got.items()} | {"base_failed": failed.tolist()}
        if rules.langs:
            nearest = np.argmin(class_far + word_far, axis=1)
            far_class, far_word = class_far[rows, nearest], word_far[rows, nearest]
            judged = np.ones(batch.num_rows, bool)
            if lang_column:
                judged = np.array([lang is None or str(lang) in known for lang in batch.column(lang_column).to_pylist()], bool)
            strange = ((far_class > class_limit) & (chars >= CLASS_LEAST)) | ((far_word > word_limit) & (got["n_words"] >= WORD_LEAST))
            out |= {"nearest": [rules.langs[k] for k in nearest], "class_distance": far_class.tolist(),
                    "word_distance": far_word.tolist(), "kept": (~failed & ~(strange & judged)).tolist()}
        else:
            none = [None] * batch.num_rows
            out |= {"nearest": none, "class_distance": none, "word_distance": none, "kept": (~failed).tolist()}
        return {c: batch.column(c) for c in columns} | {names[k]: v for k, v in out.items()}

    return map_batches(docs, run, schema)
