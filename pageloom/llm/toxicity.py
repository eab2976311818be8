"""Toxicity: weighted finite-state transducers over the words of a clause, weights learned from labels."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import byte_column, hash_order, map_batches, remainder

# Fixed word lists of the grammar (English, German, French, Spanish).
TARGETS = "you your yours yourself u ur he she they them him her du dich dir dein deine ihr euch toi tu te ton ta vous vos tú usted ustedes".split()
NEGATIONS = "not no never don't doesn't isn't aren't wasn't nor nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says claimed claims wrote reported quoted called alleged sagte behauptete schrieb dit écrit dijo escribió".split()
THREATS = "kill hurt destroy burn shoot stab beat punish töten umbringen verletzen tuer frapper brûler matar golpear quemar".split()
INSULTS = "idiot moron loser scum trash stupid worthless pathetic disgusting clown".split()

END, OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(7)
#: Words that a negation or a target reaches.
REACH = 4
#: Labelled rows that the weights are learned from, at most.
SAMPLE_ROWS = 20_000
#: Stems learned, at most, and the rows of candidates looked at for them.
STEMS, STEM_ROWS = 400, 20_000
MEMO = 200_000
THRESHOLD = 0.7

# Clause ends become the byte 1; other ASCII punctuation but the apostrophe separates words.
_TABLE = bytes(
    1 if chr(i) in ".!?;:\n" else i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or 48 <= i <= 57 or i == 39 or i > 127 else 32
    for i in range(256)
)


def clause_words(text: bytes | None) -> list[bytes]:
    """Words in lower case, with the word of byte 1 where a clause ends."""
    return (text or b"").translate(_TABLE).replace(b"\x01", b" \x01 ").split()


@dataclass
class Grammar:
    """Stems (a word's beginning) with (kind, weight, chance of a hit per word), and the scoring weights."""

    stems: dict[bytes, tuple[int, float, float]]
    weights: list[float] = field(default_factory=list)
    center: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)


def seed_grammar() -> Grammar:
    """Grammar that serves without labels."""
    stems = {w.encode(): (INSULT, 5.0, 1e-5) for w in INSULTS} | {w.encode(): (THREAT, 4.0, 1e-5) for w in THREATS}
    weights = [0.0] * len(FEATURES)
    for name, weight in (("weight", 0.45), ("surprise", 0.3), ("negated", -0.8), ("reported", -0.8), ("targeted", 0.8)):
        weights[FEATURES.index(name)] = weight
    return Grammar(stems, [-3.5, *weights], [0.0] * len(FEATURES), [1.0] * len(FEATURES))


class Lexical(dict):
    """First transducer: a word to its symbol; remembers words, within a bound."""

    def __init__(self, grammar: Grammar):
        super().__init__()
        self.stems = grammar.stems
        self.lengths = sorted({len(s) for s in grammar.stems}, reverse=True)
        self.fixed = {w.encode(): k for k, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.fixed[b"\x01"] = END

    def __missing__(self, word: bytes):
        found = self.fixed.get(word, OTHER), b""
        for n in self.lengths:
            stem = word[:n]
            if len(stem) == n and stem in self.stems:
                found = self.stems[stem][0], stem
                break
        if len(self) >= MEMO:
            self.clear()
        self[word] = found
        return found


# The other transducers are tables: (state, symbol) -> state. Negation and target count the words they
# still reach; reported speech holds until the clause ends.
NEGATING = {(s, k): 0 if k == END else REACH if k == NEGATION else max(0, s - 1) for s in range(REACH + 1) for k in range(7)}
AIMING = {(s, k): 0 if k == END else REACH if k == TARGET else max(0, s - 1) for s in range(REACH + 1) for k in range(7)}
REPORTING = {(s, k): 0 if k == END else 1 if k == REPORT else s for s in range(2) for k in range(7)}


def matches(symbols: list[tuple[int, bytes]]) -> list[tuple[int, bytes, bool, bool, bool]]:
    """Composed transducers: (kind, stem, negated, reported, targeted) per matched word of the clauses."""
    found, open_at = [], 0
    negating = aiming = reporting = 0
    for kind, stem in symbols:
        if kind in (INSULT, THREAT):
            found.append([kind, stem, negating > 0, reporting > 0, aiming > 0])
        elif kind == TARGET:  # a target after the word counts as well
            for f in found[max(open_at, len(found) - 1):]:
                f[4] = True
        negating, aiming, reporting = NEGATING[negating, kind], AIMING[aiming, kind], REPORTING[reporting, kind]
        if kind == END:
            open_at = len(found)
    return [tuple(f) for f in found]


FEATURES = ("hits", "weight", "surprise", "plain", "negated", "reported", "targeted", "threats", "stems", "rate", "words",
            "one", "two", "three")


def features(words: list[bytes], lexical: Lexical, grammar: Grammar) -> list[float]:
    """What the matched clauses of a document add up to; all zero without a match."""
    symbols = [lexical[w] for w in words]
    found = matches(symbols) if any(k in (INSULT, THREAT) for k, _ in symbols) else []
    if not found:
        return [0.0] * len(FEATURES)
    n = len(words)
    per_stem = Counter(f[1] for f in found)
    weight = sum(grammar.stems[s][1] for s in per_stem)
    surprise = 0.0
    for stem, hits in per_stem.items():  # Poisson deviance of the hits from those by chance
        chance = grammar.stems[stem][2] * n + 0.02
        surprise += max(0.0, hits * np.log(hits / chance) - (hits - chance)) if hits > chance else 0.0
    plain = sum(not (f[2] or f[3]) for f in found)
    total = len(found)
    return [
        np.log1p(total), min(weight, 60.0), min(surprise, 60.0), np.log1p(plain), np.log1p(sum(f[2] for f in found)),
        np.log1p(sum(f[3] for f in found)), np.log1p(sum(f[4] for f in found)), np.log1p(sum(f[0] == THREAT for f in found)),
        np.log1p(len(per_stem)), np.log(total / (n + 20.0)), np.log1p(n), 1.0, float(total > 1), float(total > 2),
    ]


def score(values: np.ndarray, grammar: Grammar) -> np.ndarray:
    """Probability of the label 1."""
    x = (values - np.array(grammar.center)) / np.array(grammar.scale)
    return 1 / (1 + np.exp(-(grammar.weights[0] + x @ np.array(grammar.weights[1:]))))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 60) -> np.ndarray:
    """Ridge-penalised logistic regression by damped Newton steps; the first weight is the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], penalty)
    shrink[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + shrink * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: tuple[int, int, bool],
                    rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled training documents, chosen by a hash of the id.

    ``train`` is (modulus, remainder, whether the remainder is the training part). Repeated labels of a
    document count once, by their largest value; other labels than 0 and 1, and nulls, count for nothing.
    """
    modulus, value, inside = train
    part = remainder(F.col("doc_id"), modulus)
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(
        part == value if inside else part != value)
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(
        hash_order(F.col("doc_id"), "labelled"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _prefix_counts(sample: DataFrame) -> DataFrame:
    """(prefix, toxic, clean, hits) with the documents of each kind that hold a word's prefix."""
    def run(batch):
        toxic, clean, hits = Counter(), Counter(), Counter()
        for text, y in zip(byte_column(batch, "text"), batch.column("y").to_pylist()):
            words = Counter(clause_words(text))
            seen = Counter()
            for w, n in words.items():
                for k in range(3, min(len(w), 12) + 1):
                    if k == len(w) or w[k] & 0xC0 != 0x80:  # whole characters only
                        seen[w[:k]] += n
            (toxic if y else clean).update(seen.keys())
            if not y:
                hits.update(seen)
                hits[b""] += sum(words.values())
            (toxic if y else clean)[b""] += 1
        names = list(set(toxic) | set(clean))
        return {"prefix": names, "toxic": [toxic[p] for p in names], "clean": [clean[p] for p in names],
                "hits": [hits[p] for p in names]}

    return map_batches(sample.select("text", "y"), run, "prefix binary, toxic bigint, clean bigint, hits bigint").groupBy(
        "prefix").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "hits")])


def learn_stems(counts: DataFrame, least: int = 6, odds: float = 2.0) -> dict[bytes, tuple[int, float, float]]:
    """Shortest beginnings of words that mark toxic documents, up to ``STEMS``, with weight and chance."""
    total = counts.filter(F.length("prefix") == 0).first()
    if total is None or not total["toxic"] or not total["clean"]:
        return {}
    logodds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1.0))
    rows = counts.filter((F.length("prefix") > 0) & (F.col("toxic") >= least)).withColumn("odds", logodds).filter(
        F.col("odds") >= odds).orderBy(F.col("odds").desc(), "prefix").limit(STEM_ROWS).collect()
    found = {bytes(r["prefix"]): r for r in rows}
    stems: dict[bytes, tuple[int, float, float]] = {}
    for prefix in sorted(found, key=lambda p: (len(p), p)):
        r = found[prefix]
        above = next((prefix[:n] for n in range(len(prefix) - 1, 2, -1) if prefix[:n] in stems), None)
        # A longer stem is added beside a shorter one only if it is much surer.
        if above is not None and r["odds"] < stems[above][1] + 1.0:
            continue
        stems[prefix] = (INSULT, float(r["odds"]), float(r["hits"] + 0.5) / float(total["hits"] + 1))
    best = sorted(stems, key=lambda s: -found[s]["toxic"] * stems[s][1])[:STEMS]
    return {s: stems[s] for s in best}


def learn_grammar(docs: DataFrame, labels: DataFrame, train: tuple[int, int, bool] = (3, 1, False),
                  rows: int = SAMPLE_ROWS) -> Grammar:
    """Grammar with stems and weights from at most ``rows`` labelled training rows.

    The counts run on Spark; what reaches the driver is at most ``STEM_ROWS`` stems and one short row of
    features per sampled row. Without both labels among them, the seed grammar is returned.
    """
    sample = labelled_sample(docs, labels, "toxic", train, rows)
    grammar = seed_grammar()
    learned = learn_stems(_prefix_counts(sample))
    if not learned:
        return grammar
    grammar.stems = {**{k: v for k, v in grammar.stems.items() if not any(k.startswith(s) for s in learned)}, **learned}
    lexical = Lexical(grammar)

    def run(batch):
        rows = [features(clause_words(t), lexical, grammar) for t in byte_column(batch, "text")]
        return {"x": rows, "y": batch.column("y")}

    got = map_batches(sample.select("text", "y"), run, "x array<double>, y int").toPandas()
    y = got["y"].to_numpy(float)
    x = np.array(got["x"].tolist(), float).reshape(len(y), len(FEATURES))
    grammar.center = x.mean(axis=0).tolist()
    grammar.scale = (x.std(axis=0) + 1e-6).tolist()
    grammar.weights = fit_logistic((x - grammar.center) / grammar.scale, y).tolist()
    return grammar


def toxicity(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, hits) per row.

    ``score`` is the probability of a toxic text by its matched clauses, whole text read; null, empty and
    unmatched texts get that of texts without a match. Equal texts score alike.
    """
    lexical = Lexical(grammar)

    def run(batch):
        rows = np.array([features(clause_words(t), lexical, grammar) for t in byte_column(batch, "text")]).reshape(-1, len(FEATURES))
        p = score(rows, grammar)
        return {"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= threshold).astype(np.int32),
                "hits": np.rint(np.expm1(rows[:, 0])).astype(np.int64)}

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run,
                       "doc_id bigint, score double, predicted int, hits bigint")


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; null and empty texts stay.

    Decided within the scan, without a shuffle; every column is kept as it is.
    """
    lexical = Lexical(grammar)

    def run(batches):
        for batch in batches:
            rows = np.array([features(clause_words(t), lexical, grammar) for t in byte_column(batch, "text")])
            keep = score(rows.reshape(-1, len(FEATURES)), grammar) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

