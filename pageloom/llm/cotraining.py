"""Quality classifier by co-training: a view of the text and a view of the page's metadata teach each other."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import byte_column, hash_order, map_batches, materialize, remainder
from pageloom.llm.toxicity import fit_logistic

TEXT_VIEW, META_VIEW = 18, 40
#: Labelled and unlabelled rows that the two classifiers are fitted on, about.
LABELLED_ROWS, POOL_ROWS = 12_000, 12_000
ROUNDS, SHARE = 4, 0.1
_MARKS = [re.compile(p) for p in (rb"[&%$#*]{3}", rb"!!", rb"\|", rb"https?://", rb"[0-9]", rb"[A-Z]", rb"[.!?]", rb"\n")]


def text_view(text: bytes | None) -> list[float]:
    """Numbers about the words and lines of a whole text; all zero for null or blank text."""
    words = (text or b"").split()
    if not words:
        return [0.0] * TEXT_VIEW
    n, size = len(words), len(text)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), float, n)
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(n), lengths.mean(), lengths.std(), len(counts) / n, counts.most_common(1)[0][1] / n, same / n,
        len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(n / len(lines)), sum(c for c in counts.values() if c > 2) / n,
        *[np.log1p(1000 * len(m.findall(text)) / size) for m in _MARKS],
    ]


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Numbers about a page's metadata, never its text: language and source as hashed places, and its stated size."""
    out = [0.0] * META_VIEW
    out[0] = np.log1p(max(0, n_chars or 0))
    out[1] = float((n_chars or 0) < 200)
    out[2 + zlib.crc32((lang or "?").encode()) % 8] = 1.0
    out[10 + zlib.crc32((source or "?").encode()) % (META_VIEW - 10)] = 1.0
    return out


def views(docs: DataFrame) -> DataFrame:
    """(doc_id, text_view, meta_view) per row; columns that are missing count as null."""
    have = [F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t).alias(c)
            for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))]

    def run(batch):
        meta = zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
        return {"doc_id": batch.column("doc_id"), "text_view": [text_view(t) for t in byte_column(batch, "text")],
                "meta_view": [meta_view(*m) for m in meta]}

    return map_batches(docs.select(*have), run, "doc_id bigint, text_view array<double>, meta_view array<double>")


@dataclass
class View:
    """Logistic classifier on standardised numbers with a calibration of its logits."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    calibration: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + (x - self.center) / self.scale @ self.weights[1:]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.calibration[0] + self.calibration[1] * self.logits(x), -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray) -> View:
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return View(center, scale, fit_logistic((x - center) / scale, y), np.array([0.0, 1.0]))


@dataclass
class Model:
    """Two calibrated views and the weights that combine them."""

    text: View
    meta: View
    mix: np.ndarray

    def combine(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.probability(text), self.meta.probability(meta)
        z = self.mix[0] + self.mix[1] * _logit(a) + self.mix[2] * _logit(b)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), a, b


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray,
             rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """Rounds in which each view labels the pool rows it is surest of, for the other to learn from.

    A quarter of the labelled rows is kept out of the fits to calibrate the views and weigh them. In each round a view hands
    over ``share`` / ``rounds`` of the pool, in the proportion of the labels, and only rows that it puts at 0.5 or above on
    their side.
    """
    order = np.random.default_rng(17).permutation(len(y))
    kept, used = order[: len(y) // 4], order[len(y) // 4:]
    base = y[used].mean()
    given = {"text": {}, "meta": {}}
    data = {"text": (text, pool_text), "meta": (meta, pool_meta)}

    def fit(view: str) -> View:
        x, pool = data[view]
        extra = sorted(given[view].items())
        rows = [i for i, _ in extra]
        return _fit(np.vstack([x[used], pool[rows]]) if rows else x[used],
                    np.concatenate([y[used], [label for _, label in extra]]) if rows else y[used])

    for _ in range(rounds):
        for view, other in (("text", "meta"), ("meta", "text")):
            p = fit(view).probability(data[view][1]) if len(pool_text) else np.zeros(0)
            each = share / rounds * len(p)
            for label, count, sure in ((1.0, each * base, p), (0.0, each * (1 - base), 1 - p)):
                fresh = [i for i in np.argsort(-sure, kind="stable") if sure[i] >= 0.5 and i not in given[other]]
                given[other].update((int(i), label) for i in fresh[: round(count)])
    found = {}
    for view in data:
        found[view] = fit(view)
        z = found[view].logits(data[view][0][kept])
        found[view].calibration = fit_logistic(z[:, None], y[kept], penalty=0.1)
    both = np.column_stack([_logit(found[v].probability(data[v][0][kept])) for v in ("text", "meta")])
    return Model(found["text"], found["meta"], fit_logistic(both, y[kept], penalty=0.1))


def learn_quality(features: DataFrame, labels: DataFrame, train: tuple[int, int, bool] = (5, 0, False)) -> Model | None:
    """Model from about ``LABELLED_ROWS`` labelled and ``POOL_ROWS`` unlabelled training rows of ``views``, or all if fewer.

    Both are chosen by a hash of the id; the held-out part of ``train`` is in neither. None unless both labels occur.
    """
    modulus, value, inside = train
    part = remainder(F.col("doc_id"), modulus)
    usable = features.filter("doc_id IS NOT NULL").filter(part == value if inside else part != value)
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    share = F.conv(F.substring(hash_order(F.col("doc_id"), "quality"), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))

    def sample(ids: DataFrame, rows: int):
        """About ``rows`` rows: only those whose hash lies below the share that is wanted leave their tasks."""
        wanted = min(1.0, rows / max(1, ids.count()))
        chosen = ids.filter(share < wanted)
        return usable.join(chosen, "doc_id").toPandas().sort_values("doc_id", kind="stable")

    ids = usable.select("doc_id")
    lab = sample(known.join(ids.distinct(), "doc_id", "left_semi"), LABELLED_ROWS)
    pool = sample(ids.join(known, "doc_id", "left_anti").distinct(), POOL_ROWS)
    if lab.empty or lab["y"].nunique() < 2:
        return None
    stack = lambda frame, name, width: np.array(frame[name].tolist(), float).reshape(len(frame), width)
    return co_train(stack(lab, "text_view", TEXT_VIEW), stack(lab, "meta_view", META_VIEW), lab["y"].to_numpy(float),
                    stack(pool, "text_view", TEXT_VIEW), stack(pool, "meta_view", META_VIEW))


def quality(docs: DataFrame, labels: DataFrame, train: tuple[int, int, bool] = (5, 0, False)) -> DataFrame:
    """(doc_id, score, predicted, text_score, meta_score) per row; scores are probabilities of good quality.

    Every whole text is read once; the views, short rows of numbers, are written out and scored. Null and blank texts
    have a text view of zeros, null metadata a place of its own. Without both labels every score is 0.5. Repeated rows
    score alike.
    """
    features = materialize(views(docs))
    model = learn_quality(features, labels, train)

    def run(batch):
        n = batch.num_rows
        text = np.array(batch.column("text_view").to_pylist(), float).reshape(n, TEXT_VIEW)
        meta = np.array(batch.column("meta_view").to_pylist(), float).reshape(n, META_VIEW)
        p, a, b = model.combine(text, meta) if model else (np.full(n, 0.5),) * 3
        return {"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= 0.5).astype(np.int32), "text_score": a, "meta_score": b}

    return map_batches(features, run, "doc_id bigint, score double, predicted int, text_score double, meta_score double")
