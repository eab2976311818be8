"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import byte_column, hash_order, map_batches, remainder

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 8
#: Training documents of a language (about), languages, and windows of a document, at most.
PER_LANG, LANGS, PER_DOC = 400, 200, 3
#: Windows put through the network at once; bounds the memory of a long text.
BLOCK = 512
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SPACE_RUN = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


@dataclass
class Network:
    """Filters as tables by byte (width, 256, filters), their biases, and the output layer."""

    langs: list[str]
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def text_windows(text: bytes) -> np.ndarray:
    """Windows of ``WINDOW`` bytes that cover the whole text, the last one padded with spaces.

    ASCII letters are put in lower case; a run of ASCII that is no letter becomes one space.
    """
    data = np.frombuffer(_SPACE_RUN.sub(b" ", text).lower() or b" ", np.uint8)
    rows = -(-len(data) // WINDOW)
    padded = np.full(rows * WINDOW, 32, np.uint8)
    padded[: len(data)] = data
    return padded.reshape(rows, WINDOW)


def _pair_tables(net: Network) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """Filters as sums of tables by byte pair, so that a filter of width 4 takes two look-ups a byte."""
    tables = []
    for f in net.filters:
        own = []
        for k in range(0, len(f), 2):
            if k + 1 < len(f):
                own.append((f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1))
            else:
                own.append(np.repeat(f[k], 256, axis=0))
        tables.append(own)
    return tables


def probabilities(windows: np.ndarray, net: Network, tables=None) -> np.ndarray:
    """Softmax of every window: the maximum of each filter over its places, then the output layer."""
    tables = tables or _pair_tables(net)
    pairs = np.empty(windows.shape, np.uint16)
    pairs[:, :-1] = (windows[:, :-1].astype(np.uint16) << 8) | windows[:, 1:]
    pairs[:, -1] = (windows[:, -1].astype(np.uint16) << 8) | 32
    pooled = []
    for own, bias, width in zip(tables, net.bias, WIDTHS):
        places = windows.shape[1] - width + 1
        total = own[0][pairs[:, :places]]
        for k, table in enumerate(own[1:], 1):
            total += table[pairs[:, 2 * k: 2 * k + places]]
        pooled.append(np.maximum(total.max(axis=1) + bias, 0))
    z = np.hstack(pooled) @ net.out + net.out_bias
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def train_network(windows: np.ndarray, targets: np.ndarray, langs: list[str], epochs: int = 6, seed: int = 7,
                  rate: float = 0.01, batch: int = 128) -> Network:
    """Filters and output layer by Adam on the windows; the gradient passes through the winning place only."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    params += [rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n, step = len(WIDTHS), 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            x, y = windows[order[at: at + batch]], targets[order[at: at + batch]]
            rows, pooled, best = np.arange(len(x)), [], []
            for w, width in enumerate(WIDTHS):
                places = x.shape[1] - width + 1
                total = sum(params[w][k][x[:, k: k + places]] for k in range(width))
                top = total.argmax(axis=1)
                best.append(top)
                pooled.append(np.take_along_axis(total, top[:, None, :], 1)[:, 0] + params[n + w])
            raw = np.hstack(pooled)
            hidden = np.maximum(raw, 0)
            z = hidden @ params[-2] + params[-1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[rows, y] -= 1
            p /= len(x)
            back = (p @ params[-2].T) * (raw > 0)
            grads = []
            for w, width in enumerate(WIDTHS):
                g = np.zeros_like(params[w])
                own = back[:, w * FILTERS: (w + 1) * FILTERS]
                for k in range(width):
                    np.add.at(g[k], (x[rows[:, None], best[w] + k], np.arange(FILTERS)[None]), own)
                grads.append(g)
            grads += [back[:, w * FILTERS: (w + 1) * FILTERS].sum(axis=0) for w in range(n)]
            grads += [hidden.T @ p + 1e-4 * params[-2], p.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                params[i] -= rate * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.999 ** step)) + 1e-8)
    return Network(langs, params[:n], params[n: 2 * n], params[-2], params[-1])


def learn_languages(docs: DataFrame, train: tuple[int, int, bool] = (5, 0, False), per_lang: int = PER_LANG) -> Network | None:
    """Network from about ``per_lang`` documents of each language and up to ``PER_DOC`` windows of each.

    Only text and non-null lang of rows in the training part are read; null texts and texts without a
    letter teach nothing. Documents are chosen by a hash of their id, at a rate from the counts per language;
    at most ``LANGS`` languages (the most frequent) are learned. None if nothing can be learned.
    """
    modulus, value, inside = train
    part = remainder(F.col("doc_id"), modulus)
    usable = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").filter(
        part == value if inside else part != value)
    counts = usable.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGS).collect()
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    share = F.conv(F.substring(hash_order(F.col("doc_id"), "lang"), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rates = F.broadcast(docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, per_lang / r["count"])) for r in counts], "lang string, rate double"))

    def run(batch):
        found, lang = [], []
        for text, name in zip(byte_column(batch, "text"), batch.column("lang").to_pylist()):
            if _LETTER.search(text.decode()):
                rows = text_windows(text)
                for i in sorted({int(j * (len(rows) - 1) / max(1, PER_DOC - 1)) for j in range(PER_DOC)}):
                    found.append(rows[i].tobytes())
                    lang.append(name)
        return {"w": found, "lang": lang}

    chosen = usable.join(rates, "lang").filter(share < F.col("rate")).select("text", "lang")
    got = map_batches(chosen, run, "w binary, lang string").toPandas().sort_values(["lang", "w"])
    if got.empty:
        return None
    langs = sorted(got["lang"].unique())
    windows = np.frombuffer(b"".join(got["w"]), np.uint8).reshape(-1, WINDOW)
    return train_network(windows, np.searchsorted(langs, got["lang"].to_numpy()).astype(int), langs)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row, from all windows of the whole text.

    The windows' log-probabilities are averaged, weighted by their bytes that are not padding; ``score`` is
    the share of the language in that average. ``und`` with score 0 if the text is null or has no letter, or
    if there is no network. Ties go to the language that sorts first.
    """
    tables = None

    def run(batch):
        nonlocal tables
        if net is not None and tables is None:
            tables = _pair_tables(net)
        langs, scores = [], []
        rows = [None if t is None or net is None or not _LETTER.search(t.decode()) else text_windows(t)
                for t in byte_column(batch, "text")]
        sums = _log_sums(rows, net, tables)
        for total in sums:
            if total is None:
                langs.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(total.argmax())
                langs.append(net.langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores}

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, lang_pred string, score double")


def _log_sums(rows: list[np.ndarray | None], net: Network | None, tables) -> list[np.ndarray | None]:
    """Mean log-probabilities per text; the windows of all texts go through the network in blocks."""
    full = [r for r in rows if r is not None]
    if not full:
        return [None] * len(rows)
    windows = np.concatenate(full)
    logs = np.empty((len(windows), len(net.langs)))
    for at in range(0, len(windows), BLOCK):
        logs[at: at + BLOCK] = np.log(probabilities(windows[at: at + BLOCK], net, tables) + 1e-9)
    weight = (windows != 32).sum(axis=1) + 1e-3
    lengths = np.array([len(r) for r in full])
    starts = np.cumsum(lengths) - lengths
    total = np.add.reduceat(logs * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
    found = iter(total)
    return [None if r is None else next(found) for r in rows]
