"""Language-model scoring: a gated recurrent network with class-factored output, trained in numpy on shards."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import map_batches, materialize, remainder

#: Words whose counts go to every task, at most; words with outputs of their own; words in a class.
KNOWN, OWN, CLASS = 150_000, 1024, 32
#: Classes of all other words, by their ending; endings looked at, and frequent words that describe them.
GROUPS, ENDINGS, AROUND = 12, 20_000, 64
HIDDEN = 16
#: Tokens of a shard, about; shards are dealt over the rounds, so that every text is learned from once.
SHARD, ROUNDS = 1_200_000, 3
#: Steps of a truncated backpropagation, and of a scoring window; texts side by side in each (training: least and most).
TRAIN_STEPS, TRAIN_LANES, STEPS, LANES = 20, (32, 384), 48, 384
END = b""
#: Distinct words counted in a task before the counts are passed on.
COUNTED = 400_000
#: Bytes of texts whose words are told apart at once (one text at least).
SPLIT_BYTES = 1 << 23


def tokens(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z only), split at ASCII white space, then the end."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


class Words(NamedTuple):
    """The :func:`tokens` of several texts: their distinct words, each token's place among these, and each text's tokens."""

    distinct: pa.Array
    tokens: np.ndarray
    sizes: np.ndarray

    @property
    def texts(self) -> np.ndarray:
        """The text of each token, by its place."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def split_texts(texts: pa.Array):
    """:class:`Words` of about ``SPLIT_BYTES`` of texts at a time, in order; words are cut and told apart by Arrow."""
    step = max(1, len(texts) * SPLIT_BYTES // max(1, texts.nbytes))
    for start in range(0, len(texts), step):
        lower = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(start, step), pa.scalar("", texts.type))))
        # White space after the last word leaves an empty one there, the end; an empty text is one already.
        nothing, blank = pa.scalar("", lower.type), pa.scalar(" ", lower.type)
        lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(lower, nothing), nothing, pc.binary_join_element_wise(lower, blank, nothing)))
        words = lists.flatten().dictionary_encode()
        yield Words(words.dictionary.cast(pa.large_binary()), words.indices.to_numpy(), pc.list_value_length(lists).to_numpy())


def _words(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.large_binary())


def _find(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Place of each word in ``among``, -1 where it is not there."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy().astype(np.int64)


@dataclass
class Vocabulary:
    """Counts of frequent words, the first of which have outputs of their own; totals of the corpus.

    A word beyond the first ``own`` belongs to the group that its ending has; ``group_mass`` and ``group_new``
    are a group's tokens and the share of new words among them (by the words seen once).
    """

    index: dict[bytes, int]
    counts: np.ndarray
    own: int
    endings: dict[bytes, int]
    total: int
    distinct: int
    group_mass: np.ndarray
    group_new: np.ndarray
    #: Input number of every word with a count, and one more.
    inputs: np.ndarray | None = None

    def __post_init__(self):
        if self.inputs is None:
            groups = self.own + self.groups(_words(list(self.index)[self.own:]))
            self.inputs = np.concatenate([np.arange(self.own), groups, [0]]).astype(np.int32)

    def plain(self) -> tuple:
        """Dictionaries, arrays and numbers alone, to be broadcast: tasks need no copy of this class."""
        return tuple(getattr(self, f) for f in self.__dataclass_fields__)

    @property
    def classes(self) -> int:
        return -(-self.own // CLASS) + GROUPS

    @cached_property
    def known(self) -> pa.Array:
        return _words(list(self.index))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Index of each word's count, -1 where it has none."""
        return _find(words, self.known)

    def groups(self, words: pa.Array) -> np.ndarray:
        """Group of each word, by its last three bytes if these are among the endings, else its last one."""
        endings, group = _words(list(self.endings)), np.array([*self.endings.values(), 0], np.int32)
        three, one = (_find(pc.binary_slice(words, k), endings) for k in (-3, -1))
        return group[np.where(three < 0, one, three)]  # the entry of -1 is the last


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; summed within each task, as far as ``COUNTED`` words, before the shuffle."""
    def run(batches):
        counts: dict[bytes, int] = {}

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for part in split_texts(batch.column("text")):
                times = np.bincount(part.tokens, minlength=len(part.distinct)).tolist()
                for word, n in zip(part.distinct.to_numpy(zero_copy_only=False).tolist(), times):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame) -> list:
    """The words above the count that at most ``KNOWN`` words reach, most frequent first."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()  # a few hundred
    words, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["step"]):
        words += r["words"]
        if words > KNOWN:
            break
        least = r["least"]
    if least is None:
        return []
    return sorted(counts.filter(F.col("n") >= least).collect(), key=lambda r: (-r["n"], bytes(r["word"])))


def _ending_groups(training: DataFrame, own: list[bytes]) -> dict[bytes, int]:
    """Groups of word endings: endings that occur in texts with the same frequent words go together.

    Endings are vectors of the frequent words around them, over all training texts; a few rounds of k-means on
    at most ``ENDINGS`` of them (the most frequent) give the groups.
    """
    everywhere = _words(own)

    def run(batch):
        number: dict[bytes, int] = {}
        found = []
        for part in split_texts(batch.column("text")):
            texts, size = part.texts, len(part.sizes)
            at = _find(part.distinct, everywhere)
            place = np.where(at < 0, AROUND, np.minimum(at, AROUND))[part.tokens]
            around = np.bincount(texts * (AROUND + 1) + place, minlength=size * (AROUND + 1)).reshape(size, -1).astype(float)
            around[:, AROUND] = 0
            around /= np.maximum(1.0, np.sqrt((around**2).sum(axis=1, keepdims=True)))
            around[:, AROUND] = 1.0
            # Times that a text has an ending, of other words; sorted by ending.
            other = (at < 0)[part.tokens]
            owners, which = texts[other], (np.cumsum(at < 0) - 1)[part.tokens[other]]
            pairs = []
            for k in (-1, -3):
                ending = pc.binary_slice(part.distinct.filter(pa.array(at < 0)), k).dictionary_encode()
                numbers = np.array([number.setdefault(e, len(number)) for e in ending.dictionary.to_pylist()], np.int64)
                pairs.append(numbers[ending.indices.to_numpy()][which] * size + owners)
            pairs, times = np.unique(np.concatenate(pairs), return_counts=True)
            names, owner = np.divmod(pairs, size)
            cuts = [*np.flatnonzero(np.diff(names, prepend=-1)).tolist(), len(names)]
            found.append((names[cuts[:-1]], [times[a:b] @ around[owner[a:b]] for a, b in zip(cuts, cuts[1:])]))
        v = np.zeros((len(number), AROUND + 1))
        for names, rows in found:
            if rows:
                v[names] += rows
        return {"ending": list(number), "v": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), AROUND + 1)}

    sums = [F.sum(F.col("v")[k]).alias(f"s{k}") for k in range(AROUND + 1)]
    rows = map_batches(training.select("text"), run, "ending binary, v array<double>").groupBy("ending").agg(*sums).select(
        "ending", F.array(*[f"s{k}" for k in range(AROUND + 1)]).alias("v"), F.col(f"s{AROUND}").alias("n")).orderBy(
        F.col("n").desc(), "ending").limit(ENDINGS).collect()
    if not rows:
        return {}
    x = np.array([r["v"] for r in rows])
    weight, x = x[:, -1], x[:, :-1]
    x = x / (np.sqrt((x**2).sum(axis=1, keepdims=True)) + 1e-9)
    centers = [x[0]]
    for _ in range(GROUPS - 1):  # far and frequent starts
        far = weight * (1 - np.max(x @ np.array(centers).T, axis=1))
        centers.append(x[int(np.argmax(far))])
    centers = np.array(centers)
    for _ in range(12):
        group = np.argmax(x @ centers.T, axis=1)
        for g in range(GROUPS):
            if (group == g).any():
                mean = (x[group == g] * weight[group == g, None]).sum(axis=0)
                centers[g] = mean / (np.sqrt((mean**2).sum()) + 1e-9)
    return {bytes(r["ending"]): int(g) for r, g in zip(rows, np.argmax(x @ centers.T, axis=1))}


def build_vocabulary(counts: DataFrame, training: DataFrame) -> Vocabulary:
    """Vocabulary from all counts; endings are grouped on all of ``training``, totals of the groups cover all words."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    frequent = _frequent(counts)
    words = [bytes(r["word"]) for r in frequent]
    own = min(OWN, len(words))
    if END not in words[:own] and END in words:  # the end always has an output
        words.remove(END)
        words.insert(own - 1, END)
    numbers = {bytes(r["word"]): r["n"] for r in frequent}
    vocab = Vocabulary({w: i for i, w in enumerate(words)}, np.array([numbers[w] for w in words], np.int64), own,
                       _ending_groups(training, words[:own]) if words else {}, int(total["n"] or 0), int(total["v"] or 0),
                       np.zeros(GROUPS), np.ones(GROUPS))
    first = _words(words[:own])

    def run(batch):
        words, n = batch.column("word").cast(pa.large_binary()), batch.column("n").to_numpy()
        other = _find(words, first) < 0
        g, n = vocab.groups(words)[other], n[other]
        mass, once = np.zeros(GROUPS, np.int64), np.bincount(g[n == 1], minlength=GROUPS)
        np.add.at(mass, g, n)
        return {"g": range(GROUPS), "mass": mass, "once": once}

    slim = counts.select("word", "n")
    for r in map_batches(slim, run, "g int, mass bigint, once bigint").groupBy("g").agg(F.sum("mass").alias("mass"), F.sum("once").alias("once")).collect():
        vocab.group_mass[r["g"]] = r["mass"]
        # At least a little is left for new words, and for those seen.
        vocab.group_new[r["g"]] = min(0.9, max(1e-4, r["once"] / r["mass"])) if r["mass"] else 1.0
    return vocab


def _sign(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the network's bounded activation, cheaper than tanh. Its slope is (1 - |y|)**2."""
    y = np.abs(x)
    y += 1
    x /= y
    return x


def _exp(x: np.ndarray) -> np.ndarray:
    """exp, in place; scores beyond 60 either way count as 60, which keeps it finite without a pass for the largest."""
    np.minimum(x, 60, out=x)
    np.maximum(x, -60, out=x)
    return np.exp(x, out=x)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place."""
    x = _exp(x)
    x /= x @ np.ones((x.shape[1], 1), x.dtype)
    return x


class Network:
    """GRU over inputs (own words, then groups), softmax over classes, softmax over the words of a class."""

    NAMES = ("emb", "gate", "bias", "cls", "cls_bias", "word", "word_bias")

    def __init__(self, vocab: Vocabulary, flat: np.ndarray | None = None, seed: int = 3):
        h, self.own, self.classes = HIDDEN, vocab.own, vocab.classes
        self.fixed = self.classes - GROUPS
        rng = np.random.default_rng(seed)
        shapes = {"emb": (self.own + GROUPS, 3 * h), "gate": (h, 3 * h), "bias": (3 * h,), "cls": (h, self.classes),
                  "cls_bias": (self.classes,), "word": (self.fixed * CLASS, h), "word_bias": (self.fixed * CLASS,)}
        self.p = {k: (rng.normal(0, 0.15, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        mass = np.zeros(self.classes)
        np.add.at(mass, np.arange(self.own) // CLASS, vocab.counts[: self.own])
        mass[self.fixed:] = vocab.group_mass
        self.p["cls_bias"][:] = np.log(mass + 1.0) - np.log((mass + 1.0).sum())
        self.p["word"] *= 0.3
        self.p["word_bias"][:] = -30.0  # places without a word
        self.p["word_bias"][: self.own] = np.log(vocab.counts[: self.own] + 0.1)
        if flat is not None:
            at = 0
            for k in self.NAMES:
                n = self.p[k].size
                self.p[k] = flat[at: at + n].reshape(shapes[k]).astype(np.float32)
                at += n

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def thirds(self, name: str) -> np.ndarray:
        """A parameter's columns for update, reset and proposal, each of them in one piece."""
        return np.ascontiguousarray(self.p[name].reshape(-1, 3, HIDDEN).transpose(1, 0, 2))

    def states(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """State before each token of (lanes, steps), by step, the last state, and what a backward pass needs: gates, proposals and their products."""
        size, gate, steps, lanes = HIDDEN, self.thirds("gate"), ids.shape[1], len(ids)
        table = self.thirds("emb") + self.p["bias"].reshape(3, 1, size)
        inputs = table.take(ids.T.ravel(), axis=1).reshape(3, steps, lanes, size)
        kind = gate.dtype
        before = np.empty((steps, lanes, size), kind)
        restart = fresh.any(axis=0)
        # Without ``keep``, every step writes to the same place.
        kept = steps if keep else 1
        gates, products, proposals = (np.empty(s, kind) for s in ((2, kept, lanes, size), (3, kept, lanes, size), (kept, lanes, size)))
        for t in range(steps):
            if restart[t]:
                h = h * ~fresh[:, t, None]
            before[t] = h
            at = t if keep else 0
            a, g, zr, n = inputs[:, t], products[:, at], gates[:, at], proposals[at]
            np.matmul(before[t], gate, out=g)
            np.add(a[:2], g[:2], out=zr)
            _sign(zr)
            zr += 1
            zr *= np.float32(0.5)
            np.multiply(zr[1], g[2], out=n)
            n += a[2]
            _sign(n)
            h = before[t] - n
            h *= zr[0]
            h += n
        return before, h, (gates, proposals, products[2]) if keep else None

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.own, ids // CLASS, self.fixed + ids - self.own)

    def word_scores(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, slice]]]:
        """For rows of own words sorted by class: scores of the words of their class, where the row's own word stands in
        them, and per class that occurs its rows and words."""
        cls = ids // CLASS
        cuts = np.searchsorted(cls, np.arange(self.fixed + 1)).tolist()
        parts = [(slice(cuts[c], cuts[c + 1]), slice(c * CLASS, (c + 1) * CLASS)) for c in range(self.fixed) if cuts[c + 1] > cuts[c]]
        scores = np.empty((len(ids), CLASS), h.dtype)
        for at, words in parts:
            np.matmul(h[at], self.p["word"][words].T, out=scores[at])
        scores += self.p["word_bias"].reshape(-1, CLASS).take(cls, axis=0)
        return scores, np.arange(len(ids)) * CLASS + ids % CLASS, parts

    def log_probability(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of P(class) and, for own words, of P(word | class), per row of states."""
        def chance(scores, at):
            scores = _exp(scores)
            return scores.ravel()[at] / (scores @ np.ones(scores.shape[1], scores.dtype))

        chances = np.ones((2, len(ids)), h.dtype)
        chances[0] = chance(h @ self.p["cls"] + self.p["cls_bias"], np.arange(len(ids)) * self.classes + self.classes_of(ids))
        order = np.argsort(ids.astype(np.int16), kind="stable")
        rows = order[: np.count_nonzero(ids < self.own)]
        scores, at, _ = self.word_scores(h.take(rows, axis=0), ids[rows])
        chances[1, rows] = chance(scores, at)
        return np.log(np.maximum(chances, 1e-30)).sum(axis=0)

    def gradients(self, ids, fresh, live, h):
        """Gradients of the summed loss over (lanes, steps) where ``live`` (of ``emb``: rows and theirs), and the last state."""
        size, p, steps = HIDDEN, self.p, ids.shape[1]
        before, last, (gates, n, products) = self.states(ids, fresh, h, keep=True)
        grad = {k: np.zeros_like(p[k]) for k in ("word", "word_bias")}
        hs, flat, on = before.reshape(-1, size), ids.T.ravel(), live.T.ravel()
        every = on.all()
        e = _softmax(hs @ p["cls"] + p["cls_bias"])
        e.ravel()[np.arange(len(flat)) * self.classes + self.classes_of(flat)] -= 1
        if not every:
            e *= on[:, None]
        ones = np.ones(len(flat), hs.dtype)
        grad["cls"], grad["cls_bias"] = hs.T @ e, ones @ e
        back = e @ p["cls"].T
        # One order by input serves both ends: own words come first in it, by class.
        order = np.argsort(flat.astype(np.int16), kind="stable")
        names = flat[order]
        rows = order[: np.searchsorted(names, self.own)]
        if not every:
            rows = rows[on[rows]]
        own_hs = hs.take(rows, axis=0)
        e, at, parts = self.word_scores(own_hs, flat[rows])
        e = _softmax(e)
        e.ravel()[at] -= 1
        own_back = np.empty_like(own_hs)
        for at, words in parts:
            grad["word"][words], grad["word_bias"][words] = e[at].T @ own_hs[at], ones[at] @ e[at]
            np.matmul(e[at], p["word"][words], out=own_back[at])
        back[rows] += own_back
        back = back.reshape(before.shape)
        # Slopes of all steps at once; the loop back through time is left with a few products.
        z, r = gates
        slope = gates * 2
        slope -= 1
        np.abs(slope, out=slope)
        np.subtract(1, slope, out=slope)
        slope *= slope
        slope *= np.float32(0.5)
        of_n = np.abs(n)
        np.subtract(1, of_n, out=of_n)
        of_n *= of_n
        of_n *= 1 - z
        of_z, of_r = slope
        of_z *= before - n
        of_r *= products
        restart = fresh.any(axis=0)
        # Of update, reset and the proposal's product with the state; then of the proposal.
        slopes = np.empty((4, *before.shape), hs.dtype)
        dh, gate = np.zeros_like(h), np.ascontiguousarray(self.thirds("gate").transpose(0, 2, 1))
        for t in reversed(range(steps)):
            own = slopes[:, t]
            dn = np.multiply(dh, of_n[t], out=own[3])
            np.multiply(dh, of_z[t], out=own[0])
            np.multiply(dn, of_r[t], out=own[1])
            np.multiply(dn, r[t], out=own[2])
            dh = dh * z[t]
            for part in np.matmul(own[:3], gate):
                dh += part
            dh += back[t]
            if restart[t]:
                dh *= ~fresh[:, t, None]
        slopes = slopes.reshape(4, -1, size)
        grad["gate"] = np.concatenate([hs.T @ part for part in slopes[:3]], axis=1)
        starts = np.flatnonzero(np.diff(names, prepend=-1))
        inputs = [np.add.reduceat(slopes[k].take(order, axis=0), starts, axis=0) for k in (0, 1, 3)]
        grad["emb"] = names[starts], np.concatenate(inputs, axis=1)
        grad["bias"] = grad["emb"][1].sum(axis=0)
        return grad, last


def _lanes(texts: list[np.ndarray], most: int) -> list[list[int]]:
    """Texts dealt to lanes of about equal length; the longest lane comes first."""
    heap = [(0, k, []) for k in range(min(most, len(texts)))]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        load, k, own = heapq.heappop(heap)
        own.append(i)
        heapq.heappush(heap, (load + len(texts[i]), k, own))
    return [own for _, _, own in sorted(heap, key=lambda x: (-x[0], x[1]))]


def _windows(texts: list[np.ndarray], lanes: list[list[int]], steps: int):
    """(ids, fresh, live, text of each token) per window of the lanes that still run."""
    if not lanes:
        return
    order = [i for own in lanes for i in own]
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    stream, owners = np.concatenate([texts[i] for i in order]), np.repeat(np.array(order, np.int64), sizes)
    first = np.zeros(len(stream), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    ends = np.cumsum([sum(len(texts[i]) for i in own) for own in lanes])
    lengths = np.diff(ends, prepend=0)  # the longest lane comes first
    for at in range(0, int(lengths[0]), steps):
        running = int(np.count_nonzero(lengths > at))
        wide = min(steps, int(lengths[0]) - at)
        place = at + np.arange(wide)
        live = place < lengths[:running, None]
        place = np.minimum((ends - lengths)[:running, None] + place, len(stream) - 1)
        if live.all():
            yield stream[place], first[place], live, owners[place]
        else:
            yield stream[place] * live, first[place] & live, live, owners[place] * live


def encode(words: Words, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct word: input number (own words, then groups), index of its count, else -1, and group of a word without one."""
    at, groups = vocab.numbers(words.distinct), vocab.groups(words.distinct)
    ids = np.where(at < 0, vocab.own + groups, vocab.inputs[at])  # the entry of -1 is not used
    return ids, at, groups


def by_text(tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Tokens of several texts, taken apart."""
    ends = np.cumsum(sizes).tolist()
    return [tokens[start:stop] for start, stop in zip([0, *ends], ends)]


def train_shard(net: Network, texts: list[np.ndarray], rate: float) -> Network:
    """One pass of Adagrad with truncated backpropagation; states run on across windows.

    Of the input table, only the rows that a window has are touched. Larger shards run in more lanes, about a
    hundred windows each.
    """
    least, most = TRAIN_LANES
    lanes = _lanes(texts, min(most, max(least, sum(map(len, texts)) // (100 * TRAIN_STEPS))))
    square = {k: np.full_like(v, 1e-2 if k == "emb" else 1e-3) for k, v in net.p.items()}
    h = None
    for ids, fresh, live, _ in _windows(texts, lanes, TRAIN_STEPS):
        h = np.zeros((len(ids), HIDDEN), np.float32) if h is None else h[: len(ids)]
        grad, h = net.gradients(ids, fresh, live, h)
        scale = 1.0 / math.sqrt(max(1, live.sum()))
        names, rows = grad.pop("emb")
        rows *= scale
        square["emb"][names] += rows * rows
        net.p["emb"][names] -= rate * rows / np.sqrt(square["emb"][names])
        for k, g in grad.items():
            g *= scale
            square[k] += g * g
            net.p[k] -= rate * g / np.sqrt(square[k])
    return net


def _train_shards(batches, vocab: Vocabulary, flat: np.ndarray, rate: float, block: int):
    """Train on each shard of a partition sorted by shard; blocks of the parameters' sum, weighted by tokens."""
    total, weight = np.zeros(len(flat)), 0.0
    shard, texts = None, []

    def finish():
        nonlocal total, weight
        if texts:
            n = float(sum(map(len, texts)))
            total += train_shard(Network(vocab, flat), texts, rate).flat().astype(np.float64) * n
            weight += n
            texts.clear()

    for batch in batches:
        for number, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist()):
            if number != shard:
                finish()
                shard = number
            texts.append(np.frombuffer(ids, np.uint16).astype(np.int32))
    finish()
    if weight:
        starts = range(0, len(total), block)
        yield pa.RecordBatch.from_arrays(
            [pa.array(starts, pa.int32()), pa.array([weight] * len(starts), pa.float64()),
             pa.array([total[k: k + block] for k in starts], pa.list_(pa.float64()))], names=["block", "weight", "v"])


def train(training: DataFrame, vocab: Vocabulary, train_tokens: int, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after ``rounds`` of training and averaging; every text of ``training`` takes part.

    The number of shards follows the tokens, so a shard stays a bounded piece of work, and there is one for each round at least. They are dealt over
    the rounds, which makes one pass over everything, whatever the size. A round
    starts every shard from the same parameters. Sums weighted by tokens are built in each task, then on Spark in
    blocks, and the driver gets one set of parameters, whose size does not depend on the data.
    """
    shards = max(rounds, round(train_tokens / SHARD))
    spark = training.sparkSession
    words = spark.sparkContext.broadcast(vocab.plain())

    def numbers(batch):
        vocab = Vocabulary(*words.value)
        ids = []
        for part in split_texts(batch.column("text")):
            inputs = encode(part, vocab)[0].astype(np.uint16)[part.tokens]
            ids += [text.tobytes() for text in by_text(inputs, part.sizes)]
        return {"shard": batch.column("shard"), "ids": ids}

    # Dealt by chance with a fixed seed: equal rows go to different shards.
    dealt = training.select("text", F.floor(F.rand(17) * shards).cast("int").alias("shard"))
    dealt = materialize(map_batches(dealt, numbers, "shard int, ids binary"))
    flat = Network(vocab).flat()
    block = 1024

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        mean = np.sum(np.stack(pdf["v"].tolist()), axis=0) / pdf["weight"].sum()
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "v": [mean.tolist()]})

    for turn in range(rounds):
        rate = 0.2 / (1 + turn)
        now = dealt.filter(F.col("shard") % rounds == turn)
        start = spark.sparkContext.broadcast(flat)

        def run(batches, start=start, rate=rate):
            yield from _train_shards(batches, Vocabulary(*words.value), start.value, rate, block)

        # One task per shard: its work is in numpy, not in its bytes.
        mine = now.withColumn("shard", F.floor(F.col("shard") / rounds).cast("int"))
        parts = mine.repartitionById(-(-shards // rounds), F.col("shard")).sortWithinPartitions("shard", "ids").mapInArrow(
            run, "block int, weight double, v array<double>").groupBy("block").applyInPandas(
            average, "block int, v array<double>").collect()
        if parts:
            flat = np.concatenate([np.array(r["v"]) for r in sorted(parts, key=lambda r: r["block"])]).astype(np.float32)
    return flat


def score_texts(texts: list[np.ndarray], net: Network) -> np.ndarray:
    """Natural log-probability of the class sequence and own words of each encoded text, states carried through it."""
    total = np.zeros(len(texts))
    h = None
    for ids, fresh, live, owner in _windows(texts, _lanes(texts, LANES), STEPS):
        h = np.zeros((len(ids), HIDDEN), np.float32) if h is None else h[: len(ids)]
        before, h, _ = net.states(ids, fresh, h)
        on = live.T.ravel()
        logs = net.log_probability(before.reshape(-1, HIDDEN)[on], ids.T.ravel()[on])
        total += np.bincount(owner.T.ravel()[on], logs, len(texts))
    return total


def lm_scores(docs: DataFrame, train_part: tuple[int, int, bool] = (10, 0, False)) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row; logs to base 10.

    ``train_part``: (modulus, remainder of the id's crc32, whether that is the training part). All counts come from all
    training texts, and the network learns from all of them. The model
    gives a probability to every known word and, within each group of rare words, to a new one: own words by the
    network, other known words by their count in the group that the network predicts, new words by the share of
    words seen once. Counts of at most ``KNOWN`` words go to every task; the others meet their counts in a join
    by word, and none of them is frequent, so no key of that join is hot. Null and empty texts are an end only; with
    nothing to learn from, all words are new. Repeated rows are scored each; rows without id teach.
    """
    modulus, value, inside = train_part
    part = remainder(F.col("doc_id"), modulus)
    training = docs.select("doc_id", "text").filter(part == value if inside else part != value)
    counts = materialize(word_counts(training))
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    vocab = build_vocabulary(counts, training)
    flat = train(training, vocab, total) if vocab.own else None
    spread = vocab.total + 0.1 * (vocab.distinct + 1)
    mass, new = vocab.group_mass, vocab.group_new
    shared = docs.sparkSession.sparkContext.broadcast((vocab.plain(), flat))  # bounded by KNOWN, ENDINGS and OWN
    known_base = np.log10((vocab.counts + 0.1) / spread)
    groups = vocab.inputs[vocab.own: -1] - vocab.own
    in_group = np.zeros(len(vocab.counts))  # own words have it from the network
    in_group[vocab.own:] = np.log10((1 - new[groups]) * vocab.counts[vocab.own:] / mass[groups])

    def run(batch):
        fields, flat = shared.value
        vocab = Vocabulary(*fields)
        texts, sizes, base, seen, more, rare, rares = [], [], [], [], [], [], []
        kinds = [pa.field("word", pa.binary()), pa.field("g", pa.int32()), pa.field("times", pa.int64())]
        for words in split_texts(batch.column("text")):
            ids, at, groups = encode(words, vocab)
            texts += by_text(ids[words.tokens], words.sizes)
            starts = np.cumsum(words.sizes) - words.sizes  # no text is without an end
            has = at >= 0
            for sums, values in ((base, np.where(has, known_base[at], 0.0) if len(known_base) else np.zeros(len(at))), (seen, has.astype(np.int64)),
                                 (more, np.where(has, in_group[at], 0.0) if len(in_group) else np.zeros(len(at)))):
                sums.append(np.add.reduceat(values[words.tokens], starts))
            sizes.append(words.sizes)
            # Words without a count, once per text.
            other = ~has[words.tokens]
            pairs, times = np.unique(words.texts[other] * len(at) + words.tokens[other], return_counts=True)
            owner, word = np.divmod(pairs, len(at))
            rare.append(pa.StructArray.from_arrays([words.distinct.take(pa.array(word)).cast(pa.binary()), pa.array(groups[word]),
                                                    pa.array(times, pa.int64())], fields=kinds))
            rares.append(np.bincount(owner, minlength=len(words.sizes)))
        scores = np.concatenate([np.zeros(0), *more])
        if flat is not None:
            scores += score_texts(texts, Network(vocab, flat)) / math.log(10)
        ends = np.concatenate([[0], *rares]).cumsum()
        rare = pa.concat_arrays(rare) if rare else pa.array([], pa.struct(kinds))
        sizes, seen, base = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((sizes, np.int64), (seen, np.int64), (base, float)))
        return {"doc_id": batch.column("doc_id"), "n_tokens": sizes, "seen": seen, "base": base,
                "model": scores, "rare": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)}

    scored = map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run,
                         "doc_id bigint, n_tokens bigint, seen bigint, base double, model double,"
                         " rare array<struct<word:binary,g:int,times:bigint>>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.inline("rare")).join(counts, "word", "left")
    group_mass, group_new = (F.array(*[F.lit(float(v)) for v in values])[F.col("g")] for values in (mass, new))
    model = F.when(F.col("n").isNull(), F.log10(group_new)).otherwise(F.log10((1 - group_new) * F.col("n") / group_mass))
    sums = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / spread)).alias("more_base"),
        F.sum(F.col("times") * model).alias("more_model"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_seen"))
    zero = F.lit(0.0)
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("seen") + F.coalesce("more_seen", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", zero)).alias("score"))

