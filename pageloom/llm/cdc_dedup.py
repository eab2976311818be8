"""Substring dedup: content-defined chunks from a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import byte_column, fresh, join_to_keys, map_batches, materialize, salted_join

#: Bytes that the rolling hash looks back at (a power of two, as 32-bit gear values shift out after 32).
LOOK_BACK = 32
#: One word end in this many is a cut, on average; chunks have MIN_WORDS to MAX_WORDS words.
CUT_EVERY, MIN_WORDS, MAX_WORDS = 4, 2, 64
#: Words that repeated chunks in a row must have to be removed.
MIN_RUN = 25
#: A longer run of bytes without white space is cut into parts that count as words: one byte in PART_EVERY on average
#: ends a part, and no part is longer than LONG_WORD.
LONG_WORD, PART_EVERY = 64, 8

_GEAR = np.frombuffer(b"".join(xxhash.xxh32_digest(bytes([i]), 2027) for i in range(256)), ">u4").astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash h = 2 h + gear[byte] (mod 2**32) at every byte, over the last ``LOOK_BACK`` bytes.

    The sum of shifted gear values is built in doubling steps, so that numpy runs over whole texts.
    """
    h = _GEAR[data]
    step = 1
    while step < LOOK_BACK:
        before = np.zeros_like(h)
        before[step:] = h[:-step] << np.uint32(step)
        h = h + before
        step *= 2
    return h


def word_ends(data: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Last byte of each word. Words of over ``LONG_WORD`` bytes, as in scripts without spaces, end in parts, too: where the rolling hash
    says so, between characters, and ``LONG_WORD`` bytes after the last end at the latest (a few more, to end a character).
    """
    space = _SPACE[data]
    last = ~space
    last[:-1] &= space[1:]
    first = ~space
    first[1:] &= space[:-1]
    ends, starts = np.flatnonzero(last), np.flatnonzero(first)
    long = np.flatnonzero(ends - starts >= LONG_WORD)
    if not len(long):
        return ends
    parts = [ends]
    whole = np.ones(len(data), bool)  # bytes that end a character
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    for start, end in zip(starts[long].tolist(), ends[long].tolist()):
        own = start + np.flatnonzero(whole[start:end])
        marks, at, least = own[(h[own] >> np.uint32(16)) % np.uint32(PART_EVERY) == 0], start - 1, []
        for mark in [*marks.tolist(), end]:
            while mark - at > LONG_WORD:
                at = int(own[np.searchsorted(own, at + LONG_WORD)]) if at + LONG_WORD <= own[-1] else mark
                least.append(at)
            at = mark
        parts += [marks, np.array(least, np.int64)]
    return np.unique(np.concatenate(parts))


def chunk_ends(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte ends of the chunks, words in each); the last chunk ends with the text. Chunks end after a word.

    Parts of very long words count as words (:func:`word_ends`). A cut depends on the bytes before it only, and on the chunk's least and largest length, so an
    insertion moves the cuts near it and no others.
    """
    data = np.frombuffer(text, np.uint8)
    h = gear_hash(data)
    ends = word_ends(data, h)
    if not len(ends):
        return np.array([len(text)] if len(text) else [], np.int64), np.zeros(1 if len(text) else 0, np.int64)
    # Other bits of the hash than those that end a part, so that cuts among parts are as rare as among words.
    marks = np.flatnonzero((h[ends] >> np.uint32(8)) % np.uint32(CUT_EVERY) == 0)
    cuts, at, total = [], -1, len(ends)
    for mark in marks.tolist():
        while mark - at > MAX_WORDS:
            at += MAX_WORDS
            cuts.append(at)
        if mark - at >= MIN_WORDS:
            at = mark
            cuts.append(at)
    while total - 1 - at > MAX_WORDS:
        at += MAX_WORDS
        cuts.append(at)
    if at < total - 1:
        cuts.append(total - 1)
    cuts = np.array(cuts)
    words = np.diff(cuts, prepend=-1)
    stops = ends[cuts] + 1
    stops[-1] = len(text)  # white space at the end goes with the last chunk
    return stops, words


def chunks(text: bytes | None) -> list[tuple[int, int, int]]:
    """(digest, byte end, words) of each chunk. The digest leaves out white space around the chunk."""
    if not text:
        return []
    stops, words = chunk_ends(text)
    found, start = [], 0
    for stop, n in zip(stops.tolist(), words.tolist()):
        found.append((xxhash.xxh3_64_intdigest(text[start:stop].strip()) - (1 << 63), stop, n))
        start = stop
    return found


def windows(own: list[tuple[int, int, int]], min_run: int = MIN_RUN) -> list[tuple[int, int, int]]:
    """(digest, first chunk, chunk after the last) of the shortest runs of chunks that have ``min_run`` words.

    There is one from every chunk on and one up to every chunk, so any run of ``min_run`` words or more is covered by
    windows that lie inside it.
    """
    if not own:
        return []
    digests = np.array([c[0] for c in own], np.int64)
    words = np.concatenate([[0], np.cumsum([c[2] for c in own])])
    places, data = np.arange(len(own)), digests.tobytes()
    onward = np.searchsorted(words, words[:-1] + min_run)
    backward = np.searchsorted(words, words[1:] - min_run, "right") - 1
    spans = set(zip(places[onward <= len(own)].tolist(), onward[onward <= len(own)].tolist()))
    spans.update(zip(backward[backward >= 0].tolist(), (places + 1)[backward >= 0].tolist()))
    return [(xxhash.xxh3_64_intdigest(data[8 * i: 8 * j]) - (1 << 63), i, j) for i, j in sorted(spans)]


def keyed_documents(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``key``: null where the row alone has its doc_id, else (also without doc_id) a hash of its text.

    Only the ids that repeat are looked up; texts are not shuffled unless those are too many to broadcast.
    """
    several = fresh(docs, "several_id")
    ids = docs.select(F.col("doc_id").cast("bigint").alias(several)).filter(F.col(several).isNotNull())
    repeated = materialize(ids.groupBy(several).count().filter("count > 1").select(several))
    count = repeated.count()
    alone = F.lit(None).cast("bigint")
    marked = docs.withColumn(several, F.col("doc_id").cast("bigint"))
    if count:
        hit = fresh(marked, "several_hit")
        marked = join_to_keys(marked, repeated.withColumn(hit, F.lit(True)), several, "left", F.xxhash64("text"), count)
        alone = F.when(F.col(hit), F.xxhash64("text"))
    marked = marked.withColumn(key, F.when(F.col(several).isNull(), F.xxhash64("text")).otherwise(alone))
    return marked.select(*docs.columns, key)


def window_table(docs: DataFrame, key: str, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, text_key, idx, stop, digest) of every window of chunks, chunks counted from 0; ``key`` as in :func:`keyed_documents`."""
    def run(batch):
        ids, keys, starts, stops, digests = [], [], [], [], []
        for doc, own_key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), byte_column(batch, "text")):
            own = windows(chunks(text), min_run)
            ids += [doc] * len(own)
            keys += [own_key] * len(own)
            digests += [w[0] for w in own]
            starts += [w[1] for w in own]
            stops += [w[2] for w in own]
        return {"doc_id": ids, "text_key": keys, "idx": starts, "stop": stops, "digest": digests}

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col(key).alias("text_key"), "text")
    return map_batches(rows, run, "doc_id bigint, text_key bigint, idx int, stop int, digest bigint")


def repeated_windows(docs: DataFrame, key: str, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, text_key, repeats): chunks that lie in a window whose content came before, from a smaller (doc_id, text_key, idx) on.

    Each of ``repeats`` is a range of chunks: 2**32 times the first, plus the one after the last. Where a window runs into
    its first occurrence in the same document, the chunks of the latter are left out. Digests are 64 bits: a wrong
    match needs one in 2**64 per pair. Counts per digest combine before their shuffle; a digest found everywhere is
    spread by a salted join.
    """
    rows = window_table(docs, key, min_run)
    first = materialize(rows.groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_key", "idx")).alias("first"), F.count("*").alias("n")).filter("n > 1").select(
        "digest", F.col("first.doc_id").alias("first_doc"), F.col("first.text_key").alias("first_key"), F.col("first.idx").alias("first_idx")))
    # Salted by the document, so that the windows of one digest go to several tasks.
    again = salted_join(rows, first, ["digest"], "inner", F.xxhash64("doc_id", "text_key"), salts=8)
    same = F.col("doc_id").eqNullSafe(F.col("first_doc")) & F.col("text_key").eqNullSafe(F.col("first_key"))
    start = F.when(same, F.greatest(F.col("idx"), F.col("first_idx") + F.col("stop") - F.col("idx"))).otherwise(F.col("idx"))
    again = again.filter(~(same & (F.col("idx") == F.col("first_idx")))).withColumn("start", start).filter("start < stop")
    return again.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(
        F.col("start").cast("bigint") * F.lit(1 << 32) + F.col("stop"))).alias("repeats"))


def cut_runs(text: bytes, repeats: list[int], min_run: int = MIN_RUN) -> tuple[bytes, int, int, int]:
    """Text without the runs of repeated chunks (in the ranges ``repeats``) that have ``min_run`` words or more.

    Returns (text, chunks, chunks cut, words cut); chunks and white space outside the runs stay as they are.
    """
    own = chunks(text)
    marked = np.zeros(len(own) + 1, bool)
    for place in repeats:
        marked[place >> 32: min(place & 0xFFFFFFFF, len(own))] = True
    kept, at, cut, words_cut, i = [], 0, 0, 0, 0
    while i < len(own):
        j = i
        while marked[j]:
            j += 1
        if j == i:
            i += 1
            continue
        words = sum(c[2] for c in own[i:j])
        if words >= min_run:
            kept.append(text[at: own[i - 1][1] if i else 0])
            at, cut, words_cut = own[j - 1][1], cut + j - i, words_cut + words
        i = j
    kept.append(text[at:])
    return b"".join(kept), len(own), cut, words_cut


def dedup_substrings(docs: DataFrame, min_run: int = MIN_RUN, report: bool = False) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; the first occurrence (by doc_id, position) stays.

    Cut are runs of chunks worth ``min_run`` words that came before in the same order, next to each other in one
    document; shorter repeats stay, and so do runs of chunks that came before in different places. The
    words of a passage before its first cut point and after its last (a few each) stay. Null texts stay
    null, empty texts empty; a text that came before as a whole becomes empty. Different texts with one doc_id, or without any, are
    documents of their own, in the order of a hash; rows equal in doc_id and text count as one document and stay alike. n_chars, if there, follows the new
    text. ``report`` adds chunks, chunks_cut and words_cut (made fresh on a clash). Texts are shuffled once,
    by doc_id, to meet their repeats.
    """
    names = [fresh(docs, n) for n in ("chunks", "chunks_cut", "words_cut")]
    own, found_id, found_key, repeats = (fresh(docs, n) for n in ("text_key", "repeat_id", "repeat_key", "repeats"))
    keyed = keyed_documents(docs, own)
    found = repeated_windows(keyed, own, min_run).select(
        F.col("doc_id").alias(found_id), F.col("text_key").alias(found_key), F.col("repeats").alias(repeats))
    # A document without marks has nothing to join; the null-safe keys are the id, and the hash where ids repeat.
    joined = keyed.join(found, F.col("doc_id").cast("bigint").eqNullSafe(F.col(found_id)) & F.col(own).eqNullSafe(F.col(found_key)),
                        "left").drop(own, found_id, found_key)
    columns = list(docs.columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
                       + ([f"`{n}` bigint" for n in names] if report else []))

    def run(batch):
        texts, counts = [], []
        for text, marks in zip(byte_column(batch, "text"), batch.column(repeats).to_pylist()):
            if text is None:
                texts.append(None)
                counts.append((0, 0, 0))
            elif not marks and not report:
                texts.append(text.decode())
                counts.append((0, 0, 0))
            else:
                new, *numbers = cut_runs(text, marks or [], min_run)
                texts.append(new.decode())
                counts.append(numbers)
        out = {c: batch.column(c) for c in columns} | {"text": texts}
        if "n_chars" in out:
            same = batch.column("n_chars").to_pylist()
            out["n_chars"] = [n if not c[2] else len(t) for n, c, t in zip(same, counts, texts)]
        if report:
            out |= {n: [c[k] for c in counts] for k, n in enumerate(names)}
        return out

    return map_batches(joined, run, schema)
