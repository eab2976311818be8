"""Cross-tokenizer alignment: merge-path pieces of the token ends of two tokenizers, links, and their corpus counts."""

from __future__ import annotations

import hashlib
import json
import re
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import fresh, materialize

#: Ends of A and B together in one piece.
PIECE_ENDS = 1 << 15
#: Rows of an Arrow batch while texts and pieces go through Python: what a task holds is so many of them.
BATCH_ROWS = 1 << 8
#: Bytes of text that are tokenized at once; longer texts are cut where both tokenizers cut anyway.
WINDOW_BYTES = 1 << 18
#: Tokens, texts and distinct pairs that a task works on at once.
SLICE_TOKENS, SLICE_BYTES, HELD_PAIRS = 1 << 18, 1 << 20, 1 << 20
#: Pairs whose counts may be broadcast; the links of rarer pairs meet their counts by shuffling.
HOT_PAIRS = 1 << 20

# The pre-tokenizer pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Ids are packed, two bytes each where the vocabulary allows.
_PIECES = ("row bigint, piece int, pieces int, n_bytes bigint, a binary, b binary, "
           "a_skip int, a_open int, b_skip int, b_open int")
_PIECE_NAMES = [field.split()[0] for field in _PIECES.split(", ")]
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@contextmanager
def batches_of(spark, rows: int = BATCH_ROWS):
    """Arrow batches of at most ``rows`` rows in the jobs run inside; the session's own setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_files(spark, *paths: str) -> list[bytes]:
    """Whole files, read by Spark on the driver's behalf or from its own disk (tokenizer files of a few MB)."""
    found = []
    for path in paths:
        if "://" in path:
            found.append(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
        else:
            with open(path, "rb") as file:
                found.append(file.read())
    return found


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenizerA:
    """Byte-level BPE from a tokenizer's JSON file; merges go by rank, which here is the id."""

    def __init__(self, file: bytes):
        import tiktoken

        whole = json.loads(file)
        special = {t["content"] for t in whole["added_tokens"] if t["special"]}
        known = byte_level_alphabet()
        self.bytes = {i: bytes(known[c] for c in entry) for entry, i in whole["model"]["vocab"].items() if entry not in special}
        ids = whole["model"]["vocab"]
        merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in whole["model"]["merges"]]
        if merged != sorted(merged) or len(set(merged)) != len(merged):
            raise ValueError("merge order and ids differ: ids are no ranks")
        self.joined = TokenBytes(self.bytes)
        self._encoding = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={v: k for k, v in self.bytes.items()},
                                           special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text)


class TokenizerB:
    """SentencePiece model; it puts a space before the text."""

    def __init__(self, file: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=file)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = {
            i: bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        }
        self.joined = TokenBytes(self.bytes)
        #: No entry holds a space after another character, so a space after one always begins a token.
        self.cuts_at_spaces = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text, num_threads=1), np.int64)


def text_windows(text: str, size: int) -> list[str]:
    """The text in windows of at least ``size`` characters, cut at single spaces between ASCII letters (the space is left out)."""
    if len(text) <= size:
        return [text]
    found, start = [], 0
    while start < len(text):
        cut = _SAFE.search(text, start + size)
        stop = cut.start() if cut else len(text)
        found.append(text[start:stop])
        start = stop + 1
    return found


def id_type(lengths: np.ndarray) -> np.dtype:
    return np.dtype("<u2" if len(lengths) <= 1 << 16 else "<u4")


class TokenBytes:
    """Bytes of ids, one after the other."""

    def __init__(self, tokens: dict[int, bytes]):
        whole = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(t) for t in whole], np.int64)
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._data = np.frombuffer(b"".join(whole), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        shift = self._starts[ids] - (np.cumsum(size) - size)
        return self._data[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes()


def encode_both(text: str | None, a: TokenizerA, b: TokenizerB, window: int = WINDOW_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Ids of both tokenizers; none for a null or empty text, or if the bytes of either are not those of space and text."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    parts = text_windows(text, window if b.cuts_at_spaces else len(text))
    both = [np.concatenate([tokenizer.encode(lead + part) for part in parts]) for tokenizer, lead in ((a, " "), (b, ""))]
    want = b" " + text.encode()
    if any(tokenizer.joined.join(ids) != want for tokenizer, ids in zip((a, b), both)):
        return none, none
    return both[0], both[1]


def merge_path(ends_a: np.ndarray, ends_b: np.ndarray, diagonal: int) -> tuple[int, int]:
    """How many ends of A and of B are among the first ``diagonal`` ends of both (A first among equals).

    A binary search along the diagonal of the merge grid; an end of B equal to the last one of A comes with it.
    """
    low, high = max(0, diagonal - len(ends_b)), min(diagonal, len(ends_a))
    while low < high:
        i = (low + high) // 2
        if ends_a[i] <= ends_b[diagonal - i - 1]:
            low = i + 1
        else:
            high = i
    i, j = low, diagonal - low
    if i and j < len(ends_b) and ends_a[i - 1] == ends_b[j]:
        j += 1
    return i, j


def pieces_of(ids_a: np.ndarray, ids_b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray, size: int) -> list[tuple]:
    """(a, b, a_skip, a_open, b_skip, b_open) per piece: ids whose bytes lie in it, the bytes of the first that lie
    before it and of the last that lie after it. Each piece is a byte range of about ``size`` ends.
    """
    if len(ids_a) + len(ids_b) <= size:
        return [(ids_a, ids_b, 0, 0, 0, 0)]
    ends_a, ends_b = np.cumsum(len_a[ids_a]), np.cumsum(len_b[ids_b])
    found, i0, j0, start = [], 0, 0, 0
    for diagonal in range(size, len(ids_a) + len(ids_b) + size, size):
        i, j = merge_path(ends_a, ends_b, min(diagonal, len(ids_a) + len(ids_b)))
        stop = max(ends_a[i - 1] if i else 0, ends_b[j - 1] if j else 0)
        if stop == start:
            continue
        i1, j1 = np.searchsorted(ends_a, stop, "left") + 1, np.searchsorted(ends_b, stop, "left") + 1
        found.append((ids_a[i0:i1], ids_b[j0:j1], int(start - (ends_a[i0 - 1] if i0 else 0)), int(ends_a[i1 - 1] - stop),
                      int(start - (ends_b[j0 - 1] if j0 else 0)), int(ends_b[j1 - 1] - stop)))
        i0, j0, start = (i1 if ends_a[i1 - 1] == stop else i1 - 1), (j1 if ends_b[j1 - 1] == stop else j1 - 1), stop
    return found


def _batches_of(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` over ``function(batches) -> iterator of dicts of columns``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for found in function(batches):
            yield pa.RecordBatch.from_arrays(
                [found[f.name] if isinstance(found[f.name], pa.Array) else pa.array(found[f.name], f.type) for f in target],
                schema=target)

    return df.mapInArrow(run, schema)


def token_pieces(docs: DataFrame, row: str, file_a: bytes, file_b: bytes, size: int = PIECE_ENDS) -> DataFrame:
    """Pieces of every document of ``docs`` (``row``, text): see :func:`pieces_of`; one piece without tokens if it has none.

    Other columns are repeated with every piece, under ``own_<number>``.
    """
    files = docs.sparkSession.sparkContext.broadcast((file_a, file_b))
    others = [c for c in docs.columns if c not in (row, "text")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([_PIECES, *[f"own_{i} {kinds[c]}" for i, c in enumerate(others)]])

    def run(batches):
        a, b = TokenizerA(files.value[0]), TokenizerB(files.value[1])
        len_a, len_b = a.joined.lengths, b.joined.lengths
        type_a, type_b = id_type(len_a), id_type(len_b)
        slices = (part for whole in batches for part in _slices(whole, pc.binary_length(whole.column("text")), SLICE_BYTES))
        for batch in slices:
            out, owners = {c: [] for c in _PIECE_NAMES}, []
            for place, text in enumerate(batch.column("text").to_pylist()):
                own = pieces_of(*encode_both(text, a, b), len_a, len_b, size)
                for number, piece in enumerate(own):
                    for name, value in zip(("a_skip", "a_open", "b_skip", "b_open"), piece[2:]):
                        out[name].append(value)
                    out["a"].append(piece[0].astype(type_a).tobytes())
                    out["b"].append(piece[1].astype(type_b).tobytes())
                    owners.append(place)
                    out["piece"].append(number)
                    out["pieces"].append(len(own))
                    out["n_bytes"].append(int(len_a[piece[0]].sum()) - piece[2] - piece[3])
            owners = pa.array(owners, pa.int64())
            yield out | {"row": batch.column("row").take(owners)} | {
                f"own_{i}": batch.column(f"own_{i}").take(owners) for i in range(len(others))}

    renamed = docs.select(F.col(row).alias("row"), "text", *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(others)])
    return _batches_of(renamed, run, schema)


def _slices(batch: pa.RecordBatch, sizes: pa.Array, limit: int):
    """The batch in parts whose ``sizes`` sum to ``limit`` or less (a row at least)."""
    ends, start = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Merged:
    """Links and cuts of many pieces at once: pieces of equal bytes on both sides follow each other without a gap."""

    def __init__(self, batch: pa.RecordBatch, len_a: np.ndarray, len_b: np.ndarray):
        def side(name, lengths):
            column, kind = batch.column(name).cast(pa.large_binary()), id_type(lengths)
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
            data = column.buffers()[2] if ends[-1] > ends[0] else b""
            ids = np.frombuffer(data, np.uint8)[ends[0]: ends[-1]].copy().view(kind).astype(np.int64)
            counts = np.diff(ends) // kind.itemsize
            own = lengths[ids]
            last = np.cumsum(counts)
            some = counts > 0
            skip, rest = (batch.column(f"{name}_{k}").to_numpy(zero_copy_only=False) for k in ("skip", "open"))
            np.subtract.at(own, (last - counts)[some], skip[some])
            np.subtract.at(own, last[some] - 1, rest[some])
            return ids, last, np.cumsum(own), rest

        self.a, self.last_a, ends_a, self.open_a = side("a", len_a)
        self.b, self.last_b, ends_b, self.open_b = side("b", len_b)
        self.stops = np.cumsum(batch.column("n_bytes").to_numpy(zero_copy_only=False))
        # The merge, on the line of bytes: 1 where a token of A ends, 2 where one of B does. Tokens have bytes, so ends differ.
        line = np.zeros(int(self.stops[-1]) + 1 if len(self.stops) else 1, np.uint8)
        line[ends_a] = 1
        line[ends_b] += 2
        ends = np.flatnonzero(line)
        kinds = line[ends]
        #: Distinct ends in order: each closes one link, of the tokens that hold the bytes before it.
        self.ends_here_a, self.ends_here_b, self.cut = kinds & 1 > 0, kinds & 2 > 0, kinds == 3
        at_a = np.cumsum(self.ends_here_a) - self.ends_here_a
        at_b = np.cumsum(self.ends_here_b) - self.ends_here_b
        self.pairs = (self.a[at_a] << 32) | self.b[at_b]
        #: Links of piece k: from bounds[k] to bounds[k + 1].
        self.bounds = np.concatenate([[0], np.searchsorted(ends, self.stops, "right")])
        # At the edge of a piece both sides end, truly or not.
        edge = (self.bounds[1:] - 1)[((self.open_a > 0) | (self.open_b > 0)) & (self.bounds[1:] > self.bounds[:-1])]
        self.cut[edge] = False

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per link, per piece."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.bounds])

    def groups(self, links: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, int]:
        """(group of each token of A that has its end among the links, the same of B, cuts), groups numbered from 0."""
        before = np.cumsum(self.cut[links]) - self.cut[links]
        return before[self.ends_here_a[links]], before[self.ends_here_b[links]], int(self.cut[links].sum())

    def tokens(self, last: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Tokens that end in each piece."""
        return np.diff(np.concatenate([[0], last])) - (rest > 0)


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..size-1 from the left, in as many columns as the longest has plus one, and their lengths."""
    numbers = np.arange(size)
    lengths = np.char.str_len(numbers.astype("U")).astype(np.int64)
    wide = int(lengths.max()) if size else 1
    table = np.zeros((size, wide + 1), np.uint8)
    for k in range(wide):
        rows = lengths > k
        table[rows, k] = 48 + numbers[rows] // 10 ** (lengths[rows] - 1 - k) % 10
    return table, lengths


def written_groups(ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, groups: int,
                   digits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of ``a1,a2|b1;a3|b2,b3;``, byte end after each id) of ids in groups numbered from 0, each with ids of both sides."""
    table, lengths = digits
    per_a, per_b = (np.bincount(g, minlength=groups) for g in (group_a, group_b))
    before_b, through_a = np.cumsum(per_b) - per_b, np.cumsum(per_a)
    at_a, at_b = np.arange(len(ids_a)) + before_b[group_a], np.arange(len(ids_b)) + through_a[group_b]
    ids, marks = np.empty(len(at_a) + len(at_b), np.int64), np.full(len(at_a) + len(at_b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    marks[at_a[through_a - 1]] = ord("|")
    marks[at_b[np.cumsum(per_b) - 1]] = ord(";")
    shown, size = table[ids], lengths[ids]
    shown[np.arange(len(ids)), size] = marks
    return shown[np.arange(table.shape[1]) <= size[:, None]], np.cumsum(size + 1)


def written_ids(ids: np.ndarray, digits: tuple[np.ndarray, np.ndarray]) -> str:
    """``1,2,3``."""
    shown, size = digits[0][ids], digits[1][ids]
    shown[np.arange(len(ids)), size] = ord(",")
    return shown[np.arange(shown.shape[1]) <= size[:, None]].tobytes()[:-1].decode()


def group_hashes(merged: Merged, digits: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """SHA-256 of each whole document's groups; empty for one without tokens."""
    if not len(merged.pairs):
        return [""] * len(merged.stops)
    group_a, group_b, groups = merged.groups()
    data, stops = written_groups(merged.a, group_a, merged.b, group_b, groups, digits)
    view, starts = memoryview(data), [0, *np.concatenate([[0], stops])[merged.last_a + merged.last_b].tolist()]
    return [hashlib.sha256(view[start: stop - 1]).hexdigest() if stop > start else "" for start, stop in zip(starts, starts[1:])]


def fragments(merged: Merged, k: int, digits: tuple[np.ndarray, np.ndarray]) -> dict:
    """Piece k as text: tokens that end before its first cut, whole groups, tokens that end after its last cut."""
    group_a, group_b, cuts = merged.groups(slice(merged.bounds[k], merged.bounds[k + 1]))
    own = []
    for ids, last, rest, group in ((merged.a, merged.last_a, merged.open_a, group_a), (merged.b, merged.last_b, merged.open_b, group_b)):
        start, stop = (last[k - 1] if k else 0), last[k] - (rest[k] > 0)
        own.append((ids[start:stop], group[: stop - start]))  # at a piece's edge an open token seems to end
    (a, group_a), (b, group_b) = own
    out = {"cuts": cuts, "middle": ""}
    for name, ids, group in (("a", a, group_a), ("b", b, group_b)):
        out[f"head_{name}"] = written_ids(ids[group == 0], digits)
        out[f"tail_{name}"] = written_ids(ids[group == cuts], digits) if cuts else ""
    if cuts > 1:
        in_a, in_b = ((g > 0) & (g < cuts) for g in (group_a, group_b))
        data, _ = written_groups(a[in_a], group_a[in_a] - 1, b[in_b], group_b[in_b] - 1, cuts - 1, digits)
        out["middle"] = data.tobytes()[:-1].decode()
    return out


def _merged(batches, len_a: np.ndarray, len_b: np.ndarray):
    """(batch, its :class:`Merged`) in parts of about ``SLICE_TOKENS`` tokens of A."""
    size = id_type(len_a).itemsize
    for whole in batches:
        for batch in _slices(whole, pc.binary_length(whole.column("a")), SLICE_TOKENS * size):
            yield batch, Merged(batch, len_a, len_b)


def pair_counts(pieces: DataFrame, len_a: np.ndarray, len_b: np.ndarray) -> DataFrame:
    """(a, b, n): links of each pair of ids; every task adds up its own first, then the sums meet by pair."""
    def run(batches):
        held, size = [], 0

        def added():
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for _, merged in _merged(batches, len_a, len_b):
            if not len(merged.pairs):
                continue
            held.append(np.unique(merged.pairs, return_counts=True))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                held, size = [added()], 0
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield {"code": held[0][0], "n": held[0][1]}
                    held = []
        if held:
            codes, n = added()
            yield {"code": codes, "n": n}

    found = _batches_of(pieces.select(*_PIECE_NAMES), run, "code bigint, n bigint")
    return found.groupBy("code").agg(F.sum("n").alias("n")).select(
        F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n")


def hot_pairs(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent pairs of ``counts``, by a least count that leaves ``limit`` at most."""
    total = counts.count()
    if total <= limit:
        return counts
    least = counts.agg(F.percentile_approx("n", 1 - limit / total, 10_000)).first()[0]
    while counts.filter(F.col("n") > least).count() > limit:
        least *= 2
    return counts.filter(F.col("n") > least)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_TEXTS = ("head_a", "head_b", "middle", "tail_a", "tail_b")
_PART = ", ".join(["row bigint", *[f"{n} bigint" for n in _NUMBERS], "sha string", "piece int", "cuts int",
                   *[f"{n} string" for n in _TEXTS], "code bigint", "times bigint"])


def piece_results(pieces: DataFrame, len_a: np.ndarray, len_b: np.ndarray, known_counts, whole: bool) -> DataFrame:
    """Numbers per piece, by the counts of the broadcast pairs, and the links of other pairs per piece (code, times).

    The groups of a ``whole`` document are hashed here; other pieces give their texts for :func:`stitch`.
    """
    def run(batches):
        codes, n, most = known_counts.value
        digits = _digits(max(len(len_a), len(len_b)))
        for batch, merged in _merged(batches, len_a, len_b):
            rows = batch.num_rows
            at = np.minimum(np.searchsorted(codes, merged.pairs), len(codes) - 1)
            known = codes[at] == merged.pairs
            count = np.where(known, n[at], 0)
            out = {
                "row": batch.column("row"), "piece": batch.column("piece"),
                "n_a": merged.tokens(merged.last_a, merged.open_a), "n_b": merged.tokens(merged.last_b, merged.open_b),
                "n_groups": merged.sums(merged.cut), "n_links": np.diff(merged.bounds),
                "n_best": merged.sums(known & (count == most[merged.pairs & 0xFFFFFFFF])), "count_sum": merged.sums(count),
            }
            empty = {f.split()[0]: [None] * rows for f in _PART.split(", ")}
            if whole:
                out["sha"] = group_hashes(merged, digits)
            else:
                found = [fragments(merged, k, digits) for k in range(rows)]
                out |= {name: [f[name] for f in found] for name in ("cuts", *_TEXTS)}
            yield empty | out
            if not known.all():
                rest = np.flatnonzero(~known)
                owner = np.searchsorted(merged.bounds, rest, "right") - 1
                rare, place = np.unique(merged.pairs[rest], return_inverse=True)
                both, times = np.unique(owner * len(rare) + place, return_counts=True)
                yield {name: [None] * len(both) for name in empty} | {
                    "row": batch.column("row").to_numpy()[both // len(rare)], "code": rare[both % len(rare)], "times": times}

    return _batches_of(pieces.select(*_PIECE_NAMES), run, _PART)


def align(docs: DataFrame, file_a: bytes, file_b: bytes, size: int = PIECE_ENDS, hot: int = HOT_PAIRS) -> DataFrame:
    """The columns of ``docs`` but ``text``, and n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (made fresh
    on a clash), a row for each row.

    A's and B's ends over the same bytes are merged in pieces: binary searches on diagonals of the merge grid find the
    piece borders, so one very long text is many pieces of equal work, dealt to tasks. Every distinct end closes one link;
    ends of both are cuts between groups. The open groups at piece borders are stitched per document, in a stream. Counts
    of pairs are added up in each task and then by pair. The counts of the ``hot`` most frequent pairs go to all
    tasks; links of rarer ones meet theirs by shuffling, added up per piece and pair; the highest count of a B id is one number per id.

    Null and empty texts, and texts whose joined token bytes differ from space and text, have no tokens: zeros, and an empty
    groups_sha256. Rows may repeat an id or have none.
    """
    spark, own = docs.sparkSession, [c for c in docs.columns if c != "text"]
    names = [fresh(docs, n) for n in (*_NUMBERS, "groups_sha256")]
    len_a, len_b = TokenizerA(file_a).joined.lengths, TokenizerB(file_b).joined.lengths
    # Numbers are written with what they number: read again, a row keeps its own.
    row = fresh(docs, "row_number")
    with batches_of(spark):
        pieces = materialize(token_pieces(docs.withColumn(row, F.monotonically_increasing_id()), row, file_a, file_b, size))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    single, long = pieces.filter("pieces = 1"), pieces.filter("pieces > 1").repartition(tasks, "row", "piece")
    with batches_of(spark):
        counts = materialize(pair_counts(single.union(long), len_a, len_b))
    best = materialize(counts.groupBy("b").agg(F.max("n").alias("most")))
    code = F.shiftleft(F.col("a").cast("bigint"), 32).bitwiseOR(F.col("b").cast("bigint")).alias("code")
    top, high = hot_pairs(counts, hot).select(code, "n").toArrow(), best.toArrow()
    codes, n = (np.concatenate([top.column(c).to_numpy(), [-1]]) for c in ("code", "n"))  # never empty
    order, most = np.argsort(codes), np.zeros(len(len_b), np.int64)
    most[high.column("b").to_numpy()] = high.column("most").to_numpy()
    sent = spark.sparkContext.broadcast((codes[order], n[order], most))
    parts = piece_results(single, len_a, len_b, sent, True).union(piece_results(long, len_a, len_b, sent, False))
    with batches_of(spark):
        work = materialize(parts)
    a, b = F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("b")
    none = {n: F.lit(0).cast("bigint").alias(n) for n in _NUMBERS}
    met = work.filter("code is not null").select("row", a, b, "times").join(counts, ["a", "b"]).join(best, "b").select(
        "row", *[none[n] for n in _NUMBERS[:4]], F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0).alias("n_best"),
        (F.col("times") * F.col("n")).alias("count_sum"), F.lit(None).cast("string").alias("sha"))
    with batches_of(spark):
        stitched = materialize(stitch(work.filter("cuts is not null"), tasks)).select("row", *none.values(), "sha")
    shares = work.filter("code is null").select("row", *_NUMBERS, "sha").union(met).union(stitched)
    total = shares.groupBy("row").agg(*[F.sum(n).alias(n) for n in _NUMBERS], F.max("sha").alias("sha"))
    kept = pieces.filter("piece = 0").select("row", *[f"own_{i}" for i in range(len(own))])
    return kept.join(total, "row").select(
        *[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)], *[F.col(c).alias(n) for c, n in zip((*_NUMBERS, "sha"), names)])


def stitch(parts: DataFrame, tasks: int) -> DataFrame:
    """(row, sha) of documents in several pieces: groups open at a border are closed by the next cut, in a stream."""
    def run(batches):
        now, state = None, None

        def closed():
            return {"row": [now], "sha": [state.hexdigest()]}

        for batch in batches:
            for r in batch.select(["row", "cuts", "head_a", "head_b", "middle", "tail_a", "tail_b"]).to_pylist():
                if r["row"] != now:
                    if now is not None:
                        yield closed()
                    now, state, first, open_a, open_b = r["row"], hashlib.sha256(), True, [], []
                open_a += [r["head_a"]] * bool(r["head_a"])
                open_b += [r["head_b"]] * bool(r["head_b"])
                if r["cuts"]:
                    state.update(f"{'' if first else ';'}{','.join(open_a)}|{','.join(open_b)}".encode())
                    if r["middle"]:
                        state.update(b";" + r["middle"].encode())
                    first, open_a, open_b = False, [r["tail_a"]] * bool(r["tail_a"]), [r["tail_b"]] * bool(r["tail_b"])
        if now is not None:
            yield closed()

    names = ("row", "piece", "cuts", "head_a", "head_b", "middle", "tail_a", "tail_b")
    dealt = parts.select(*names).repartition(tasks, "row").sortWithinPartitions("row", "piece")
    return _batches_of(dealt, run, "row bigint, sha string")
