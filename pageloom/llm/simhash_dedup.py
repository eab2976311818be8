"""SimHash near-duplicates: popcount vectors on a grid, then exact Hamming distance."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.common import byte_column, fresh, map_batches, materialize, salted_join
from pageloom.llm.components import components

SEED = 42
SEGMENTS, WIDTH = 16, 4
#: Hashes expanded to bits at once; bounds the memory of a long text.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a text, A-Z in lower case; 0 without words.

    Words are split at ASCII whitespace. A bit is 1 if it is set in over half of the XXH64 values.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = ends[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at: at + BLOCK], ends[at: at + BLOCK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * count > len(starts), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) per row; null and empty texts get 0."""
    def run(batch):
        return {"doc_id": batch.column("doc_id"), "fp": [fingerprint(t, shingle) for t in byte_column(batch, "text")]}

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, fp bigint")


def _counts(fp: Column) -> list[Column]:
    mask = (1 << WIDTH) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, WIDTH * s).bitwiseAND(F.lit(mask))) for s in range(SEGMENTS)]


def _cell(fp: Column) -> Column:
    """Bit counts of the segments, WIDTH bits each, in one number."""
    cell = F.lit(0).cast("bigint")
    for s, count in enumerate(_counts(fp)):
        cell = cell + F.shiftleft(count.cast("bigint"), WIDTH * s)
    return cell


def grid_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct 64-bit prints in (fp, node) that differ in at most two bits.

    A print becomes the vector of set bits in its 16 segments of 4 bits. The Manhattan distance of two
    vectors is at most the Hamming distance of the prints, so links lie within two grid steps: each
    print enters its own cell and the cells one step away, and two prints within two steps meet in a cell
    between them. Which step each took decides whether this is the one cell that reports the pair, so no
    pair comes twice; the exact distance is checked in the join. A cell holds few prints unless
    they are close: at most 2,081 lie within two bits of one. Both sides are shuffled: Spark sizes them by the
    prints, not by their up to 33 cells, and would send a table far over its limit through the driver.
    """
    if distance != 2:
        raise ValueError("the grid is laid out for a distance of 2")
    vectors = prints.select("fp", "node", _cell(F.col("fp")).alias("_c"))

    def placed(side: str, moves: tuple[int, ...]) -> DataFrame:
        cells = [F.struct(F.lit(0).alias("move"), F.lit(-1).alias("axis"), F.col("_c").alias("cell"))]
        for s, count in enumerate(_counts(F.col("fp"))):
            unit = F.lit(1 << (WIDTH * s)).cast("bigint")
            for move in moves:
                cells.append(F.when(count < WIDTH if move > 0 else count > 0, F.struct(
                    F.lit(move).alias("move"), F.lit(s).alias("axis"), (F.col("_c") + move * unit).alias("cell"))))
        rows = vectors.select("fp", "node", F.inline(F.array_compact(F.array(*cells))))
        return rows.select("cell", *[F.col(c).alias(f"{side}_{c}") for c in ("fp", "node", "move", "axis")])

    meet = F.expr(
        "(x_move = 0 AND y_move = 0 AND x_node < y_node) OR (x_move = 0 AND y_move = 1)"
        " OR (x_move = -1 AND y_move = 1 AND x_axis <= y_axis)"
        " OR (x_move = 1 AND y_move = 1 AND x_axis < y_axis)"
    )
    close = F.bit_count(F.col("x_fp").bitwiseXOR(F.col("y_fp"))) <= distance
    return placed("x", (1, -1)).hint("merge").join(placed("y", (1,)), "cell").filter(
        meet & close & (F.col("x_node") != F.col("y_node"))).select(
        F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable by links of at most ``distance`` bits.

    Equal fingerprints are one node, so a group of copies of any size costs one row per task in the
    search; rows that repeat a doc_id are linked. Null and empty texts have fingerprint 0 and are
    linked like any other. Rows without doc_id link nothing: they get the component of the rows with their
    fingerprint, else null. An empty table gives no row.
    """
    prints = materialize(fingerprints(docs, shingle))
    named = materialize(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(
        F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.count("*").alias("rows")))
    same_id = prints.join(
        prints.groupBy("doc_id").agg(F.count_distinct("fp").alias("n")).filter("n > 1 AND doc_id IS NOT NULL"), "doc_id"
    ).join(named, "fp").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = grid_links(named, distance).union(same_id).distinct()
    # Only prints that stand for several rows or are linked need to be looked up.
    shared = named.join(components(links), "node", "left").filter("rows > 1 OR root IS NOT NULL").select(
        "fp", F.coalesce("root", "node").alias("root"))
    return salted_join(prints, shared, ["fp"], "left", "doc_id").select(
        "doc_id", "fp", F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one row per group: that with the smallest doc_id. Rows without doc_id stay.

    Rows that repeat a doc_id are one document, of which that with the smallest text stays. The documents are shuffled once, by id
    (not at all while Spark finds the dropped ids small enough to broadcast).
    """
    key = fresh(docs, "dropped_id")
    groups = materialize(simhash_groups(docs, shingle, distance))
    dropped = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    repeated = groups.filter("component_id = doc_id").groupBy("doc_id").count().filter("count > 1").select(
        F.col("doc_id").alias(key))
    kept = docs.join(dropped, docs["doc_id"] == dropped[key], "left_anti")
    if repeated.isEmpty():
        return kept
    repeated = materialize(repeated)
    # Chosen in an aggregate that combines before its shuffle, as one id may repeat without end.
    whole = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
    once = kept.join(repeated, kept["doc_id"] == repeated[key], "left_semi").groupBy(F.col("doc_id").alias(key)).agg(
        F.min_by(whole, F.struct("text", F.xxhash64(*kept.columns))).alias("row")).select("row.*")
    return kept.join(repeated, kept["doc_id"] == repeated[key], "left_anti").union(once)
