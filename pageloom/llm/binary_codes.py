"""Embedding near-duplicates by randomly rotated binary codes with correction factors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import map_batches, materialize, salted_join
from pageloom.llm.components import components

#: Chance that the search misses a pair right at the threshold.
MISS = 0.001
#: Width of the confidence bound, in deviations of the estimate.
SURE = 4.0
#: Vectors of a bucket in one block; two blocks at most meet in a task.
BLOCK = 1024
TILE = 512


def rotation(dim: int, seed: int) -> np.ndarray:
    """Random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit_rows(raw: list[bytes]) -> np.ndarray:
    """Rows of unit length in double precision."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def band_plan(rows: int, cosine: float) -> tuple[int, int]:
    """(bits a band, bands): buckets of about 64 unrelated vectors, and ``MISS`` at the threshold."""
    bits = min(24, max(8, math.ceil(math.log2(max(rows, 1) / 64)))) if rows > 64 else 8
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def band_buckets(x: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Bucket of each row in each band: sign bits of random directions."""
    planes = np.random.default_rng([11, x.shape[1]]).normal(size=(x.shape[1], bits * bands))
    signs = (x @ planes > 0).reshape(len(x), bands, bits)
    return (signs << np.arange(bits)).sum(axis=2).astype("<i4")


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sign bits after the rotation, packed; correction factor: inner product of vector and code)."""
    turned = x @ rotation(x.shape[1], 5)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1])


def estimates(turned: np.ndarray, bits: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of rotated queries with coded vectors, and their bounds.

    The inner product of query and code, over that of vector and code, has the wanted value as its mean over
    rotations; the bound holds but for a chance that falls with the square of ``SURE``.
    """
    dim = turned.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    value = (turned.astype(np.float32) @ signs.T) / (math.sqrt(dim) * factor[None].astype(np.float32))
    return value, SURE * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))


def _linked(x, turned, bits, factor, rows, cols, cosine) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs between two tiles that pass the bounds both ways and then the exact cosine."""
    one, one_bound = estimates(turned[rows], bits[cols], factor[cols])
    two, two_bound = estimates(turned[cols], bits[rows], factor[rows])
    i, j = np.nonzero((one + one_bound[None] >= cosine) & (two.T + two_bound[:, None] >= cosine))
    i, j = rows[i], cols[j]
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[k: k + 65536]], x[j[k: k + 65536]])
                            for k in range(0, len(i), 65536)] or [np.zeros(0)])
    return i[exact >= cosine], j[exact >= cosine]


def _block_links(rows: pd.DataFrame, band: int, cosine: float) -> pd.DataFrame:
    """Links within a block or between two: per vector its number of linked rows and its local root."""
    raw, ids = rows["raw"].tolist(), rows["id"].to_numpy()
    weight, side = rows["copies"].to_numpy(), rows["side"].to_numpy()
    buckets = np.frombuffer(b"".join(rows["buckets"]), "<i4").reshape(len(rows), -1)
    bits = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
    factor = rows["factor"].to_numpy()
    x = unit_rows(raw)
    turned = x @ rotation(x.shape[1], 5)
    links, root = np.zeros(len(rows), np.int64), ids.copy()
    within = bool((side == 0).all())
    left = np.flatnonzero(side <= 0)
    right = left if within else np.flatnonzero(side > 0)
    pairs = []
    for a in range(0, len(left), TILE):
        for b in range(a if within else 0, len(right), TILE):
            i, j = _linked(x, turned, bits, factor, left[a: a + TILE], right[b: b + TILE], cosine)
            keep = ids[i] < ids[j] if within and a == b else np.ones(len(i), bool)
            # A pair counts in the first band that it shares only.
            keep &= ~(buckets[i][:, :band] == buckets[j][:, :band]).any(axis=1)
            i, j = i[keep], j[keep]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            pairs.append((i, j))
    i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, int) for k in (0, 1))
    while len(i):  # smallest id reachable within the block
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (before == root).all():
            break
    has = links > 0
    return pd.DataFrame({"id": ids[has], "links": links[has], "root": root[has]})


def embedding_links(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding).

    Rows are linked if their cosine, in double precision, is at least ``cosine``; vectors of unequal lengths
    never are. Null and empty vectors, and those that are zero or hold null or non-finite numbers, link with
    nothing. Equal vectors stand as one with their count. Random sign bits deal the rest into buckets, band by
    band; the width of a band grows with the logarithm of the rows, so that buckets keep their size, and
    there are so many bands that a pair at the threshold is missed with chance ``MISS`` (and closer ones far
    less). A bucket over ``BLOCK`` vectors is split into blocks that meet two by two in tasks of their own. Within
    a task, estimates from the codes and their bounds rule out most pairs; the others are computed exactly.
    Blocks return a count and a root per vector, not pairs. Rows without vec_id link nothing
    and get null for component_id and kept.
    """
    def prepare(batch):
        raw, digest, dims = [], [], []
        for v in batch.column("embedding").to_pylist():
            x = None
            if v and None not in v:
                x = np.asarray(v, "<f8") + 0.0
                x = x if np.isfinite(x).all() and x.any() else None
            raw.append(None if x is None else x.tobytes())
            digest.append(None if x is None else xxhash.xxh3_128_digest(raw[-1]))
            dims.append(0 if x is None else len(x))
        return {"vec_id": batch.column("vec_id"), "digest": digest, "raw": raw, "dim": dims}

    rows = materialize(map_batches(vectors.select(F.col("vec_id").cast("bigint"), "embedding"), prepare,
                                   "vec_id bigint, digest binary, raw binary, dim int"))
    classes = materialize(rows.filter("digest IS NOT NULL AND vec_id IS NOT NULL").groupBy("digest").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("raw").alias("raw"), F.first("dim").alias("dim")))
    bits, bands = band_plan(classes.count(), cosine)

    def encode(batch):
        raw, dims = batch.column("raw").to_pylist(), batch.column("dim").to_numpy()
        out = {n: [None] * len(raw) for n in ("code", "factor", "buckets")}
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = unit_rows([raw[i] for i in at])
            code, factor = codes(x)
            buckets = band_buckets(x, bits, bands)
            for k, i in enumerate(at):
                out["code"][i], out["factor"][i], out["buckets"][i] = code[k].tobytes(), float(factor[k]), buckets[k].tobytes()
        return {n: batch.column(n) for n in ("id", "copies", "raw", "dim")} | out | {
            "bucket": [np.frombuffer(b, "<i4").tolist() for b in out["buckets"]]}

    coded = materialize(map_batches(classes.select("id", "copies", "raw", "dim"), encode,
                                    "id bigint, copies bigint, raw binary, dim int, code binary, factor double,"
                                    " buckets binary, bucket array<int>"))
    keys = coded.select("id", F.posexplode("bucket").alias("band", "bucket"), "dim").select(
        "id", "band", (F.shiftleft((F.col("dim") * 4096 + F.col("band")).cast("bigint"), 32) + F.col("bucket")).alias("key"))
    counts = materialize(keys.groupBy("key").count().filter("count > 1").select(
        "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = salted_join(keys, counts, ["key"], "inner", "id", salts=8).withColumn("own", own)
    # Block i meets itself and every block j > i.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1).alias("side"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        return _block_links(pdf, int(pdf["band"].iloc[0]), cosine)

    found = materialize(dealt.join(coded.drop("bucket", "dim"), "id").groupBy("key", "low", "high").applyInPandas(
        link, "id bigint, links bigint, root bigint"))
    total = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    per_class = classes.select("digest", "id", "copies").join(total, "id", "left").join(roots, "id", "left").select(
        "digest", F.coalesce("root", "id").alias("root"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return salted_join(rows.select("vec_id", "digest"), per_class.filter("links > 0"), ["digest"], "left", "vec_id").select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
