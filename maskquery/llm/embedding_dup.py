"""Embedding near-dedup by cross-polytope hashing.

A vector is padded to a power of two and rotated by three rounds of random signs and a fast Hadamard transform. Its hash is the
axis it is nearest to (the largest coordinate and its sign); a bucket joins ``depth`` such hashes of independent rotations. Every
vector is also put into the buckets in which one hash is its second nearest axis (multiprobe). Vectors that share a bucket of
their label are compared exactly, in double precision, in blocks. Equal vectors are one class and are hashed once.

``depth`` follows the number of classes, so that buckets stay small, and the number of tables follows from the chance that a pair
of the wanted cosine shares a bucket, taken from ``TRIALS`` made-up pairs of the same dimension, until the target recall.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite entries, and those with a null label, link with
nothing; vectors of different lengths don't compare; repeated rows are copies of each other; a null id is counted like any
other; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskquery.llm.blocks import by_block, blocks, components, groups, local_minima, number
from maskquery.llm.store import keep
from maskquery.llm.text import mix, signed

COSINE, RECALL, TRIALS, MOST_TABLES = 0.98, 0.9999, 10_000, 64
_U = np.uint64


def _axes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest signed axis of each rotated row."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    y = np.zeros((n, width), np.float32)
    y[:, :d] = x
    signs = np.random.default_rng(seed).integers(0, 2, (3, width)) * 2 - 1
    for s in signs.astype(np.float32):
        y *= s
        h = 1
        while h < width:
            z = y.reshape(n, width // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(n, width)
            h *= 2
        y /= math.sqrt(width)
    a = np.abs(y)
    rows = np.arange(n)
    best = a.argmax(1)
    a[rows, best] = -1
    next_ = a.argmax(1)
    return 2 * best + (y[rows, best] < 0), 2 * next_ + (y[rows, next_] < 0)


def bucket_keys(x: np.ndarray, table: int, depth: int, salt: np.ndarray) -> np.ndarray:
    """The 1 + depth buckets of each row in a table (rows x probes); ``salt`` parts labels and lengths."""
    pairs = [_axes(x, 1000 * table + k) for k in range(depth)]
    out = []
    for probe in range(-1, depth):
        h = mix(salt + _U(table + 1))
        for k, (first, second) in enumerate(pairs):
            h = mix(h + (second if k == probe else first).astype(np.uint64))
        out.append(h)
    return np.stack(out, 1)


def plan(n: int, d: int) -> tuple[int, int]:
    """Depth and number of tables for n classes of length d."""
    width = 1 << max(1, (d - 1).bit_length())
    depth = max(1, round(math.log(max(n, 2)) / math.log(2 * width)))
    rng = np.random.default_rng(7)
    x = rng.standard_normal((TRIALS, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((TRIALS, d))
    z -= (z * x).sum(1, keepdims=True) * x
    y = COSINE * x + math.sqrt(1 - COSINE**2) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    salt = np.zeros(TRIALS, np.uint64)
    missed, tables = np.ones(TRIALS, bool), 0
    trial_tables = 12
    for t in range(trial_tables):
        missed_here = ~(bucket_keys(x, t, depth, salt)[:, :, None] == bucket_keys(y, t, depth, salt)[:, None, :]).any((1, 2))
        missed &= missed_here
        tables = t + 1
        if missed.mean() <= 1 - RECALL:
            return depth, tables
    rate = max(1e-6, missed.mean()) ** (1 / trial_tables)
    return depth, min(MOST_TABLES, max(trial_tables, math.ceil(math.log(1 - RECALL) / math.log(min(rate, 0.999)))))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _keyed(classes: DataFrame, depth: int, tables: int, size: int) -> DataFrame:
    """``id`` and the keys of all tables, one table after the other, for classes of length ``size``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            salt = mix(batch.column(2).to_numpy().astype(np.int64).view(np.uint64) + _U(size))
            keys = np.concatenate([bucket_keys(x, t, depth, salt) for t in range(tables)], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * keys.shape[1]), pa.array(signed(keys).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "keys"])

    return classes.select("id", "embedding", F.xxhash64("label").alias("label")).mapInArrow(read, "id long, keys array<long>")


def _owned(left: np.ndarray, right: np.ndarray, table: int, key: int, probes: int) -> np.ndarray:
    """Pairs whose first shared table is ``table`` and whose least shared key there is ``key``."""
    meets = np.zeros((len(left), len(right)), bool)
    for t in range(table):
        for p in range(probes):
            for q in range(probes):
                meets |= left[:, t * probes + p][:, None] == right[:, t * probes + q][None, :]
    own = (left[:, table * probes : (table + 1) * probes] == key).any(1)[:, None] & (right[:, table * probes : (table + 1) * probes] == key).any(1)[None, :]
    for p in range(probes):
        a = left[:, table * probes + p][:, None]
        for q in range(probes):
            b = right[:, table * probes + q][None, :]
            meets |= (a == b) & (a < key)
    return own & ~meets


def _verifier(probes: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches):
            ids, at = np.unique(block.column(block.schema.get_field_index("id")).to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            block = block.take(pa.array(at))
            get = lambda c: block.column(block.schema.get_field_index(c))
            side, lo, hi = get("side").to_numpy(), get("lo")[0].as_py(), get("hi")[0].as_py()
            rows, cols = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
            if not len(rows) or not len(cols):
                continue
            keys = get("keys").flatten().to_numpy().reshape(len(ids), -1)
            mine = _owned(keys[rows], keys[cols], get("tree")[0].as_py(), get("key")[0].as_py(), probes)
            if lo == hi:
                mine = np.triu(mine, 1)
            if not mine.any():
                continue
            x = _matrix(get("embedding"))
            x /= np.abs(x).max(1, keepdims=True)
            norm = np.sqrt((x * x).sum(1))
            link = mine & (x[rows] @ x[cols].T >= COSINE * (norm[rows][:, None] * norm[cols][None, :]))
            weight, total = get("weight").to_numpy(), np.zeros(len(ids), np.int64)
            total[rows] += link @ weight[cols]
            total[cols] += link.T @ weight[rows]
            names, low = local_minima(link, ids[rows], ids[cols])
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(total[hit]), pa.array(low[np.searchsorted(names, ids[hit])])], ["id", "links", "low"])

    return verify


def linked(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding, label``)."""
    usable = F.col("label").isNotNull() & F.exists("embedding", lambda v: v != 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = vectors.select(number(F.col("vec_id"), F.col("embedding")).alias("id"), "vec_id", F.coalesce(usable, F.lit(False)).alias("usable"), "label", "embedding")
    own = own.withColumns({"a": F.xxhash64("label", "embedding"), "b": F.xxhash64("embedding", "label", F.lit(1))})
    classes = own.filter("usable").groupBy("a", "b").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = keep(classes, "vec-classes")
    sizes = [(r["d"], r["n"]) for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()]
    depth, tables = max((plan(n, d) for d, n in sizes), key=lambda p: (p[0], p[1]), default=(1, 1))
    keyed = None
    for d, _ in sizes:  # one per vector length; a column holds one as a rule
        part = _keyed(classes.filter(F.size("embedding") == d), depth, tables, d)
        keyed = part if keyed is None else keyed.unionByName(part)
    if keyed is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    probes = 1 + depth
    keyed = keep(keyed, "vec-keys")
    rows = keyed.select("id", F.posexplode("keys").alias("at", "key")).select("id", F.floor(F.col("at") / probes).cast("int").alias("tree"), "key").distinct()
    placed = keep(blocks(rows, "vec"), "vec-blocks")
    payload = classes.select("id", "weight", "embedding").join(keyed, "id")
    found = keep(by_block(placed.join(payload, "id").select("id", "tree", "key", "lo", "hi", "side", "weight", "keys", "embedding")).mapInArrow(_verifier(probes), "id long, links long, low long"), "vec-links")
    comp = components(found.select("id").distinct(), found.select("id", "low"))
    known = classes.select("a", "b", "id", "weight").join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(comp, "id", "left")
    known = keep(known.select("a", "b", F.col("id").alias("class"), "weight", "links", "comp", F.lit(True).alias("usable")), "vec-known")
    out = own.select("id", "vec_id", "usable", "a", "b").join(known, ["usable", "a", "b"], "left")
    component = F.coalesce("comp", "class", "id")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_embedding_near_dedup": op10_embedding_near_dedup}
ORACLES = {
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.98 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
}
