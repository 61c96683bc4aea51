"""N-gram Jaccard join by MinHash in fixed bands.

A document is the set of its runs of five words (A-Z lower-cased, split at ASCII white space; a text of fewer words is one run).
Documents with equal sets are one class. Each of ``TREES`` bands has one key per class, made of as many least hashes (``DEEPEST`` at
most) as let a pair of the wanted similarity share a key in some band with the target recall; the number is fixed before any data
is read. Classes with one key are candidates; their sets are compared exactly, in blocks.

Defined cases: null, empty and wordless texts have no runs and link with nothing; texts of any length take part whole; repeated
rows are copies of each other; a null id is a document whose id is null, counted like any other; an empty table gives an empty
table; further columns are carried along by ``one_of_each`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskquery.llm.blocks import by_block, blocks, components, first_shared, groups, local_minima, number
from maskquery.llm.slots import maybe_in, without
from maskquery.llm.store import free_name, keep
from maskquery.llm.text import LOWER, NOT_SPACE, bounds, gram_hashes, mix, ragged, run_hashes, signed, slices

WORDS, SIMILARITY = 5, 0.8
TREES, DEEPEST, RECALL = 12, 6, 0.9995
_U = np.uint64


def prefix_length(similarity: float = SIMILARITY, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix at which pairs of this similarity meet in some tree with the target recall."""
    for k in range(deepest, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    return 1


def shingles(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's runs of words, sorted within the text, and the n + 1 bounds of the texts."""
    low = LOWER[data]
    s, e, row = bounds(NOT_SPACE[low], off)
    h, first, n = run_hashes(low, s, e), row[:-1], np.diff(row)
    grams = np.maximum(n - words + 1, 0)
    g, of = gram_hashes(h, words)[ragged(first, grams)] if len(h) >= words else np.zeros(0, _U), np.repeat(np.arange(len(n)), grams)
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        whole = np.array([gram_hashes(h[first[i] : first[i] + n[i]], int(n[i]))[0] + _U(n[i]) for i in short], _U)
        g, of = np.r_[g, whole], np.r_[of, short]
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    g, of = g[new], of[new]
    return g, np.searchsorted(of, np.arange(len(n) + 1))


_MULTIPLIERS = mix(np.arange(1, 1 + TREES * DEEPEST, dtype=np.uint64)) | _U(1)


def tree_keys(g: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For each text with runs, the key of its prefix of ``depth`` least hashes in every tree (rows x TREES); else 0."""
    n = len(at) - 1
    out = np.zeros((n, TREES), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    for t in range(TREES):
        key = np.full(len(full), t + 1, np.uint64)
        for k in range(depth):
            m = _U(_MULTIPLIERS[t * DEEPEST + k])
            key = mix(key + np.minimum.reduceat(g * m, at[full]))
        out[full, t] = key
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """``id, doc_id, a, b, n, keys``: two sums that name the set of runs, its size, and the tree keys; sets may be empty (n = 0)."""
    depth = prefix_length()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch):
                g, at = shingles(data, off)
                sums = [np.diff(np.r_[np.zeros(1, np.uint64), np.cumsum(x)][at]) for x in (g, mix(g + _U(7)))]
                keys = tree_keys(g, at, depth)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at), dtype=np.int32) * TREES), pa.array(signed(keys).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(signed(x)) for x in sums), pa.array(np.diff(at).astype(np.int32)), lists], ["id", "doc_id", "a", "b", "n", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(number(F.col("doc_id"), F.col("text")).alias("id"), "doc_id", "text").mapInArrow(read, f"id long, doc_id {kind}, a long, b long, n int, keys array<long>")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ``id, tree, side, weight, keys, text``: the links of each member to members that first meet it here."""
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
        mine = first_shared(keys[rows], keys[cols]) == get("tree")[0].as_py()
        if lo == hi:
            mine = np.triu(mine, 1)
        if not mine.any():
            continue
        sets = [shingles(data, off) for _, data, off in slices(block)]
        size = np.concatenate([np.diff(b) for _, b in sets])
        g, of = np.concatenate([x for x, _ in sets]), np.repeat(np.arange(len(ids)), size)
        both = _intersections(g, of, len(ids), rows, cols)
        union = size[rows][:, None] + size[cols][None, :] - both
        link = mine & (both >= SIMILARITY * union - 1e-9)
        weight = get("weight").to_numpy()
        total = np.zeros(len(ids), np.int64)
        total[rows] += link @ weight[cols]
        total[cols] += link.T @ weight[rows]
        names, low = local_minima(link, ids[rows], ids[cols])
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(total[hit]), pa.array(low[np.searchsorted(names, ids[hit])])], ["id", "links", "low"])


def _intersections(g: np.ndarray, of: np.ndarray, n: int, rows: np.ndarray, cols: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of rows' and cols' sets, by products of 0/1 matrices over ``width`` runs at a time."""
    words, place = np.unique(g, return_inverse=True)
    count = np.bincount(place, minlength=len(words))
    shared = count > 1  # a run of one member meets nothing
    place = (np.cumsum(shared) - 1)[place[shared[place]]], of[shared[place]]
    order = np.argsort(place[0], kind="stable")
    at, of = place[0][order], place[1][order]
    out = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(at, (lo, lo + width))
        m = np.zeros((n, width), np.float32)
        m[of[a:b], at[a:b] - lo] = 1
        out += m[rows] @ m[cols].T
    return out.astype(np.int64)


def linked(docs: DataFrame) -> DataFrame:
    """``id, doc_id, class_id, n_links, component_id`` for every row of ``docs`` (``doc_id, text``).

    ``id`` is ``doc_id``, or a negative number from the text where that is null.

    ``class_id`` is the least id among documents with the same set of runs; ``n_links`` the number of other documents with a
    similarity of ``SIMILARITY`` or more, copies included; ``component_id`` the least id reachable over links.
    """
    signed_docs = keep(signatures(docs.select("doc_id", "text")), "near-signatures")
    classes = keep(signed_docs.filter("n > 0").groupBy("a", "b", "n").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("weight"), F.min_by("keys", "id").alias("keys")), "near-classes")
    rows = classes.select(F.col("class").alias("id"), F.posexplode("keys").alias("tree", "key"))
    placed = keep(blocks(rows, "near"), "near-blocks")
    texts = docs.select(number(F.col("doc_id"), F.col("text")).alias("id"), "text")
    wanted = keep(placed.select("id").distinct(), "near-wanted")
    texts = texts.filter(maybe_in(wanted.select(F.xxhash64("id")))(F.xxhash64("id")))
    members = keep(texts.join(wanted, "id", "left_semi"), "near-texts")
    payload = classes.select(F.col("class").alias("id"), "weight", "keys").join(members, "id")
    found = keep(by_block(placed.join(payload, "id").select("id", "tree", "key", "lo", "hi", "side", "weight", "keys", "text")).mapInArrow(_verify, "id long, links long, low long"), "near-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select("id").distinct(), found.select("id", "low"))
    known = keep(classes.join(links.withColumnRenamed("id", "class"), "class", "left").join(comp.withColumnRenamed("id", "class"), "class", "left").select("a", "b", "n", "class", "weight", "links", "comp"), "near-known")
    out = signed_docs.join(known, ["a", "b", "n"], "left")
    return out.select(
        "id",
        "doc_id",
        F.coalesce("class", "id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("comp", "class", "id").alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of least id of every component; of rows that repeat it one stays."""
    found = keep(linked(docs).select("id", "component_id"), "near-found")
    name = free_name("near_id", docs.columns)
    gone = found.filter("id <> component_id").select(F.col("id").alias(name)).distinct()
    left = without(docs, number(docs["doc_id"], docs["text"]), gone)
    if found.groupBy("id").count().filter("count > 1").isEmpty():
        return left
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    digest = free_name("near_digest", docs.columns)
    once = left.filter(~blank).withColumn(digest, F.md5("text")).dropDuplicates(["doc_id", digest]).drop(digest)
    return once.unionByName(left.filter(blank))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("id")


QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
