"""Ranked lexical search of many items at once over all documents, by sharing what the items have in common.

The terms of an item are put in one order for all items (frequent terms first, terms of the same items side by side), and
term sets that several items share are mined as a grammar of neighbours (``grammar.compress``). Its rules form a DAG: a node is
a set of terms, and the score that a document gets from it, its partial accumulator, is the sum of two earlier nodes. Tasks
work on blocks of documents: each node's accumulators are computed once and every item adds up the few nodes it consists of.
All figures are integers, so the order of the additions does not matter.

Documents are read once per block of items, which holds ``BLOCK_TERMS`` terms at most (or one item) and is the only thing that
goes to every task. What a task hands on is ten documents per item; ranks merge them in two steps, so no item's rows meet
in one task before they are ten per part.

Defined cases: a null or wordless text has no terms, is never a result and no item; repeated rows of documents each rank, repeated rows of items each have
results of their own; equal scores rank by ascending ``doc_id``, null first; with no documents or no items there are no rows; other
columns are ignored. Terms are told apart by two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskquery.llm.grammar import compress
from maskquery.llm.store import keep
from maskquery.llm.text import ALNUM, LOWER, bounds, run_hashes, signed, slices

TOP = 10
B_PERCENT = 75
BLOCK_TERMS = 1 << 17
#: Entries of the matrices of nodes by documents that a task holds at once (8 bytes each).
CELLS = 1 << 22
#: Parts in which the first step of ranking merges the tasks' results.
PARTS = 256

_NULL = np.iinfo(np.int64).min
_PLAN = "h0 array<long>, h1 array<long>, atom_term array<int>, atom_times array<int>, left array<int>, right array<int>, rounds array<int>, seq array<int>, first array<int>"
_SLICE = "doc_id array<long>, n array<int>, ends array<int>, term array<int>, tf array<int>, df_term array<int>, df array<int>, with_terms long, all_terms long"


def _terms(data: np.ndarray, off: np.ndarray):
    """Both hashes of all terms, and the index of each row's first term (n + 1)."""
    low = LOWER[data]
    s, e, first = bounds(ALNUM[low], off)
    return run_hashes(low, s, e, 0), run_hashes(low, s, e, 1), first


def query_plan(h0: np.ndarray, h1: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """The DAG of a block of items (none of them empty), given the hashes of their terms: the terms, the atoms (a term so many times), rules, and each item's nodes."""
    both = np.stack([h0, h1], axis=1)
    vocabulary, term = np.unique(both, axis=0, return_inverse=True)
    term = term.ravel()
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs, times = np.unique(row * len(vocabulary) + term, return_counts=True)
    row, term = pairs // len(vocabulary), pairs % len(vocabulary)
    atoms, atom = np.unique(term * (int(times.max()) + 1) + times, return_inverse=True)
    # frequent atoms first; atoms of the same items get the same sum of item hashes and stand side by side
    count = np.bincount(atom, minlength=len(atoms))
    mark = np.zeros(len(atoms), np.uint64)
    np.add.at(mark, atom, (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    place = np.empty(len(atoms), np.int64)
    place[np.lexsort((np.arange(len(atoms)), mark, -count))] = np.arange(len(atoms))
    order = np.lexsort((place[atom], row))
    g = compress(atom[order], np.searchsorted(row, np.arange(len(first))), len(atoms))
    small = lambda x: np.asarray(x, np.int32)
    return {
        "h0": signed(vocabulary[:, 0].copy()), "h1": signed(vocabulary[:, 1].copy()),
        "atom_term": small(atoms // (int(times.max()) + 1)), "atom_times": small(atoms % (int(times.max()) + 1)),
        "left": small(g.left), "right": small(g.right), "rounds": small(g.rounds), "seq": small(g.seq), "first": small(g.first),
    }


def _one_row(values: dict[str, np.ndarray]) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in values.values()]


def item_plans(items: DataFrame) -> DataFrame:
    """One row per block of items: ``item_id`` of each and the block's DAG. Tasks cut their own items into blocks."""
    kind = items.schema["item_id"].dataType
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            h0, h1, n = (np.concatenate(x) for x in zip(*parts))
            plan = query_plan(h0, h1, np.concatenate([[0], np.cumsum(n)]))
            own = pa.concat_arrays(ids)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *_one_row(plan)], ["item_id", *plan])
            ids.clear()
            parts.clear()

        held = 0
        for batch in batches:
            for part, data, off in slices(batch, limit=4 * BLOCK_TERMS):
                h0, h1, first = _terms(data, off)
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                if held and held + len(h0) > BLOCK_TERMS:
                    yield from block()
                    held = 0
                ids.append(part.column(0).take(pa.array(some)))
                parts.append((h0, h1, np.diff(first)[some]))
                held += len(h0)
        yield from block()

    tasks = max(1, -(-size // (16 * BLOCK_TERMS)))
    return items.select("item_id", "text").repartition(tasks).mapInArrow(read, f"item_id array<{kind.simpleString()}>, {_PLAN}")


def postings(docs: DataFrame, plan: dict[str, np.ndarray]) -> DataFrame:
    """One row per slice of documents: how often each holds the plan's terms, how many terms it has, and the slice's document counts."""
    shared = docs.sparkSession.sparkContext.broadcast((plan["h0"].view(np.uint64), plan["h1"].view(np.uint64)))
    names = [c.split()[0] for c in _SLICE.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v0, v1 = shared.value
        twice = bool((v0[1:] == v0[:-1]).any())
        for batch in batches:
            for part, data, off in slices(batch):
                h0, h1, first = _terms(data, off)
                n = np.diff(first)
                at = np.minimum(np.searchsorted(v0, h0), len(v0) - 1)
                if twice:  # two terms of the items share their first hash
                    at = np.where(v1[at] == h1, at, np.minimum(at + 1, len(v0) - 1))
                hit = np.flatnonzero((v0[at] == h0) & (v1[at] == h1))
                row = np.searchsorted(first, hit, side="right") - 1
                pairs, tf = np.unique(row * len(v0) + at[hit], return_counts=True)
                term = pairs % len(v0)
                df_term, df = np.unique(term, return_counts=True)
                ids = part.column(0).fill_null(int(_NULL)).to_numpy(zero_copy_only=False)
                small = lambda x: np.asarray(x, np.int32)
                lists = {"doc_id": ids, "n": small(n), "ends": small(np.searchsorted(pairs // len(v0), np.arange(1, len(n) + 1))), "term": small(term), "tf": small(tf), "df_term": small(df_term), "df": small(df)}
                yield pa.RecordBatch.from_arrays([*_one_row(lists), pa.array([int((n > 0).sum())], pa.int64()), pa.array([len(h0)], pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, _SLICE)


def document_scores(plan: dict[str, np.ndarray], weight: np.ndarray, m: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Scores of all items of a plan (rows) for some documents (columns): every node's accumulators once, then each item's sum of nodes."""
    row = np.repeat(np.arange(len(m)), np.diff(np.concatenate([[0], ends])))
    own = np.zeros((len(weight), len(m)), np.int64)
    own[term, row] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
    atoms = len(plan["atom_term"])
    nodes = np.empty((atoms + len(plan["left"]), len(m)), np.int64)
    np.multiply(own[plan["atom_term"]], plan["atom_times"][:, None], out=nodes[:atoms])
    lo = 0
    for hi in plan["rounds"].tolist():
        np.add(nodes[plan["left"][lo:hi]], nodes[plan["right"][lo:hi]], out=nodes[atoms + lo : atoms + hi])
        lo = hi
    return np.add.reduceat(nodes[plan["seq"]], plan["first"][:-1], axis=0)


class _Best:
    """The ``TOP`` best documents of each item so far."""

    def __init__(self, items: int):
        self.items = items
        self.item = self.doc = self.score = np.zeros(0, np.int64)
        self.least = np.ones(items, np.int64)

    def add(self, doc: np.ndarray, scores: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        item, doc, score = np.concatenate([self.item, item]), np.concatenate([self.doc, doc[at]]), np.concatenate([self.score, scores[item, at]])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        begin = np.searchsorted(item, np.arange(self.items))
        top = np.arange(len(item)) - begin[item] < TOP
        self.item, self.doc, self.score = item[top], doc[top], score[top]
        n = np.bincount(self.item, minlength=self.items)
        full = np.flatnonzero(n == TOP)
        self.least[full] = self.score[np.searchsorted(self.item, full, side="right") - 1]


def _best_of_tasks(slices_: DataFrame, plan: dict[str, np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """``item, doc_id, score``: the best documents of each task for each item of the plan."""
    shared = slices_.sparkSession.sparkContext.broadcast((plan, weight))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight = shared.value
        best = _Best(len(plan["first"]) - 1)
        step = max(1, CELLS // (len(weight) + len(plan["atom_term"]) + len(plan["left"]) + len(plan["seq"]) + len(plan["first"])))
        for batch in batches:
            for k in range(batch.num_rows):
                doc, n, ends, term, tf = (batch.column(i)[k].values.to_numpy().astype(np.int64) for i in range(5))
                m = 100 - B_PERCENT + (B_PERCENT * n * n_docs) // n_terms
                for lo in range(0, len(doc), step):
                    a, b = (int(ends[lo - 1]) if lo else 0), int(ends[min(lo + step, len(doc)) - 1])
                    if b > a:
                        best.add(doc[lo : lo + step], document_scores(plan, weight, m[lo : lo + step], ends[lo : lo + step] - a, term[a:b], tf[a:b]))
        doc_id = pa.array(best.doc, mask=best.doc == _NULL)
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), doc_id, pa.array(best.score)], ["item", "doc_id", "score"])

    return slices_.select("doc_id", "n", "ends", "term", "tf").mapInArrow(read, "item int, doc_id long, score long")


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """The weight of each term from the number of documents that hold it."""
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ten best documents of every item with terms."""
    spark = docs.sparkSession
    plans = keep(item_plans(items).withColumn("block", F.monotonically_increasing_id()), "search-plans")
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for row in plans.select("block").toLocalIterator():
        mine = plans.where(F.col("block") == row[0])
        got = mine.drop("block", "item_id").toArrow()
        plan = {c: got[c][0].values.to_numpy() for c in got.column_names}
        parts = keep(postings(docs, plan), "search-postings")
        n_docs, n_terms = parts.agg(F.sum("with_terms"), F.sum("all_terms")).first()
        if not n_docs:
            break
        counts = parts.select(F.explode(F.arrays_zip("df_term", "df")).alias("c")).groupBy("c.df_term").agg(F.sum("c.df").alias("df")).toArrow()
        df = np.zeros(len(plan["h0"]), np.int64)
        df[counts["df_term"].to_numpy()] = counts["df"].to_numpy()
        best = _best_of_tasks(parts, plan, weights(n_docs, df), n_docs, n_terms)
        order = [F.desc("score"), F.col("doc_id")]
        best = best.withColumn("part", F.spark_partition_id() % PARTS)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= TOP)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= TOP)
        names = mine.select(F.posexplode("item_id").alias("item", "item_id"))
        out = out.unionByName(keep(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), "search-ranks"))
    return out


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (
  SELECT i, item_id, term, count(*) AS times FROM (
    SELECT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)) GROUP BY i, item_id, term),
s AS (SELECT count(*) AS n, sum(len(t)) AS l FROM d WHERE len(t) > 0),
p AS (
  SELECT r, doc_id, term, 25 + (75 * n_own * s.n) // s.l AS m, count(*) AS tf
  FROM (SELECT r, doc_id, len(t) AS n_own, unnest(t) AS term FROM d), s WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, term, m),
w AS (SELECT term, CAST(floor(1000 * ln((2.0e0 * any_value(s.n) + 2) / (2.0e0 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
c AS (
  SELECT i, item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) GROUP BY i, item_id, doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM c WHERE score > 0) WHERE rank <= 10
"""

QUERIES = {"op13_ranked_lexical_search": op13_ranked_lexical_search}
ORACLES = {"op13_ranked_lexical_search": SQL}
