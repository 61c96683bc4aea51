"""Benchmark decontamination by winnowing.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. Every window of ``span`` words holds
``span - gram + 1`` grams of ``gram`` words and names the one with the least hash as its fingerprint, so any shared span of
``span`` words has the same fingerprint on both sides. Fingerprints of documents that meet a fingerprint of the benchmark are
extended to the windows around them, and windows are joined as text.

Defined cases: a null or wordless text has no words; an item of fewer than ``span`` words is one window of its own length and
one without words has none; repeated rows each give a row; an empty benchmark contaminates nothing; columns of the caller are
read by name only, and none of them is carried along unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskquery.llm.slots import without
from maskquery.llm.store import free_name, keep
from maskquery.llm.text import ALNUM, LOWER, bounds, gram_hashes, ragged, run_hashes, signed, slices

GRAM, SPAN = 5, 10
#: Slots of the map of benchmark fingerprints that goes to every task: 2 MB, whatever the benchmark's size.
MAP_BITS = 24

_WINDOWS = "key binary, word_at array<int>, size array<int>, window array<string>"


def _window_texts(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[str]:
    """The words ``first..last`` (both included) of each window, with one space between them."""
    raw = data.tobytes()
    s, e = s.tolist(), e.tolist()
    return [b" ".join(raw[s[i] : e[i]] for i in range(a, b + 1)).decode() for a, b in zip(first.tolist(), last.tolist())]


def _fingerprints(h: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of SPAN words: the index of its first word and its fingerprint."""
    grams = gram_hashes(h, GRAM)
    width = SPAN - GRAM + 1
    m = len(h) - SPAN + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:m].copy()
    for i in range(1, width):
        np.minimum(least, grams[i : i + m], out=least)
    at = ragged(first, np.maximum(n - SPAN + 1, 0))
    return at, least[at]


def _short(h: np.ndarray, n: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words and hashes of all runs of ``size`` words, for items shorter than SPAN."""
    at = ragged(first, np.maximum(n - size + 1, 0))
    return at, gram_hashes(h, size)[at] if len(at) else np.zeros(0, np.uint64)


def _words(data: np.ndarray, off: np.ndarray):
    low = LOWER[data]
    s, e, row = bounds(ALNUM[low], off)
    return low, s, e, row[:-1], np.diff(row)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, size, print, window``: every window of every item with its fingerprint."""
    kind = benchmark.schema["item_id"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch):
                low, s, e, first, n = _words(data, off)
                h = run_hashes(low, s, e)
                at, got = _fingerprints(h, n, first)
                row = np.searchsorted(first + n, at, side="right")
                found = [(row, at, got, np.full(len(at), SPAN))]
                for size in range(1, SPAN):
                    own = np.flatnonzero(n == size)
                    if len(own):
                        found.append((own, first[own], gram_hashes(h, size)[first[own]], np.full(len(own), size)))
                row, at, got, size = (np.concatenate(x) for x in zip(*found))
                texts = _window_texts(low, s, e, at, at + size - 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(size.astype(np.int32)), pa.array(signed(got)), pa.array(texts, pa.string())], ["item_id", "size", "print", "window"])

    return benchmark.select("item_id", "text").mapInArrow(read, f"item_id {kind.simpleString()}, size int, print long, window string")


def _print_map(windows: DataFrame) -> tuple[bytes, list[int]]:
    """A bitmap of the hashed fingerprints (fixed size) and the window sizes under SPAN that occur (nine at most)."""
    rows = windows.select(F.shiftrightunsigned("print", 64 - MAP_BITS).cast("int").alias("slot"))
    rows = rows.select(F.shiftright("slot", 3).alias("byte"), F.expr("shiftleft(1, slot & 7)").alias("bit"))
    rows = rows.groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    got = rows.toArrow().to_pandas()
    bits[got["byte"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    sizes = [r[0] for r in windows.filter(F.col("size") < SPAN).select("size").distinct().collect()]
    return bits.tobytes(), sorted(sizes)


def document_windows(docs: DataFrame, prints: bytes, sizes: list[int]) -> DataFrame:
    """One row per row of ``docs``: its first column, the number of its words, and the windows that meet the benchmark's fingerprints."""
    first_col = docs.schema[0]
    shared = docs.sparkSession.sparkContext.broadcast(prints)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)

        def meets(got: np.ndarray) -> np.ndarray:
            slot = got >> np.uint64(64 - MAP_BITS)
            return np.flatnonzero((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)

        for batch in batches:
            for part, data, off in slices(batch):
                low, s, e, first, n = _words(data, off)
                h = run_hashes(low, s, e)
                at, got = _fingerprints(h, n, first)
                hit = meets(got)
                found = [(at[hit], np.full(len(hit), SPAN))]
                for size in sizes:
                    at, got = _short(h, n, first, size)
                    hit = meets(got)
                    found.append((at[hit], np.full(len(hit), size)))
                at, size = (np.concatenate(x) for x in zip(*found))
                row = np.searchsorted(first + n, at, side="right")
                order = np.argsort(row, kind="stable")
                at, size, row = at[order], size[order], row[order]
                ends = pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32))
                lists = [pa.array((at - first[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(_window_texts(low, s, e, at, at + size - 1), pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), *(pa.ListArray.from_arrays(ends, x) for x in lists)], [first_col.name, "n_words", "word_at", "size", "window"])

    out = f"`{first_col.name}` {first_col.dataType.simpleString()}, n_words long, word_at array<int>, size array<int>, window array<string>"
    return docs.mapInArrow(read, out)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs`` (``doc_id, text``)."""
    windows = keep(item_windows(benchmark), "decon-items")
    prints, sizes = _print_map(windows)
    per_doc = keep(document_windows(docs.select("doc_id", "text"), prints, sizes).withColumn("row", F.monotonically_increasing_id()), "decon-docs")
    spread = per_doc.select("row", F.explode(F.arrays_zip("word_at", "size", "window")).alias("w")).select("row", "w.*")
    known = keep(windows.groupBy("window").agg(F.min("size").alias("size")).drop("size"), "decon-windows")
    hits = keep(spread.join(known, "window"), "decon-hits")
    # Words inside occurring windows: sweep over the sorted occurrences of a row.
    ends = F.transform(F.array_sort(F.collect_list(F.struct("word_at", "size"))), lambda w: F.struct(w["word_at"].alias("a"), (w["word_at"] + w["size"]).alias("b")))
    total = F.aggregate(
        ends,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, w: F.struct((acc["n"] + F.greatest(F.lit(0), w["b"] - F.greatest(acc["to"], w["a"]))).alias("n"), F.greatest(acc["to"], w["b"]).alias("to")),
    )["n"]
    counts = hits.groupBy("row").agg(total.cast("long").alias("n_hit"))
    owners = keep(windows.select("window", "item_id").distinct(), "decon-owners")
    met = keep(hits.select("row", "window").distinct(), "decon-met").join(owners, "window").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    items = met.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    out = per_doc.select("row", "doc_id", "n_words").join(counts.join(items, "row", "left"), "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns.

    Decisions are joined by the text's digest, so rows that share a text share the decision and no row is dropped twice.
    """
    digest = F.md5(F.coalesce("text", F.lit("")))
    name = free_name("text_digest", docs.columns)
    windows = keep(item_windows(benchmark), "decon-items")
    prints, sizes = _print_map(windows)
    found = document_windows(docs.select(digest.alias("doc_id"), "text"), prints, sizes).select("doc_id", F.explode("window").alias("window"))
    known = keep(windows.select("window").distinct(), "decon-windows")
    bad = keep(keep(found, "decon-found").join(known, "window", "left_semi").select(F.col("doc_id").alias(name)).distinct(), "decon-bad")
    return without(docs, F.md5(F.coalesce(docs["text"], F.lit(""))), bad)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
occ AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS t
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, size, item_id FROM occ JOIN win USING (t, size)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op7_benchmark_decontamination": op7_benchmark_decontamination}
ORACLES = {"op7_benchmark_decontamination": SQL}
