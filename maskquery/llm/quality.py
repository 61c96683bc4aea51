"""Quality classifier: document evidence combined with the posteriors of its host and path.

1. Evidence. Each text gives a set of hashed features (words, word beginnings, runs of symbols, binned ratios). Over a bounded
   sample of labelled documents, in which near copies count once, a feature that tells a fault (``junk``: quality 0; ``toxic``: toxic 1) from its absence beyond
   chance has a log-likelihood ratio; a document's evidence is the sum over its features.
2. Hierarchy. Expected faults are summed per path and per host over all documents. A host's rate is shrunk towards the
   corpus's, a path's rate towards its host's, each with a strength taken from the spread between groups (method of moments):
   sparse sites lean on their parents.
3. Decision. Log-odds of the path's rate plus the evidence. A document with any fault above one half is rejected.

The host is ``source`` up to its first slash; the path is the whole ``source`` and ``lang``. Defined cases: null and empty texts
have the length feature only; null ``source`` or ``lang`` is a group of its own; labels that are null or belong to no document
are ignored, repeated labels of a document count as their maximum; with no labels every document is kept at probability 0;
repeated rows are judged alike; further columns are carried along as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskquery.llm.store import free_name, keep
from maskquery.llm.text import ALNUM, LOWER, NOT_SPACE, SLICE_BYTES, bounds, flat, gram_hashes, mix, ragged, run_hashes, signed

FAULTS = ("junk", "toxic")
FEATURE_BITS = 20
#: Lengths in bytes of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)
#: Labelled documents that features are counted on, about.
SAMPLE = 30_000
#: Least hashes by which near copies are told in the sample.
SKETCHES = 4
#: Ridge and steps of the regression.
PENALTY, STEPS = 0.5, 400
#: A feature speaks if its log ratio is beyond this many standard errors and this size.
ERRORS, LEAST = 3.0, 1.0


def _binned(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """Tenths, with nothing and all apart."""
    r = num / np.maximum(den, 1)
    return np.where(num == 0, 0, 1 + np.floor(np.minimum(r, 0.9999) * 10)).astype(np.uint64)


def features(data: np.ndarray, off: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: their slots one text after the other, and the n + 1 bounds of the texts.

    With ``only``, a flag for each slot, other slots are left out.
    """
    n = len(off) - 1
    low = LOWER[data]
    letter = ALNUM[low]
    s, e, row = bounds(letter, off)
    of = np.repeat(np.arange(n), np.diff(row))
    parts = [(of, run_hashes(low, s, e) + np.uint64(1))]
    for k in BEGINNINGS:
        long = e - s > k
        parts.append((of[long], run_hashes(low, s[long], s[long] + k) + np.uint64(2 * k)))
    s, e, row = bounds(~letter & NOT_SPACE[low], off)
    parts.append((np.repeat(np.arange(n), np.diff(row)), run_hashes(low, s, e) + np.uint64(3)))
    s, e, row = bounds(NOT_SPACE[low], off)
    of, h = np.repeat(np.arange(n), np.diff(row)), run_hashes(low, s, e)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    size, texts = np.diff(off), np.arange(n)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags)][off])

    upper, marks = per_text((data >= 65) & (data <= 90)), per_text(~letter & NOT_SPACE[low])
    ratios = (_binned(np.bincount(of, again, n), np.diff(row)), _binned(upper, per_text(letter)), _binned(marks, size), np.ceil(np.log2(size + 1.0)).astype(np.uint64))
    parts += [(texts, x + np.uint64(1000 * (k + 1))) for k, x in enumerate(ratios)]
    pairs = []
    for of, h in parts:
        slot = (mix(h) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        use = only[slot] if only is not None else slice(None)
        pairs.append((of[use].astype(np.int64) << FEATURE_BITS) | slot[use])
    pair = np.sort(np.concatenate(pairs))
    pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
    return pair & ((1 << FEATURE_BITS) - 1), np.searchsorted(pair >> FEATURE_BITS, np.arange(n + 1))


def sketches(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SKETCHES least hashes of each text's runs of five words (of all its words if it has fewer); 0 without words."""
    low = LOWER[data]
    s, e, row = bounds(ALNUM[low], off)
    h, first, n = run_hashes(low, s, e), row[:-1], np.diff(row)
    grams = np.maximum(n - 4, np.minimum(n, 1))
    g = np.r_[gram_hashes(h, 5), np.zeros(4, np.uint64)][ragged(first, grams)] if len(h) else np.zeros(0, np.uint64)
    begin = np.cumsum(grams) - grams
    short = (n > 0) & (n < 5)
    if short.any():
        g[begin[short]] = np.array([mix(np.array([int(h[a : a + k].sum())], np.uint64))[0] for a, k in zip(first[short], n[short])], np.uint64)
    out = np.zeros((len(n), SKETCHES), np.uint64)
    full = np.flatnonzero(grams)
    for k in range(SKETCHES if len(full) else 0):
        out[full, k] = np.minimum.reduceat(mix(g + np.uint64(k)), begin[full])
    return out


def _cuts(off: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, side="right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Weights:
    """Slots that speak (at most 2 ** FEATURE_BITS), their weights and the offset of each fault, and the faults' shares."""

    slots: np.ndarray
    values: np.ndarray
    offset: tuple[float, ...]
    base: tuple[float, ...]


def labels_of(labels: DataFrame) -> DataFrame:
    junk, toxic = (F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int")
    usable = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    return usable.groupBy("doc_id").agg(F.max(junk).alias("junk"), F.max(toxic).alias("toxic"))


def _drawn_rows(doc_id: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose id is among the sorted ``ids``, and where."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
    rows = np.flatnonzero((ids[at] == doc) & doc_id.is_valid().to_numpy(zero_copy_only=False))
    return rows, at[rows]


def _without_copies(docs: DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
    """The drawn documents that share no least hash with a drawn one of smaller id (the sample is bounded, so is this)."""
    shared = docs.sparkSession.sparkContext.broadcast(drawn["doc_id"].to_numpy(np.int64))
    names = [f"m{k}" for k in range(SKETCHES)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = _drawn_rows(batch.column(0), shared.value)
            taken = batch.take(pa.array(rows))
            data, off = flat(taken.column(1))
            got = [sketches(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in _cuts(off)]
            m = signed(np.concatenate([np.zeros((0, SKETCHES), np.uint64), *got]))
            yield pa.RecordBatch.from_arrays([taken.column(0), *(pa.array(m[:, k]) for k in range(SKETCHES))], ["doc_id", *names])

    seen = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, " + ", ".join(f"{m} long" for m in names)).toArrow().to_pandas()
    first = np.ones(len(seen), bool)
    for m in names:
        first &= (seen.groupby(m)["doc_id"].transform("min") == seen["doc_id"]).to_numpy()
    return drawn[drawn["doc_id"].isin(seen["doc_id"][first])]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from about ``sample`` labelled documents, drawn by a hash of the id."""
    spark = docs.sparkSession
    known = labels_of(labels)
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < F.lit(int(share * 2**63) if share < 1 else 2**63 - 1)).toArrow().to_pandas().sort_values("doc_id")
    drawn = _without_copies(docs, drawn)
    table = spark.sparkContext.broadcast((drawn["doc_id"].to_numpy(np.int64), drawn[list(FAULTS)].to_numpy(np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks = table.value
        total = np.zeros((1 + len(FAULTS), (1 << FEATURE_BITS) + 1), np.int32)  # the last slot counts documents
        for batch in batches:
            rows, at = _drawn_rows(batch.column(0), ids)
            data, off = flat(batch.column(1).take(pa.array(rows)))
            for lo, hi in _cuts(off):
                slot, ends = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                y = marks[at[lo:hi]]
                total[0] += np.bincount(slot, minlength=total.shape[1]).astype(np.int32)
                total[0, -1] += hi - lo
                for k in range(len(FAULTS)):
                    own = np.repeat(y[:, k], np.diff(ends)).astype(bool)
                    total[1 + k] += np.bincount(slot[own], minlength=total.shape[1]).astype(np.int32)
                    total[1 + k, -1] += int(y[:, k].sum())
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(t[used].astype(np.int64)) for t in total)], ["slot", "n", *FAULTS])

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "slot int, n long, " + ", ".join(f"{f} long" for f in FAULTS))
    counted = keep(counted.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("n", *FAULTS))), "quality-counts")
    whole = counted.filter(F.col("slot") == 1 << FEATURE_BITS).collect()
    n, marked = (whole[0]["n"], [whole[0][f] for f in FAULTS]) if whole else (0, [0] * len(FAULTS))

    def ratio(f: str, n1: int) -> Column:
        a, b = F.col(f) + 0.5, F.col("n") - F.col(f) + 0.5
        w = F.log(a / (n1 + 1.0)) - F.log(b / (n - n1 + 1.0))
        return F.when((F.abs(w) > ERRORS * F.sqrt(1 / a + 1 / b)) & (F.abs(w) > LEAST), w).otherwise(0.0)

    said = counted.filter(F.col("slot") < 1 << FEATURE_BITS).select("slot", *(ratio(f, n1).alias(f) for f, n1 in zip(FAULTS, marked)))
    said = said.filter(" or ".join(f"{f} != 0" for f in FAULTS)).toArrow().to_pandas().sort_values("slot")
    slots = said["slot"].to_numpy(np.int64)
    base = tuple((m + 0.5) / (n + 5.0) if n else 0.0 for m in marked)  # a handful of labels says little
    if not n or not len(slots):
        return Weights(slots, np.zeros((len(FAULTS), len(slots))), (0.0,) * len(FAULTS), base)
    spoken = spark.sparkContext.broadcast(slots)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _ = table.value
        place = np.full(1 << FEATURE_BITS, -1, np.int32)
        place[spoken.value] = np.arange(len(spoken.value))
        for batch in batches:
            rows, at = _drawn_rows(batch.column(0), ids)
            data, off = flat(batch.column(1).take(pa.array(rows)))
            for lo, hi in _cuts(off):
                slot, ends = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], place >= 0)
                row, col = np.repeat(at[lo:hi], np.diff(ends)), place[slot]
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col)], ["row", "col"])

    cells = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(gather, "row int, col int").distinct().toArrow().to_pandas()
    row, col, y = cells["row"].to_numpy(), cells["col"].to_numpy(), drawn[list(FAULTS)].to_numpy(np.float64)
    fits = [_fit(row, col, y[:, k], len(slots), said[f].to_numpy() != 0) for k, f in enumerate(FAULTS)]
    return Weights(slots, np.array([w for w, _ in fits]), tuple(b - float(np.log(p / (1 - p))) if 0 < p < 1 else 0.0 for (_, b), p in zip(fits, base)), base)


def _fit(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, usable: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on 0/1 cells, ridge PENALTY, by full-batch steps with momentum (Adam)."""
    own = usable[col]
    row, col = row[own], col[own]
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col], len(y)) + b)))
        g = np.r_[np.bincount(col, (p - y)[row], width) + PENALTY * w, (p - y).sum()] / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def evidence(spark: SparkSession, weights: Weights):
    """A column function: text to the evidence of each fault."""
    shared = spark.sparkContext.broadcast((weights.slots, weights.values, weights.offset))

    @F.arrow_udf("array<double>")
    def score(text: pa.Array) -> pa.Array:
        slots, values, offset = shared.value
        table = np.zeros((len(FAULTS), 1 << FEATURE_BITS))
        table[:, slots] = values
        speaks = (table != 0).any(0)
        data, off = flat(text)
        out = np.zeros((len(text), len(FAULTS)))
        for lo, hi in _cuts(off):
            slot, ends = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], speaks)
            for k in range(len(FAULTS)):
                out[lo:hi, k] = offset[k] + np.diff(np.r_[0.0, np.cumsum(table[k, slot])][ends])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * len(FAULTS)), pa.array(out.ravel()))

    return score


def _host() -> Column:
    return F.substring_index(F.col("source"), "/", 1)


def _strength(n: float, k: float, spread: float, squares: float, groups: int) -> float:
    """Prior observations of a group: from the spread of rates beyond what chance gives (``spread``: sum of n (rate - mean)^2)."""
    mean = k / n if n else 0.0
    chance = mean * (1 - mean)
    room = n - squares / n if n else 0.0
    between = (spread - (groups - 1) * chance) / room if room > 0 else 0.0
    return min(1e6, max(1.0, chance / between - 1)) if between > 0 else 1e6


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def site_rates(scored: DataFrame, weights: Weights) -> DataFrame:
    """``host, source, lang`` with the shrunken rate of each fault; ``scored`` has ``source, lang, said``."""
    p = [_sigmoid(_logit(F.lit(b)) + F.col("said")[k]) if b > 0 else F.lit(0.0) for k, b in enumerate(weights.base)]
    paths = scored.groupBy(_host().alias("host"), "source", "lang").agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(x).alias(f"k{i}") for i, x in enumerate(p)))
    paths = keep(paths, "quality-paths")
    sums = [F.sum("n").alias("n"), *(F.sum(f"k{i}").alias(f"k{i}") for i in range(len(FAULTS)))]
    hosts = keep(paths.groupBy("host").agg(*sums), "quality-hosts")

    def strengths(groups: DataFrame, parent: list[Column]) -> list[float]:
        """``groups`` has n, k0.. of the groups; ``parent`` the rates they lean on."""
        spread = [F.sum(F.col("n") * (F.col(f"k{i}") / F.col("n") - parent[i]) ** 2).alias(f"s{i}") for i in range(len(FAULTS))]
        r = groups.agg(*sums, F.sum(F.col("n") ** 2).alias("sq"), F.count(F.lit(1)).alias("g"), *spread).first()
        return [_strength(r["n"] or 0.0, r[f"k{i}"] or 0.0, r[f"s{i}"] or 0.0, r["sq"] or 0.0, r["g"]) for i in range(len(FAULTS))]

    total = hosts.agg(*sums).first()
    mean = [(total[f"k{i}"] or 0.0) / total["n"] if total["n"] else 0.0 for i in range(len(FAULTS))]
    a = strengths(hosts, [F.lit(m) for m in mean])
    hosts = hosts.select("host", *(((F.col(f"k{i}") + a[i] * mean[i]) / (F.col("n") + a[i])).alias(f"h{i}") for i in range(len(FAULTS))))
    both = keep(paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"]), "quality-sites")
    b = strengths(both, [F.col(f"h{i}") for i in range(len(FAULTS))])
    return keep(both.select("host", "source", "lang", *(((F.col(f"k{i}") + b[i] * F.col(f"h{i}")) / (F.col("n") + b[i])).alias(f"{f}_rate") for i, f in enumerate(FAULTS))), "quality-rates")


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with a struct column ``verdict``: the probability and site rate of each fault, and ``kept``."""
    spark = docs.sparkSession
    weights = learn(docs, labels, sample)
    said, verdict = free_name("said", docs.columns), free_name("verdict", docs.columns)
    score = evidence(spark, weights)
    rates = site_rates(keep(docs.select("source", "lang", score("text").alias("said")), "quality-evidence"), weights)
    r = rates.select(F.struct("source", "lang").alias("site"), F.struct(*(f"{f}_rate" for f in FAULTS)).alias("rate"))
    scored = docs.withColumn(said, score("text"))
    joined = scored.join(r, scored["source"].eqNullSafe(r["site"]["source"]) & scored["lang"].eqNullSafe(r["site"]["lang"]), "left")
    p = [_sigmoid(_logit(r["rate"][f"{f}_rate"]) + scored[said][k]) if weights.base[k] > 0 else F.lit(0.0) for k, f in enumerate(FAULTS)]
    fields = [x.alias(f"{f}_prob") for f, x in zip(FAULTS, p)] + [r["rate"][f"{f}_rate"].alias(f"{f}_site") for f in FAULTS] + [F.greatest(*p).__le__(0.5).alias("kept")]
    return joined.select(*(scored[c] for c in docs.columns), F.struct(*fields).alias(verdict))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    out = judged(docs, labels, sample)
    return out.filter(out[out.columns[-1]]["kept"]).select(*(out[c] for c in docs.columns))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "source", "lang", "verdict.*")


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
