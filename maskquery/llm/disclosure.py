"""Personal data and the terms that give it away.

Values of four kinds (mail and network addresses, card and phone numbers) are found by their form. Each distinct value is a
protected entity. Which other terms reveal it is estimated from the corpus: a term ``t`` that stands within ``REACH`` words of
entity ``c`` discloses ``PMI(c; t)`` bits of the ``IC(c)`` bits that ``c`` itself is worth,

    IC(c) = log2(N / contexts(c)),    PMI(c; t) / IC(c) = 1 - log2(contexts(t) / contexts(t, c)) / IC(c),

with N documents and *different* contexts as the unit, a term's or value's context being the words on its two sides, so that
copies and near copies of a document are one piece of evidence. Terms that disclose ``GENERALISE`` of an entity, and do so in
``SUPPORT`` contexts, become spans of kind ``term`` wherever they occur; ``sanitised`` puts a class in their place, and
takes out those that disclose ``REMOVE``.

The corpus is read twice: for values and the words near them, and for all places of the terms in question. What a frequent word
would ask for is cut before the second reading: its contexts near any entity are a lower bound of all its contexts.

Defined cases: a null or empty text has no spans; repeated rows each give a row; an empty table gives none; an entity in so many
contexts that IC is 0 is revealed by nothing; extra columns are ignored. Positions are code points, the end is exclusive. Terms
are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII that no value overlaps; they are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskquery.llm.slots import slot_map, within
from maskquery.llm.store import keep
from maskquery.llm.text import ALNUM, LOWER, bounds, mix, ragged, run_hashes, signed, slices

KINDS = ("email", "ip", "card", "phone", "term")
REACH = 8
SUPPORT = 3
GENERALISE, REMOVE = 0.85, 0.95


def _bytes(chars: str) -> np.ndarray:
    is_in = np.zeros(256, bool)
    is_in[list(chars.encode())] = True
    return is_in


_DIGITS = "0123456789"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGIT, LABEL, LOCAL, DIALLED = _bytes(_DIGITS), _bytes(_LETTERS + _DIGITS + "-"), _bytes(_LETTERS + _DIGITS + "._%+-"), _bytes(_DIGITS + " ().-")


class _Runs:
    """Maximal runs of a byte class, with the row of each."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray):
        self.s, self.e, first = bounds(kind[data], off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(first))

    def linked(self, data: np.ndarray, by: bytes) -> np.ndarray:
        """Whether just one byte of ``by`` parts a run from the one before."""
        out = np.zeros(len(self.s), bool)
        out[1:] = (self.s[1:] - self.e[:-1] == 1) & (self.row[1:] == self.row[:-1])
        out[1:] &= np.isin(data[self.e[:-1] % max(1, len(data))], list(by))
        return out


def _chains(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last run of every chain of linked runs."""
    head = np.flatnonzero(~linked)
    return head, np.append(head[1:], len(linked)) - 1


def _emails(data, off) -> list[tuple[int, int, int]]:
    at = np.flatnonzero(data == 64)
    if not len(at):
        return []
    local, label = _Runs(data, off, LOCAL), _Runs(data, off, LABEL)
    if not len(local.s) or not len(label.s):
        return []
    head, last = _chains(label.linked(data, b"."))
    end_of = np.repeat(last, last - head + 1)
    a = np.minimum(np.searchsorted(local.e, at), len(local.e) - 1)
    b = np.minimum(np.searchsorted(label.s, at + 1), len(label.s) - 1)
    row = np.searchsorted(off, at, side="right") - 1
    fits = (local.e[a] == at) & (local.row[a] == row) & (label.s[b] == at + 1) & (label.row[b] == row) & (end_of[b] > b)
    out, free = [], 0
    for sign, start, stop, r in zip(at[fits].tolist(), local.s[a[fits]].tolist(), label.e[end_of[b[fits]]].tolist(), row[fits].tolist()):
        start = max(start, free)  # an address may begin inside the run that the one before has left over
        if start < sign:
            out.append((r, start, stop))
            free = stop
    return out


def _ips(data, digits: _Runs) -> list[tuple[int, int, int]]:
    head, last = _chains(digits.linked(data, b"."))
    n = (last - head + 1) // 4
    first = np.repeat(head, n) + 4 * ragged(np.zeros(len(n), np.int64), n)
    out = []
    for k in first.tolist():
        parts = [data[s:e].tobytes().lstrip(b"0") for s, e in zip(digits.s[k : k + 4].tolist(), digits.e[k : k + 4].tolist())]
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
            out.append((int(digits.row[k]), int(digits.s[k]), int(digits.e[k + 3])))
    return out


def luhn(digits: bytes) -> bool:
    """Whether the check digit fits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = (d - 48) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(data, digits: _Runs) -> list[tuple[int, int, int]]:
    head, last = _chains(digits.linked(data, b" -"))
    sums = np.concatenate([[0], np.cumsum(digits.e - digits.s)])
    n = sums[last + 1] - sums[head]
    out = []
    for k in np.flatnonzero((n >= 14) & (n <= 19)).tolist():
        s, e = int(digits.s[head[k]]), int(digits.e[last[k]])
        if luhn(bytes(x for x in data[s:e].tobytes() if 48 <= x <= 57)):
            out.append((int(digits.row[head[k]]), s, e))
    return out


def _phones(data, off) -> list[tuple[int, int, int]]:
    plus = np.flatnonzero(data == 43)
    if not len(plus):
        return []
    runs, at = _Runs(data, off, DIALLED), np.flatnonzero(DIGIT[data])
    if not len(at):
        return []
    k = np.minimum(np.searchsorted(runs.s, plus + 1), len(runs.s) - 1)
    row = np.searchsorted(off, plus, side="right") - 1
    fits = (runs.s[k] == plus + 1) & (runs.row[k] == row) & DIGIT[data[np.minimum(plus + 1, len(data) - 1)]]
    plus, row, stop = plus[fits], row[fits], runs.e[k[fits]]
    last = at[np.searchsorted(at, stop) - 1]
    n = np.searchsorted(at, last, side="right") - np.searchsorted(at, plus)
    good = (last >= plus + 3) & (n >= 10) & (n <= 15)
    return list(zip(row[good].tolist(), plus[good].tolist(), (last[good] + 1).tolist()))


def base_spans(data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(row, start, kind, end)`` of the values in flat bytes, sorted; positions are bytes. ``off`` are the rows' bounds."""
    if not len(data):
        return []
    digits = _Runs(data, off, DIGIT)
    found = [_emails(data, off), _ips(data, digits) if len(digits.s) else [], _cards(data, digits) if len(digits.s) else [], _phones(data, off)]
    return sorted((row, s, kind, e) for kind, spans in enumerate(found) for row, s, e in spans)


def entity(kind: int, value: bytes) -> int:
    """The key of a protected value: its kind and its characters, letters in lower case, numbers without what parts their digits."""
    plain = value.lower() if kind == 0 else value if kind == 1 else bytes(x for x in value if 48 <= x <= 57)
    return int.from_bytes(hashlib.blake2b(bytes([kind]) + plain, digest_size=8).digest(), "little", signed=True)


class _Slice:
    """The values and the free terms of some texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.spans = base_spans(data, off)
        low = LOWER[data]
        s, e, first = bounds(ALNUM[low], off)
        self.row_of_span, self.s, self.kind, self.e = (np.array(x, np.int64) for x in (zip(*self.spans) if self.spans else ([], [], [], [])))
        taken = np.zeros(len(s) + 1, np.int64)
        np.add.at(taken, np.searchsorted(e, self.s, side="right"), 1)
        np.add.at(taken, np.searchsorted(s, self.e), -1)
        free = np.cumsum(taken[:-1]) <= 0 if len(self.spans) else np.ones(len(s), bool)
        self.ws, self.we = s[free], e[free]
        self.first = np.searchsorted(self.ws, off)
        self.word = run_hashes(low, self.ws, self.we)
        # the words on both sides; none at the ends of a row
        n = len(self.word)
        before, after = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        before[1:n], after[: n - 1] = self.word[: n - 1], self.word[1:]
        before[self.first[:-1]] = 0
        after[np.maximum(self.first[1:], 1) - 1] = 0
        self.context = mix(before[:n] * np.uint64(0x9E3779B97F4A7C15) + after[:n])
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.point = lambda at, row: points[at] - points[off[row]]
        self.data = data

    def near(self) -> tuple[np.ndarray, ...]:
        """Per value and word near it: the value's place in the list of spans, the word's place."""
        at = np.searchsorted(self.ws, self.s)
        lo = np.maximum(at - REACH, self.first[self.row_of_span])
        hi = np.minimum(at + REACH, self.first[self.row_of_span + 1])
        return np.repeat(np.arange(len(at)), hi - lo), ragged(lo, hi - lo)

    def entities(self) -> np.ndarray:
        raw = self.data.tobytes() if self.spans else b""
        return np.array([entity(k, raw[s:e]) for _, s, k, e in self.spans], np.int64)

    def side_words(self) -> np.ndarray:
        """The context of each value."""
        at = np.searchsorted(self.ws, self.s)
        has_l, has_r = at > self.first[self.row_of_span], at < self.first[self.row_of_span + 1]
        word = np.append(self.word, np.uint64(0))
        return mix(np.where(has_l, word[at - 1], np.uint64(0)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(has_r, word[np.minimum(at, len(self.word))], np.uint64(0)))


def _lists(row: np.ndarray, n: int, columns: list[tuple[np.ndarray, pa.DataType]]) -> list[pa.Array]:
    ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(c, kind)) for c, kind in columns]


def _span_columns(x: _Slice, n: int) -> list[pa.Array]:
    where = x.row_of_span
    return _lists(where, n, [(x.kind, pa.int32()), (x.point(x.s, where), pa.int32()), (x.point(x.e, where), pa.int32())])


_SPANS = "kind array<int>, start array<int>, stop array<int>"


def value_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): the values, and for each value and word near it entity, entity's context, term and term's context."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "kind", "start", "stop", "entity", "entity_context", "term", "term_context"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch):
                x, n = _Slice(data, off), part.num_rows
                value, word = x.near()
                near = [(x.entities()[value], pa.int64()), (signed(x.side_words())[value], pa.int64()), (signed(x.word)[word], pa.int64()), (signed(x.context)[word], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *_span_columns(x, n), *_lists(x.row_of_span[value], n, near)], names)

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, {_SPANS}, entity array<long>, entity_context array<long>, term array<long>, term_context array<long>")


def candidates(values: DataFrame, n_docs: int) -> DataFrame:
    """``term, ic, both``: per entity and term near it the entity's bits and the contexts they share, as far as the term's contexts near
    entities let it reach the threshold."""
    near = keep(values.select(F.explode(F.arrays_zip("entity", "entity_context", "term", "term_context")).alias("n")).select("n.*").distinct(), "disclosure-near")
    worth = near.select("entity", "entity_context").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    worth = worth.select("entity", F.log2(F.lit(float(n_docs)) / F.col("n")).alias("ic")).where("ic > 0")
    pairs = near.select("entity", "term", "term_context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= SUPPORT)
    least = near.select("term", "term_context").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("contexts"))
    pairs = pairs.join(worth, "entity").join(least, "term")
    return pairs.where(disclosed() >= GENERALISE).select("term", "ic", "both")


def disclosed() -> Column:
    """The share of the entity's bits that a term discloses."""
    return 1 - F.log2(F.col("contexts") / F.col("both")) / F.col("ic")


def term_places(docs: DataFrame, terms: DataFrame, carry_text: bool) -> DataFrame:
    """Per row of ``docs``: the values, and all places of terms that may be among ``terms``, with their contexts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(slot_map(terms))
    names = ["doc_id", *(["text"] if carry_text else []), "kind", "start", "stop", "term", "context", "term_start", "term_stop"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for part, data, off in slices(batch):
                x, n = _Slice(data, off), part.num_rows
                at = np.flatnonzero(within(bits, signed(x.word)))
                row = np.searchsorted(x.first, at, side="right") - 1
                found = [(signed(x.word)[at], pa.int64()), (signed(x.context)[at], pa.int64()), (x.point(x.ws[at], row), pa.int32()), (x.point(x.we[at], row), pa.int32())]
                head = [part.column(0), part.column(1)] if carry_text else [part.column(0)]
                yield pa.RecordBatch.from_arrays([*head, *_span_columns(x, n), *_lists(row, n, found)], names)

    text = "text string, " if carry_text else ""
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, {text}{_SPANS}, term array<long>, context array<long>, term_start array<int>, term_stop array<int>")


def found(docs: DataFrame, carry_text: bool = False) -> DataFrame:
    """``doc_id``, with ``carry_text`` the text, and ``spans``: an array of ``start, kind, stop, share`` by start and kind; ``share`` is what a
    term discloses, 1 for a value."""
    values = keep(value_spans(docs), "disclosure-values")
    terms = keep(candidates(values, values.count()), "disclosure-terms")
    places = keep(term_places(docs, terms.select("term").distinct(), carry_text).withColumn("row", F.monotonically_increasing_id()), "disclosure-places")
    hits = places.where(F.size("term") > 0).select("row", F.explode(F.arrays_zip("term", "context", "term_start", "term_stop")).alias("t")).select("row", "t.*")
    counts = hits.select("term", "context").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("contexts"))
    telling = terms.join(counts, "term").groupBy("term").agg(F.max(disclosed()).alias("share")).where(F.col("share") >= GENERALISE)
    span = lambda start, kind, stop, share: F.struct(start.alias("start"), kind.alias("kind"), stop.alias("stop"), share.alias("share"))
    more = hits.join(keep(telling, "disclosure-telling"), "term").groupBy("row").agg(F.collect_list(span(F.col("term_start"), F.lit(KINDS.index("term")), F.col("term_stop"), F.col("share"))).alias("more"))
    base = F.transform(F.arrays_zip("start", "kind", "stop"), lambda s: span(s["start"], s["kind"], s["stop"], F.lit(1.0)))
    out = ["doc_id", *(["text"] if carry_text else [])]
    bare = places.where(F.size("term") == 0).select(*out, base.alias("spans"))
    rest = places.where(F.size("term") > 0).join(more, "row", "left")
    return bare.unionByName(rest.select(*out, F.when(F.col("more").isNull(), base).otherwise(F.array_sort(F.concat(base, "more"))).alias("spans")))


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def digests(spans: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the values and all spans, in text form."""
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    return spans.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(len(KINDS))],
        F.sha2(_shown(F.filter("spans", lambda s: s["kind"] < KINDS.index("term"))), 256).alias("base_sha256"),
        _shown(F.col("spans")).alias("spans"),
    )


def cleaned(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """A text without what its spans (start, kind, end, share; by start) give away."""
    out, done = [], 0
    for start, kind, stop, share in spans:
        if start < done:  # a value inside another: what sticks out goes too
            done = max(done, stop)
            continue
        term = text[start:stop]
        if kind < KINDS.index("term"):
            new = f"[{KINDS[kind]}]"
        elif share >= REMOVE:
            new = ""
        else:
            new = "[number]" if term.isdigit() else "[name]" if term[:1].isupper() else "[term]"
        out += [text[done:start], new]
        done = stop
    return "".join(out) + text[done:]


def sanitised(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with values replaced by their kind, telling terms by a class or by nothing. A null text stays null."""

    @F.udf("string")
    def clean(text, spans):
        return text if text is None else cleaned(text, [tuple(s) for s in spans])

    whole = found(docs, carry_text=True)
    return whole.select("doc_id", F.when(F.size("spans") > 0, clean("text", "spans")).otherwise(F.col("text")).alias("text"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(found(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op12_pii": op12_pii}
ORACLES: dict[str, str] = {}
