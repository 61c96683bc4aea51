"""Language identification of mixed-language text.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. The script of a word, told from the ranges of
its code points, narrows the languages it may have to those that write it. Each of them scores the word by the log-odds of its
byte trigrams and of the word itself. Viterbi over the words of a text, with a penalty for each change of language, labels spans;
the language with the most letters is the text's.

Counts are over all documents to learn from. Defined cases: a text that is null, empty or without a letter is ``und`` with score
0 and no spans; texts of any length are labelled whole; equal scores go to the language that sorts first; with nothing to learn
from every text is ``und``; a null id is never held out; repeated rows are labelled alike; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskquery.llm.store import keep
from maskquery.llm.text import ALNUM, LOWER, bounds, run_hashes, slices

GRAM_SLOTS, WORD_SLOTS = 1 << 16, 1 << 16
#: Cost of a change of language between two words, in nats, and the weight of trigrams, which overlap, against the word.
PENALTY, GRAM_WEIGHT = 8.0, 0.5
#: A language writes a script if this share of its words has it.
SCRIPT_SHARE = 0.002
UNKNOWN = "und"

#: First code points of ranges and the script they begin. Fixed values of the Unicode standard, joined where scripts mix.
SCRIPT_RANGES = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "common"),
    (0x2C00, "other"),
    (0x3000, "common"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3130, "hangul"),
    (0x3190, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0x10000, "other"),
)
SCRIPTS = tuple(dict.fromkeys(["common", *(s for _, s in SCRIPT_RANGES)]))
_SLOTS = GRAM_SLOTS + WORD_SLOTS + len(SCRIPTS) + 1  # the last counts words


def _script_table() -> np.ndarray:
    """The script of each pair of first two bytes of a character; characters of two bytes are told by them, longer ones nearly."""
    starts = np.array([a for a, _ in SCRIPT_RANGES])
    names = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES], np.uint8)
    lead, second = np.divmod(np.arange(1 << 16), 256)
    point = np.zeros(1 << 16, np.int64)
    two, three, four = (lead >= 0xC2) & (lead < 0xE0), (lead >= 0xE0) & (lead < 0xF0), lead >= 0xF0
    point[two] = ((lead & 31) << 6 | (second & 63))[two]
    point[three] = ((lead & 15) << 12 | (second & 63) << 6)[three]
    point[four] = 0x10000
    return names[np.searchsorted(starts, point, side="right") - 1]


_SCRIPT_OF = _script_table()
_LATIN = SCRIPTS.index("latin")


class _Text:
    """Words, trigram slots, word slots and scripts of a slice of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        low = LOWER[data]
        self.s, self.e, row = bounds(ALNUM[low], off)
        self.first, self.n = row[:-1], np.diff(row)
        self.of = np.repeat(np.arange(len(self.n)), self.n)
        code = low.astype(np.uint32)
        inside = ALNUM[low]
        begins, ends = np.zeros(len(low), bool), np.zeros(len(low), bool)
        begins[self.s], ends[self.e - 1] = True, True
        before, after = np.full(len(low), 32, np.uint32), np.full(len(low), 32, np.uint32)
        before[1:], after[:-1] = code[:-1], code[1:]
        before[begins], after[ends] = 32, 32
        gram = (before << 16) | (code << 8) | after
        self.gram = np.where(inside, ((gram * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32), -1)
        self.word = (run_hashes(low, self.s, self.e) >> np.uint64(48)).astype(np.int32)
        # Letters: bytes that start a character and are no digit.
        letter = inside & ((code >= 0xC0) | ((code >= 97) & (code <= 122)))
        sums = np.r_[0, np.cumsum(letter)]
        self.letters = sums[self.e] - sums[self.s]
        wide = np.flatnonzero(code >= 0xC2)
        script = np.zeros(len(low), np.uint8)
        script[wide] = _SCRIPT_OF[(code[wide] << 8 | np.r_[code[1:], np.zeros(1, np.uint32)][wide]).astype(np.int64)]
        ascii_ = np.r_[0, np.cumsum((code >= 97) & (code <= 122))]
        self.ascii = ascii_[self.e] - ascii_[self.s]
        self.script = np.maximum.reduceat(script, self.s) if len(self.s) else np.zeros(0, np.uint8)
        self.script = np.where((self.script == 0) & (self.ascii > 0), _LATIN, self.script)


@dataclass
class Model:
    """Languages in order, log-odds of slots (languages x slots) and which scripts each language writes."""

    names: tuple[str, ...]
    grams: np.ndarray
    words: np.ndarray
    writes: np.ndarray


def held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 2, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """Count slots per language over all rows of ``docs`` (``text, lang``) with both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, data, off in slices(batch):
                t = _Text(data, off)
                lang = part.column(1).to_pylist()
                code = {x: i for i, x in enumerate(dict.fromkeys(lang))}
                own = np.array([code[x] for x in lang])
                byte_of = np.repeat(own, np.diff(off))
                for x, i in code.items():
                    c = total.setdefault(x, np.zeros(_SLOTS, np.int64))
                    g = t.gram[(byte_of == i) & (t.gram >= 0)]
                    c[:GRAM_SLOTS] += np.bincount(g, minlength=GRAM_SLOTS)
                    w = own[t.of] == i
                    c[GRAM_SLOTS : GRAM_SLOTS + WORD_SLOTS] += np.bincount(t.word[w], minlength=WORD_SLOTS)
                    c[GRAM_SLOTS + WORD_SLOTS : -1] += np.bincount(t.script[w], minlength=len(SCRIPTS))
                    c[-1] += int(w.sum())
        for x, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "slot", "n"])

    usable = docs.filter("text is not null and lang is not null").select("text", "lang")
    counts = keep(usable.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "lang-counts").toArrow().to_pandas()
    names = tuple(sorted(counts["lang"].unique()))
    c = np.zeros((len(names), _SLOTS))
    if names:
        c[np.searchsorted(np.array(names, object), counts["lang"].to_numpy(object)), counts["slot"].to_numpy(np.int64)] = counts["n"]

    def odds(part: np.ndarray) -> np.ndarray:
        if not names:
            return part.astype(np.float32)
        p = np.log((part + 0.5) / (part.sum(1, keepdims=True) + 0.5 * part.shape[1]))
        return (p - p.mean(0, keepdims=True)).astype(np.float32)

    scripts = c[:, GRAM_SLOTS + WORD_SLOTS : -1]
    writes = scripts >= SCRIPT_SHARE * np.maximum(1, c[:, -1:])
    writes[:, ~writes.any(0)] = True  # a script that nobody writes narrows nothing
    return Model(names, odds(c[:, :GRAM_SLOTS]), odds(c[:, GRAM_SLOTS : GRAM_SLOTS + WORD_SLOTS]), writes)


def word_scores(t: _Text, model: Model) -> np.ndarray:
    """Words x languages; a language that doesn't write a word's script is out of reach."""
    out = np.empty((len(t.s), len(model.names)), np.float32)
    at = np.maximum(t.gram, 0)
    for k in range(len(model.names)):
        sums = np.r_[0.0, np.cumsum(np.where(t.gram >= 0, model.grams[k, at], 0), dtype=np.float64)]
        out[:, k] = GRAM_WEIGHT * (sums[t.e] - sums[t.s]) + model.words[k, t.word]
        out[~model.writes[k, t.script], k] -= 1000
    return out


def viterbi(score: np.ndarray, first: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of every word; all texts step together, the longest first."""
    langs = score.shape[1]
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    come = np.zeros((len(score), langs), np.uint8)
    best = np.zeros((len(n), langs), np.float64)
    alive = np.searchsorted(-n, -np.arange(1, int(n.max(initial=0)) + 1), side="right")  # texts with more than t words
    own = np.arange(langs, dtype=np.uint8)
    for t, live in enumerate(alive):
        at = first[:live] + t
        v = best[:live]
        top = v.argmax(1)
        jump = v[np.arange(live), top] - penalty
        leave = v < jump[:, None]
        come[at] = np.where(leave, top[:, None].astype(np.uint8), own)
        best[:live] = np.where(leave, jump[:, None], v) + score[at]
    path = np.zeros(len(score), np.uint8)
    cur = best.argmax(1) if langs else np.zeros(len(n), np.int64)
    for t in range(len(alive) - 1, -1, -1):
        live = alive[t]
        at = first[:live] + t
        path[at] = cur[:live]
        cur[:live] = come[at, cur[:live]]
    return path


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, spans``: score is the share of letters in the language's spans; spans count words from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.names, UNKNOWN], pa.string())
        for batch in batches:
            for part, data, off in slices(batch):
                t = _Text(data, off)
                rows, langs = part.num_rows, len(m.names)
                if langs:
                    path = viterbi(word_scores(t, m), t.first, t.n)
                    sums = np.bincount(t.of * langs + path, t.letters, rows * langs).reshape(rows, langs)
                    total, pred = sums.sum(1), sums.argmax(1)
                    score = sums[np.arange(rows), pred] / np.maximum(total, 1)
                else:
                    path, total, pred, score = np.zeros(len(t.s), np.uint8), np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows)
                known = total > 0
                wide = np.flatnonzero(known & (np.bincount(t.of, t.ascii, rows) == 0))  # has it a letter at all?
                for i in wide:
                    known[i] = any(c.isalpha() for c in part.column(1)[int(i)].as_py())
                pred, score = np.where(known, pred, langs), np.where(known, score, 0.0)
                # Spans: runs of one language inside a text, for texts with a language.
                cut = np.ones(len(path), bool)
                cut[1:] = (path[1:] != path[:-1]) | (t.of[1:] != t.of[:-1])
                at = np.flatnonzero(cut & known[t.of])
                end = np.r_[np.flatnonzero(cut), len(path)]
                end = end[np.searchsorted(end, at, side="right")]
                ends = pa.array(np.searchsorted(t.of[at], np.arange(rows + 1)).astype(np.int32))
                span = pa.StructArray.from_arrays([pa.array((at - t.first[t.of[at]]).astype(np.int32)), pa.array((end - t.first[t.of[at]]).astype(np.int32)), names.take(pa.array(path[at].astype(np.int32)))], ["first", "to", "lang"])
                yield pa.RecordBatch.from_arrays([part.column(0), names.take(pa.array(pred.astype(np.int32))), pa.array(score.astype(np.float64)), pa.ListArray.from_arrays(ends, span)], ["doc_id", "lang_pred", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, lang_pred string, score double, spans array<struct<first:int,to:int,lang:string>>")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 4)
    return labelled(docs, learn(docs.filter(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score", "spans")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
