"""Byte-level subword merges: texts to ids and back.

The words of many texts are merged together: their symbols lie in one flat array, each round looks every neighbouring pair up
by binary search over the sorted pair keys, and merges each word's pair of lowest rank wherever it stands. Words that have no
pair left drop out. A word is encoded once per task (a bounded cache keeps the ids).

Defined cases: a null or empty text has no ids; the vocabulary's special strings inside a text become their own ids, as the
public library does; a text of any length is one row; ids that spell no valid UTF-8 decode with replacement characters;
repeated rows each give a row; an empty table gives an empty table; other columns of the caller are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from maskquery.llm.text import ragged, slices

VOCABULARY = "byte_bpe_50k.json"
#: What bounds a worker's memory: the words it remembers, and the bytes of text that it encodes at once.
CACHE_WORDS, AT_ONCE = 150_000, 1 << 19


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next free one from 256 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


class Merges:
    """A byte-level vocabulary file with the tables that encoding and decoding need."""

    #: Words of this vocabulary family. Fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        spelled = [b""] * self.size
        for token, i in vocab.items():
            spelled[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        whole = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.whole = keys[order], order.astype(np.int32), whole
        self.none = np.int32(len(merges))
        self.bytes_flat, self.bytes_at = _joined(spelled)
        self.text_flat, self.text_at = _joined([b"%d," % i for i in range(self.size)])
        self.words = regex.compile(self.PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._library_path = path
        self._library = None
        self.sure: set[str] = set()  # letters beyond ASCII that this interpreter's Unicode tables know
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids_flat, self.ids_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], self.none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and the n + 1 bounds of the words. No word is empty."""
        flat, at = _joined(words)
        sym = self.byte_id[flat]
        length = np.diff(at)
        word = np.repeat(np.arange(len(words), dtype=np.int32), length)
        rank = np.full(len(sym), self.none, np.int32)  # of the pair that starts here
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._pair_ranks(sym[inner], sym[inner + 1])
        done_sym, done_word = [], []
        while len(sym):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[begin, len(sym)])
            least = np.minimum.reduceat(rank, begin)
            live = least < self.none
            if not live.all():
                over = np.repeat(~live, count)
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank = sym[~over], word[~over], rank[~over]
                if not len(sym):
                    break
                count, least = count[live], least[live]
            hit = rank == np.repeat(least, count)
            at = np.flatnonzero(hit)
            # In a run of overlapping equal pairs every second one merges.
            fresh = np.r_[True, np.diff(at) > 1]
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            sym[at] = self.whole[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))
            sym, word, rank = sym[stay], word[stay], rank[stay]
            near = np.zeros(len(sym), bool)
            near[at] = True
            near[at[at > 0] - 1] = True
            touched = np.flatnonzero(near)
            inner = touched[touched < len(sym) - 1]
            same = word[inner] == word[inner + 1]
            rank[touched] = self.none
            inner = inner[same]
            rank[inner] = self._pair_ranks(sym[inner], sym[inner + 1])
        sym, word = np.concatenate([*done_sym, sym]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def _has_unknown(self, text: str) -> bool:
        fresh = set(text) - self.sure
        known = {c for c in fresh if unicodedata.category(c) != "Cn"}
        self.sure |= known
        return len(known) < len(fresh)

    def split(self, text: str) -> list[str]:
        """The words of a text that holds no special string."""
        if not text.isascii() and self._has_unknown(text):  # newer letters are classed by the public library
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self._library_path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.words.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the n + 1 bounds of the texts."""
        if len(self.index) > CACHE_WORDS:
            self._forget()
        pieces, ends = [], [0]
        for text in texts:
            if self.cut is not None and "<" in text and self.cut.search(text):
                for part in self.cut.split(text):
                    pieces.extend([part] if part in self.special else self.split(part) if part else [])
            else:
                pieces.extend(self.split(text))
            ends.append(len(pieces))
        index = self.index
        fresh = [p for p in dict.fromkeys(pieces) if p not in index]
        if fresh:
            ordinary = [p for p in fresh if p not in self.special]
            ids, at = self.merge([p.encode() for p in ordinary])
            extra = [self.special[p] for p in fresh if p in self.special]
            base = self.ids_at[-1]
            self.ids_flat = np.concatenate([self.ids_flat, ids, np.array(extra, np.int32)])
            self.ids_at = np.concatenate([self.ids_at, base + at[1:], base + at[-1] + 1 + np.arange(len(extra))])
            n = len(index)
            index.update(zip([*ordinary, *(p for p in fresh if p in self.special)], range(n, n + len(fresh))))
        which = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        start, length = self.ids_at[which], self.ids_at[which + 1] - self.ids_at[which]
        upto = np.r_[0, np.cumsum(length)]
        return self.ids_flat[ragged(start, length)], upto[np.array(ends)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids."""
        raw, ends = _spell(self.bytes_flat, self.bytes_at, ids, at)
        raw = raw.tobytes()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def decimals(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The ids of each run in decimal, joined by commas."""
        raw, ends = _spell(self.text_flat, self.text_at, ids, at)
        raw = raw.tobytes()
        return [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=at[1:])
    return np.frombuffer(b"".join(parts), np.uint8), at


def _spell(flat: np.ndarray, flat_at: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, length = flat_at[ids], flat_at[ids + 1] - flat_at[ids]
    return flat[ragged(start, length)], np.r_[0, np.cumsum(length)][at]


_loaded: dict[str, Merges] = {}


def merges(name: str) -> Merges:
    """The vocabulary ``name`` (a name of the public collection, or a path), read once per Python worker."""
    if name not in _loaded:
        _loaded[name] = Merges(name if "/" in name else vocabulary_path(name))
    return _loaded[name]


def encode_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, names: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Batches of the columns ``names`` and of texts, with count, digests and ids in the place of the texts."""
    m = merges(vocabulary)
    for batch in batches:
        for part, _, _ in slices(batch, limit=AT_ONCE):
            texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
            ids, at = m.encode(texts)
            cols = [
                *(part.column(i) for i in range(len(names))),
                pa.array(np.diff(at)),
                pa.array([hashlib.sha256(x).hexdigest() for x in m.decimals(ids, at)]),
                pa.array([hashlib.sha256(x).hexdigest() for x in m.decode(ids, at)]),
            ]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, the count of ids, the digests of ids and of the decoded text, and with ``with_ids`` the ids."""
    carried = docs.select(*(f"`{c}`" for c in carry)).schema.fields
    names = [f.name for f in carried]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    ids = ", ids array<int>" if with_ids else ""
    chosen = docs.select(*(f"`{c}`" for c in carry), "text")
    return chosen.mapInArrow(lambda it: encode_batches(it, vocabulary, names, with_ids), f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_bpe_encode_decode": op3_bpe_encode_decode}
ORACLES: dict[str, str] = {}
