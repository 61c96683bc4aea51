"""Token ids in directly addressable codes.

An id is cut into levels of ``CHUNK`` bits, lowest first. Level j holds the chunk j of the ids that reach it, packed to its own
width, a bitmap that tells which of them go on to level j + 1, and the counts of set bits before each word of the bitmap. The
place of a chunk in the next level is the rank of its bit, so any single token is read by one lookup per level: no block is
decoded.

The file is a Parquet table, one row per shard: the ids of the shard's documents as levels, with the bounds of the documents. A
shard holds whole documents, closes at ``SHARD_TOKENS`` ids, and knows its partition and its place in it; partitions are ranges of
``doc_id``, so a token's global place is the sum of the partitions before, of which there are few.

Defined cases: a null or empty text is the end id alone; a text of any length is in one shard; null ids come first; repeated rows
and equal ids are stored one after the other, by text digest; an empty table gives a file with no shard; other columns are
not stored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskquery.llm.subwords import byte_letters, vocabulary_path
from maskquery.llm.text import ragged, slices
from maskquery.session import shared_dir

VOCABULARY, END = "word_bpe_49k.json", 2
CHUNK = 8
SHARD_TOKENS = 1 << 18
CACHE_WORDS, CACHE_PARTS = 800_000, 200_000
#: Documents a range holds, about, and how many ranges there are at most; beyond that ranges grow.
RANGE_ROWS, MOST_RANGES = 8192, 20_000


class Levels:
    """Ids in directly addressable codes; ``pack`` and ``load`` are each other's inverse."""

    def __init__(self, n: int, chunks: list[np.ndarray], more: list[np.ndarray], ranks: list[np.ndarray]) -> None:
        self.n, self.chunks, self.more, self.ranks = n, chunks, more, ranks

    @classmethod
    def pack(cls, ids: np.ndarray) -> Levels:
        rest, chunks, more, ranks = ids.astype(np.uint64), [], [], []
        while True:
            chunks.append((rest & np.uint64((1 << CHUNK) - 1)).astype(np.uint8))
            up = rest >> np.uint64(CHUNK)
            on = up > 0
            if not on.any():
                return cls(len(ids), chunks, more, ranks)
            bits = np.packbits(on, bitorder="little")
            bits = np.r_[bits, np.zeros(-len(bits) % 8, np.uint8)].view(np.uint64)
            more.append(bits)
            ranks.append((np.cumsum(np.bitwise_count(bits).astype(np.int64)) - np.bitwise_count(bits)).astype(np.uint32))
            rest = up[on]

    def dump(self) -> list[bytes]:
        """Chunks, bitmap and rank directory of each level in turn (the last level has no bitmap and no directory)."""
        out = []
        for j, c in enumerate(self.chunks):
            out += [c.tobytes(), *([self.more[j].tobytes(), self.ranks[j].tobytes()] if j < len(self.more) else [])]
        return out

    @classmethod
    def load(cls, n: int, parts: list[bytes]) -> Levels:
        return cls(n, [np.frombuffer(p, np.uint8) for p in parts[::3]], [np.frombuffer(p, np.uint64) for p in parts[1::3]], [np.frombuffer(p, np.uint32) for p in parts[2::3]])

    def at(self, index: np.ndarray) -> np.ndarray:
        """The ids at the given places, in any order: one chunk and one rank per level and id."""
        out = self.chunks[0][index].astype(np.int64)
        where, place = np.arange(len(index)), np.asarray(index, np.int64)
        for j, (bits, ranks) in enumerate(zip(self.more, self.ranks)):
            word, bit = bits[place >> 6], (place & 63).astype(np.uint64)
            on = ((word >> bit) & np.uint64(1)).astype(bool)
            where, place, word, bit = where[on], place[on], word[on], bit[on]
            if not len(where):
                break
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            place = ranks[place >> 6].astype(np.int64) + below
            out[where] |= self.chunks[j + 1][place].astype(np.int64) << (CHUNK * (j + 1))
        return out


class Words:
    """The library's ids of a text, word by word: white space parts words for this vocabulary, so each word is encoded once.

    A word of Latin letters below U+0130 is parted further, where the vocabulary's own pattern parts it, as such words keep their
    form under the library's normalisation but for case, and its model spells the parts; any other word goes through the whole library.
    """

    #: Parts of a word in this vocabulary family. Fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.parts_of = regex.compile(self.PATTERN).findall
        self.parts: dict[str, list[int]] = {}
        self.letters = {b: c for c, b in byte_letters().items()}
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def _plain(text: str) -> bool:
        return "<|" not in text and (text.isascii() or max(text) < "\u0130")

    def _spell(self, word: bytes) -> list[int]:
        text = word.decode()
        if not self._plain(text):
            return self.library.encode(text, add_special_tokens=False).ids
        out, known = [], self.parts
        for part in self.parts_of(text.lower()):
            ids = known.get(part)
            if ids is None:
                letters = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
                ids = known[part] = [t.id for t in self.library.model.tokenize(letters)]
            out += ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the n + 1 bounds."""
        if len(self.index) > CACHE_WORDS:
            self._forget()
        index, rows = self.index, []
        for t in texts:
            words = (t.lower() if self._plain(t) else t).encode().split()
            rows.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        if index.fresh:
            ids = [self._spell(w) for w in index.fresh]
            index.fresh.clear()
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
            if len(self.parts) > CACHE_PARTS:
                self.parts.clear()
        which = np.concatenate([np.zeros(0, np.int64), *rows])
        size = self.at[which + 1] - self.at[which]
        return self.flat[ragged(self.at[which], size)], np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)]


class _Index(dict):
    """Words to numbers in order of first use; new ones are noted in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


_loaded: dict[str, Words] = {}


def words(name: str) -> Words:
    if name not in _loaded:
        _loaded[name] = Words(name if "/" in name else vocabulary_path(name))
    return _loaded[name]


_SHARD = "part int, shard int, n long, at array<long>, levels array<binary>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Encode ``docs`` (``doc_id, text``) in ascending order of ``doc_id`` and write the shards to ``path``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words(vocabulary)
        ids, names, sizes, part, shard = [], [], [], None, 0

        def close() -> pa.RecordBatch:
            flat, size = np.concatenate(ids), np.concatenate(sizes)
            levels = Levels.pack(flat)
            bounds = np.r_[0, np.cumsum(size)]
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([bounds], pa.list_(pa.int64())), pa.array([levels.dump()], pa.list_(pa.binary()))]
            names_col = pa.ListArray.from_arrays(pa.array([0, sum(map(len, names))], pa.int32()), pa.concat_arrays(names))
            return pa.RecordBatch.from_arrays([*row, names_col], ["part", "shard", "n", "at", "levels", "doc_ids"])

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for rows, _, _ in slices(batch):
                got, at = coder.encode([t or "" for t in rows.column(1).to_pylist()])
                ids.append(np.insert(got, at[1:], end))
                sizes.append(np.diff(at) + 1)
                names.append(rows.column(0))
                if sum(map(len, ids)) >= SHARD_TOKENS:
                    yield close()
                    ids, names, sizes, shard = [], [], [], shard + 1
        if ids:
            yield close()

    n = docs.count()
    ranges = min(MOST_RANGES, max(1, -(-n // RANGE_ROWS)))
    narrow = docs.select("doc_id", "text").repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", F.md5("text"))
    narrow = narrow.withColumn("part", F.spark_partition_id())
    narrow.mapInArrow(encode, f"{_SHARD}, doc_ids array<{kind}>").write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``base``, the number of ids in all shards before."""
    shards = spark.read.parquet(path)
    # Counts are summed in two steps: shards inside their partition, partitions (few) by the blocked running sum below.
    totals = shards.groupBy("part").agg(F.sum("n").alias("m"))
    before = _running(totals)
    inner = F.sum("n").over(W.partitionBy("part").orderBy("shard")) - F.col("n")
    earlier = shards.select("part", "shard", inner.alias("inner"))
    return shards.join(before, "part").join(earlier, ["part", "shard"]).withColumn("base", F.col("before") + F.col("inner")).drop("before", "inner")


def _running(totals: DataFrame, block: int = 1024) -> DataFrame:
    """``part, before``: the sum of ``m`` over smaller parts, block sums first."""
    t = totals.withColumn("block", (F.col("part") / block).cast("int"))
    sums = t.groupBy("block").agg(F.sum("m").alias("m")).withColumn("one", F.lit(0))
    upto = sums.select("block", (F.sum("m").over(W.partitionBy("one").orderBy("block")) - F.col("m")).alias("start"))
    own = F.sum("m").over(W.partitionBy("block").orderBy("part")) - F.col("m")
    return t.select("part", "block", own.alias("own")).join(upto, "block").select("part", (F.col("start") + F.col("own")).alias("before"))


def documents_of(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            for i in range(batch.num_rows):
                levels = Levels.load(get("n")[i].as_py(), get("levels")[i].as_py())
                at = get("at")[i].values.to_numpy()
                raw = levels.at(np.arange(levels.n)).astype("<u4").tobytes()
                crc = [zlib.crc32(memoryview(raw)[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([get("doc_ids")[i].values, pa.array(get("base")[i].as_py() + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("n", "at", "levels", "doc_ids", "base").mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return documents_of(read_tokens(spark, path))


QUERIES = {"op6_token_id_output": op6_token_id_output}
ORACLES: dict[str, str] = {}
