"""A map of 64-bit keys, sized by their number within bounds: what cannot be in a set is dropped before the shuffle of an exact join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The map has 2^24 to 2^29 slots (2 to 64 MB), ``ROOM`` or more a key in between; a fuller one lets more rows through to the join
#: and loses none.
MAP_BITS, MOST_BITS, ROOM = 24, 29, 16


def map_bits(n: int) -> int:
    """Binary logarithm of the slots for n keys."""
    return min(MOST_BITS, max(MAP_BITS, (ROOM * n - 1).bit_length()))


def slot_map(keys: DataFrame) -> bytes:
    """The bitmap of the upper bits of ``keys``' only column, a well mixed long."""
    size = map_bits(keys.count())
    slot = F.shiftrightunsigned(keys.columns[0], 64 - size)
    rows = keys.select(slot.alias("slot")).select(F.shiftright("slot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    got = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), "<i8")
    bits[got["word"].to_numpy()] = got["bits"].to_numpy()
    return bits.tobytes()


def within(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the slots of the keys are set; ``bits`` is the bitmap as bytes."""
    slot = key.view(np.uint64) >> np.uint64(65 - (8 * len(bits)).bit_length())
    return ((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def maybe_in(keys: DataFrame):
    """A column function: whether a long may be among ``keys``."""
    shared = keys.sparkSession.sparkContext.broadcast(slot_map(keys))

    @F.arrow_udf("boolean")
    def look(key: pa.Array) -> pa.Array:
        return pa.array(within(np.frombuffer(shared.value, np.uint8), key.to_numpy(zero_copy_only=False).astype(np.int64)))

    return look


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``gone``'s only column; rows that cannot be in it are not shuffled."""
    hit = maybe_in(gone.select(F.xxhash64(gone.columns[0])))(F.xxhash64(key))
    left = docs.filter(hit).join(gone, key == gone[gone.columns[0]], "left_anti")
    return left.union(docs.filter(~hit))
