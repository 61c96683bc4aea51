"""The map of keys grows with their number."""

import numpy as np

from maskquery.llm import slots
from maskquery.llm.text import mix, signed


def test_map_follows_the_number_of_keys(spark):
    assert [slots.map_bits(n) for n in (0, 1 << 20, 1 << 21, 1 << 25, 1 << 40)] == [24, 24, 25, 29, 29]
    n = 3_000_000
    keys = spark.range(n).selectExpr("xxhash64(id) as k")
    bits = np.frombuffer(slots.slot_map(keys), np.uint8)
    assert slots.within(bits, keys.limit(10_000).toArrow()["k"].to_numpy()).all()
    assert slots.within(bits, signed(mix(np.arange(1, 100_001, dtype=np.uint64)))).mean() < 1 / 16  # 2^24 slots let 16 % through
