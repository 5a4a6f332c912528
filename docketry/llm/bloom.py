"""Split-block Bloom filter: a key sets one bit in each of the eight 64-bit words of one block."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, BLOCK_WORDS = 16, 8
#: Odd multipliers, one for each word of a block.
SALTS = [(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0x7FFFFFFF | 1 for i in range(BLOCK_WORDS)]


@dataclass
class BlockedBloom:
    words: np.ndarray  # (blocks, 8) uint64

    def might_contain(self, h: np.ndarray) -> np.ndarray:
        """For 64-bit key hashes."""
        if not len(h) or not len(self.words):
            return np.zeros(len(h), bool)
        block = ((h >> np.uint64(32)) % np.uint64(len(self.words))).astype(np.int64)
        low = h & np.uint64(0x7FFFFFFF)
        out = np.ones(len(h), bool)
        for i, salt in enumerate(SALTS):
            bit = (low * np.uint64(salt) >> np.uint64(20)) & np.uint64(63)
            out &= (self.words[:, i][block] >> bit) & np.uint64(1) == 1
        return out


def blocks_for(keys: int, most_bytes: int) -> tuple[int, bool]:
    """Blocks for so many keys, and whether the filter at full precision fits ``most_bytes``; never more than fit."""
    size = 8 * BLOCK_WORDS
    wanted = max(1, -(-keys * BITS_PER_KEY // (8 * size)))
    return max(1, min(wanted, most_bytes // size)), wanted * size <= most_bytes


def build(hashes: DataFrame, blocks: int) -> BlockedBloom:
    """The filter of ``hashes(h)``; bits are combined on the executors, so one row a block comes back."""
    low = F.col("h").bitwiseAND(F.lit(0x7FFFFFFF))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(low * F.lit(s), 20).bitwiseAND(F.lit(63)).cast("int")) for s in SALTS]
    rows = hashes.select((F.shiftrightunsigned("h", 32) % blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(bits)))
    got = rows.groupBy("block").agg(*(F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(BLOCK_WORDS))).toPandas()
    words = np.zeros((blocks, BLOCK_WORDS), np.int64)
    if len(got):
        words[got["block"].to_numpy()] = got[[f"w{i}" for i in range(BLOCK_WORDS)]].to_numpy()
    return BlockedBloom(words.view(np.uint64))
