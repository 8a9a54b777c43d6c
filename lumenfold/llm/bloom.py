"""Bloom filters of bounded size: what can't be in a small set is left out before it is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES = 6
#: 32 MB, whatever the set's size: a larger set makes the filter let more through, never less.
MOST_BITS = 1 << 28


def _positions(values: np.ndarray, bits: int) -> np.ndarray:
    x = values.astype(np.int64).view(np.uint64)
    out = []
    for k in range(HASHES):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append((z ^ (z >> np.uint64(31))) & np.uint64(bits - 1))
    return np.stack(out)


class Bloom:
    def __init__(self, words: np.ndarray):
        self.words = words

    def __contains__(self, values: np.ndarray) -> bool:
        return bool(self.test(np.asarray(values)).all())

    def test(self, values: np.ndarray) -> np.ndarray:
        at = _positions(values, len(self.words) * 64)
        hit = (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        return hit.astype(bool).all(axis=0)


def build(values: DataFrame, count: int) -> Bloom:
    """The filter of a one-column table of longs, of about `count` rows. At most MOST_BITS / 64 words reach the driver."""
    bits = 1 << 12
    while bits < min(16 * max(1, count), MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            at = _positions(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(words[used].view(np.int64), pa.int64())], ["at", "word"])

    words = np.zeros(bits // 64, dtype=np.uint64)
    found = values.mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    words[found["at"].to_numpy(dtype=np.int64)] = found["word"].to_numpy(dtype=np.int64).view(np.uint64)
    return Bloom(words)
