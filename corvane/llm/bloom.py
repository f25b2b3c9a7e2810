"""A Bloom filter over longs, built by Spark and of bounded size.

It keeps rows that can't matter out of a shuffle; an exact join always follows,
so a filter that is too full costs time and loses nothing. The bits are
or-ed per 64-bit word in Spark; at most ``2**MOST_BITS`` bits (32 MB) reach the
driver and the executors, however many keys there are. From some 22 M keys on it
lets more and more other rows pass, and all of them from some 200 M on: what it
saved is shuffled then.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import import_path

MOST_BITS = 28
HASHES = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = keys.astype(np.int64).view(np.uint64)
    out = []
    for _ in range(HASHES):
        h = (h ^ (h >> np.uint64(31))) * _STEP + np.uint64(1)
        h = h ^ (h >> np.uint64(29))
        out.append(h >> np.uint64(64 - bits))
    return out


class Bloom:
    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def contains(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in _places(keys, self.bits):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def build(keys: DataFrame, column: str) -> Bloom:
    """Over the non-null longs of ``column``."""
    import_path(keys.sparkSession)
    n = keys.count()
    bits = max(12, min(MOST_BITS, (12 * max(1, n)).bit_length()))

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False), bits)))
            word = at >> np.uint64(6)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(first) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    parts = keys.select(F.col(column).cast("long").alias("k")).where("k is not null").mapInArrow(places, "word long, mask long")
    rows = parts.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return Bloom(words, bits)


def might_hold(spark, bloom: Bloom, column: str) -> Column:
    """Whether ``column`` may be among the keys; false for null."""
    shared = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        out = np.zeros(len(keys), bool)
        out[known] = shared.value.contains(keys[known].astype("int64").to_numpy())
        return pd.Series(out)

    return test(F.col(column))


def split(df: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` may be among the longs ``key`` of ``keys``, all others)."""
    test = might_hold(df.sparkSession, build(keys, key), column)
    return df.where(test), df.where(~test)
