"""A Bloom filter of fixed size: a first, lossy sieve whose size doesn't grow with the data. What passes it is joined exactly afterwards."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as W

#: 2^23 bits, 1 MB; two bits for each key, which come from two parts of it, so keys must be hashes. When too many keys fill it, it sieves less but loses nothing.
BITS = 23


def _slots(key: Column) -> Column:
    return F.array(F.shiftrightunsigned(key, 64 - BITS), F.shiftrightunsigned(F.shiftleft(key, BITS), 64 - BITS))


def build(keys: DataFrame, column: str) -> np.ndarray:
    """The filter of a long column of hashes; at most 2^17 words of it come to the driver. Nulls are left out."""
    bits = keys.where(F.col(column).isNotNull()).select(F.explode(_slots(F.col(column))).alias("s")).select(F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("b"))
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for r in bits.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r.w] = r.b & 0xFFFFFFFFFFFFFFFF
    return out


def passes(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the filter."""
    keys = keys.view(np.uint64)
    ok = _get(bloom, keys >> np.uint64(64 - BITS))
    at = np.flatnonzero(ok)
    ok[at] = _get(bloom, (keys[at] << np.uint64(BITS)) >> np.uint64(64 - BITS))
    return ok


def _get(bloom: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bloom[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def sieve(df: DataFrame, column: str, bloom: np.ndarray) -> DataFrame:
    """Rows whose long column may be in the filter."""

    def run(batches):
        for b in batches:
            yield b.filter(W.pa.array(passes(bloom, np.asarray(b.column(column).fill_null(0), dtype=np.int64))))

    return df.mapInArrow(run, df.schema)
