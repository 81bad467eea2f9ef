"""Bit filters of strings: a few bits a string, sent to every task to leave out what can't matter; what passes is settled by an exact join."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: A filter has sixteen bits a string between these bounds.
BITS = 1 << 20, 1 << 27


def bit_filter(strings: DataFrame) -> bytes:
    """A filter over a one-column frame, made by all tasks: each 32 bits are one group of an aggregation, so the driver gets a number of rows bounded by
    the largest filter, whatever the number of strings."""
    n, (low, high) = strings.count(), BITS
    size = min(high, max(low, 1 << (16 * n).bit_length()))
    slot = F.pmod(F.crc32(strings.columns[0]), F.lit(size)).cast("int")
    words = strings.select(slot.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 31)")).alias("bits"))
    out = np.zeros(size // 32, np.uint32)
    for b in words.toArrow().to_batches():
        out[b.column("word").to_numpy()] = b.column("bits").to_numpy().astype(np.uint32)
    return out.tobytes()


def has(bits: bytes, string: str) -> bool:
    at = zlib.crc32(string.encode("utf-8", "surrogatepass")) & (len(bits) * 8 - 1)
    return bool(bits[at >> 3] >> (at & 7) & 1)
