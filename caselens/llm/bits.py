"""Bit filters of bounded size: a superset of a set of 64-bit keys that every task can hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter at most (16 MB).
MOST = 1 << 27


def bit_filter(keys: DataFrame, key: str, most: int = MOST) -> np.ndarray:
    """64-bit words in which the bit of each key is set: 16 bits a key or ``most``, so a filter for very many keys lets more others pass.

    The driver gets one row per word that has a bit, ``most`` / 64 at most.
    """
    bits = 1 << min(most.bit_length() - 1, max(12, (keys.count() * 16).bit_length()))
    place = F.pmod(F.col(key), F.lit(bits))
    found = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod({key}, 64) as int)))").alias("mark")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["word"].to_numpy()] = found["mark"].to_numpy().view(np.uint64)
    return out


def passes(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set."""
    place = keys.view(np.uint64) & np.uint64(len(filter_) * 64 - 1)
    return (filter_[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
