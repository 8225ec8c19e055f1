"""Code points of a batch of texts as numpy, with tables for letters and lower case."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """True for every code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case of every code point whose lower case is one code point; others stay."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets as code points and row offsets."""
    lead = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, before[at]
