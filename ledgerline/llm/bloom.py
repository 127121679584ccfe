"""Bloom filters of bounded size over 64-bit keys.

A filter has twelve bits a key up to 16 MB, which is what is broadcast; over more keys it says yes
too often, never no too often, so whatever it lets pass must still be checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.words import _FOLD, U, mix

BITS_PER_KEY, MAX_BITS, PROBES = 12, 1 << 27, 3
_SALTS = np.arange(PROBES, dtype=U) * _FOLD


class Bloom:
    """Which 64-bit keys a set holds; it never says no to one that it does."""

    def __init__(self, bits: int, words: np.ndarray):
        self.shift, self.words = U(64 - bits.bit_length() + 1), words

    @staticmethod
    def places(keys: np.ndarray, shift: np.uint64) -> list[np.ndarray]:
        return [(mix(keys + salt) >> shift).astype(np.int64) for salt in _SALTS]

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for place in self.places(keys, self.shift):
            out &= (self.words[place >> 6] >> (place & 63).astype(U)) & U(1) == 1
        return out


def bloom_of(keys: DataFrame, count: int) -> tuple[int, bytes]:
    """Size and bits of a filter over ``count`` keys (``key`` long); its words are combined before they are collected."""
    bits = 1 << min(max(count * BITS_PER_KEY, 1 << 10).bit_length(), MAX_BITS.bit_length() - 1)
    shift = U(64 - bits.bit_length() + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place = np.unique(np.concatenate(Bloom.places(batch["key"].to_numpy().view(U), shift)))
            if not len(place):
                continue
            word, first = np.unique(place >> 6, return_index=True)
            ored = np.bitwise_or.reduceat(U(1) << (place & 63).astype(U), first)
            yield pd.DataFrame({"word": word, "bits": ored.view(np.int64)})

    words = keys.select("key").mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = words.toPandas()
    out = np.zeros(bits >> 6, dtype=np.int64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return bits, out.tobytes()


def read_bloom(shared) -> Bloom:
    """The filter of a broadcast (size, bits)."""
    bits, raw = shared.value
    return Bloom(bits, np.frombuffer(raw, dtype=U))
