"""Hashes of words and shingles of whole texts, computed in numpy inside tasks.

A word is a run of bytes other than space and U+0009 to U+000D, with A-Z lowered. Its hash is a
polynomial over its UTF-8 bytes, mixed to 64 bits; a shingle's hash folds those of its words.
Long texts are cut at white space, so memory follows a piece and not a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 20
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = U(0x100000001B3)
_FOLD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` and the byte at which each starts."""
    raw = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, dtype=U), starts
    lengths = np.flatnonzero(edge == -1) - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    power = np.cumprod(np.full(lengths.max(), _BASE, dtype=U))
    hashes = np.add.reduceat((raw[inside].astype(U) + U(1)) * power[place], first)
    return mix(hashes ^ mix(lengths.astype(U) * _FOLD)), starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """Cut long bytes at white space; a single longer word stays whole."""
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words in order; null counts as empty."""
    group: list[bytes] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, starts = _hash_piece(b"\n".join(group))
        cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in group]))
        yield from np.split(hashes, cuts[:-1])

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if len(data) > PIECE:
            if group:
                yield from flush()
                group, held = [], 0
            yield np.concatenate([_hash_piece(x)[0] for x in _pieces(data)])
            continue
        group.append(data)
        held += len(data)
        if held >= PIECE:
            yield from flush()
            group, held = [], 0
    if group:
        yield from flush()


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``k`` words; of a shorter text, of the whole."""
    if not len(words):
        return words
    k = min(k, len(words))
    folded = words[: len(words) - k + 1] + U(k)
    for j in range(1, k):
        folded = mix(folded * _FOLD + words[j : len(words) - k + 1 + j])
    return np.unique(mix(folded))


def digest(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that equal sets share."""
    if not len(values):
        return 0, 0
    with np.errstate(over="ignore"):
        pair = np.array([mix(values).sum(dtype=U), mix(values * _FOLD + U(1)).sum(dtype=U)], dtype=U)
    return tuple(int(x) for x in pair.view(np.int64))
