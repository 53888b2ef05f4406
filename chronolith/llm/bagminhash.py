"""BagMinHash signatures of multisets of word shingles, vectorised over many documents.

A shingle that occurs ``w`` times owns the weights 0 to w. The weight axis is cut into the dyadic intervals
[0, 1), [1, 2), [2, 4), [4, 8) and so on; each (shingle, interval) has a Poisson process of points in time. A process
splits into those of its interval's halves, these into those of theirs, and so on down to unit weights: one more random
bit of a point says which half it goes to, which makes the halves' processes independent Poisson processes. Each
point also goes to one of the ``k`` registers. Points below ``w`` count, so a register's earliest point is the same in
two documents with the probability of their weighted Jaccard similarity. A process is followed only as far as a time bound that fills
all registers of its document; documents with an empty register are drawn again with a later bound.
"""

from __future__ import annotations

import numpy as np
import xxhash

from chronolith.llm.common import worker_cache

SHINGLE = 5
WORDS_KEPT = 250_000
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes:
    """Stable 64-bit hashes of a text's words, kept in a bounded cache."""

    def __init__(self):
        self.kept: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().encode().split()
        got = list(map(self.kept.get, words))
        if None in got:
            if len(self.kept) >= WORDS_KEPT:
                self.kept.clear()
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self.kept[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        return np.array(got, _U)


word_hashes = WordHashes()
worker_cache("near dedup", word_hashes.kept)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``n`` words (of all words, where there are fewer), with repeats."""
    w = word_hashes(text) if text else np.empty(0, _U)
    if not len(w):
        return w
    size = min(n, len(w))
    total = np.zeros(len(w) - size + 1, _U)
    for i in range(size):
        total = mix(total + w[i : len(w) - size + 1 + i] + _U(0x9E3779B97F4A7C15 * (i + 1) % 2**64))
    return total


def bag(text: str | None, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and how often each occurs."""
    return np.unique(shingles(text, n), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two bags."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    common = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return common / (total - common)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """One row of ``k`` registers for each bag; the bags are not empty."""
    out = np.full((len(bags), k), np.inf)
    weight = np.array([b[1].sum() for b in bags], float)
    bound = (np.log(k) + 5.0) / weight
    todo = np.arange(len(bags))
    while len(todo):
        _draw(out, [bags[i] for i in todo], todo, bound[todo], k)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        out[todo] = np.inf
        bound[todo] *= 2
    return out


def _draw(out: np.ndarray, bags: list, rows: np.ndarray, bound: np.ndarray, k: int) -> None:
    element = np.concatenate([b[0] for b in bags])
    count = np.concatenate([b[1] for b in bags])
    sizes = [len(b[0]) for b in bags]
    row, until = np.repeat(rows, sizes), np.repeat(bound, sizes)
    flat = out.reshape(-1)
    level = 0
    while len(element):
        low = (1 << level) >> 1  # the interval [low, low + length)
        length = max(low, 1)
        seed = mix(element + _U((level * 0xD1B54A32D192ED03 + 1) % 2**64))
        time, w, at, end = np.zeros(len(seed)), count, row, until
        n = 0
        while len(seed):
            n += 1
            draw = mix(seed + _U(n * 0x9E3779B97F4A7C15 % 2**64))
            time = time - np.log(((draw >> _U(11)).astype(float) + 0.5) * 2.0**-53) / (k * length)
            live = time < end
            seed, time, w, at, end, draw = seed[live], time[live], w[live], at[live], end[live], draw[live]
            more = mix(draw + _U(0x632BE59BD9B4E019))
            # one bit for each halving of the interval, the first one highest
            inside = slice(None) if length == 1 else low + (more >> _U(64 - length.bit_length() + 1)).astype(np.int64) < w
            np.minimum.at(flat, at[inside] * k + (more[inside] & _U(0xFFFFFFFF)).astype(np.int64) % k, time[inside])
        level += 1
        go = count > ((1 << level) >> 1)
        element, count, row, until = element[go], count[go], row[go], until[go]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each document and band."""
    bits = signature[:, : bands * rows].copy().view(_U).reshape(-1, bands, rows)
    key = mix(np.arange(1, bands + 1, dtype=_U) * _U(0xA0761D6478BD642F))[None, :].repeat(len(bits), 0)
    for i in range(rows):
        key = mix(key * _U(31) + bits[:, :, i])
    return key.view(np.int64)
