"""Word shingles of whole batches of texts, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from cadenza.llm.arrowtext import LOWER, mix, stretch_hashes, word_bounds

_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, sorted within the row, and where each row's begin and end.

    Words are of ASCII lower-cased bytes between separators. A row with fewer
    than k words has the whole sequence as its one shingle; one without words has none.
    """
    data = LOWER[data]
    start, end, row = word_bounds(data, offsets)
    rows = len(offsets) - 1
    words = stretch_hashes(data, start, end)
    count = np.bincount(row, minlength=rows)
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(count, out=first[1:])
    n = max(0, len(words) - k + 1)
    full = np.zeros(n, np.uint64)
    for j in range(k):
        full += words[j : j + n] * _FACTORS[j]
    whole = row[:n] == row[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
    h, of = mix(full[whole] + _FACTORS[k]), row[:n][whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([np.sum(words[first[r] : first[r + 1]] * _FACTORS[: count[r]], dtype=np.uint64) + np.uint64(0) for r in short], np.uint64)
        h = np.concatenate([h, mix(extra + _FACTORS[k + count[short]])])
        of = np.concatenate([of, short])
        by = np.argsort(of, kind="stable")
        h, of = h[by], of[by]
    at = np.searchsorted(of, np.arange(rows + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(rows + 1))


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each row's values modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
