"""Array arithmetic on texts that the llm operators share; runs inside tasks, one batch at a time."""

from __future__ import annotations

import re

import numpy as np

WORDS = re.compile(r"[^\W_]+")
_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads the input over all of them."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def window_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k neighbouring units (uint64 values), in order.

    A rolling sum of unit * base**position, computed by prefix sums modulo 2**64 and brought to a
    common power by the inverse of the odd base.
    """
    n = len(units)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, inverse = _powers(n)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(units + np.uint64(1)) * power[:n], dtype=np.uint64)])
        return mix((prefix[k:] - prefix[:-k]) * inverse[: n - k + 1])


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _cache:
        base_inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _cache[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (_B, base_inverse))
    return _cache[size]


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest value, the last of equal ones, in every window of w values."""
    n = len(values)
    if not n:
        return np.empty(0, np.int64)
    w = min(w, n)
    # Smallest of the rest of a block and of the start of the next one, over blocks of w values.
    pad = -n % w
    big = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(big, axis=1).ravel()[:n]
    right = np.minimum.accumulate(big[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(right[: n - w + 1], left[w - 1 :])


def selected(values: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the smallest value of at least one window of w values, in order.

    Every window has a selected position; which of its positions are selected depends on nothing
    but the values in the windows that hold it, so equal stretches select equal positions.
    """
    n = len(values)
    if n <= w:
        return np.flatnonzero(values == values.min()) if n else np.empty(0, np.int64)
    least = sliding_min(values, w)
    # Position i lies in the windows i-w+1 .. i; it is selected if the largest of their minima reaches its value.
    inverted = np.uint64(0xFFFFFFFFFFFFFFFF) - least
    full = np.concatenate([np.full(w - 1, np.iinfo(np.uint64).max, np.uint64), inverted, np.full(w - 1, np.iinfo(np.uint64).max, np.uint64)])
    return np.flatnonzero(sliding_min(full, w) == np.uint64(0xFFFFFFFFFFFFFFFF) - values)


class WordIds:
    """Numbers for words that are the same in every process: the hash of the lower-cased word."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self._known
        if len(known) > 2_000_000:  # memory of a worker that sees many texts; refilled as needed
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return WORDS.findall(text.lower())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
