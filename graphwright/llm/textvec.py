"""Words and word shingles of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Texts are handled in runs of about so many bytes (one text at least), which bounds the arrays.
RUN_BYTES = 1 << 18
SHINGLE = 5

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_STEP = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, RUN_BYTES * 2)
        steps = np.full(size, base, U)
        steps[0] = 1
        got = np.multiply.accumulate(steps, dtype=U)
        if size <= RUN_BYTES * 8:  # that of a huge text isn't kept
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span, equal for equal contents."""
    n = len(values)
    total = np.zeros(n + 1, U)
    np.cumsum(values * powers(_BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(U))


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def runs(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) for consecutive texts of about RUN_BYTES in all."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= RUN_BYTES:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts in order, where each text's words begin, one more entry at the end).
    Words are runs of other bytes than white space (0x20, 0x09-0x0D); A-Z are folded."""
    data = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    inside = ~_WHITE[data]
    edges = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return span_hashes(_BYTE[data], starts, ends), np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of 5 words; of fewer words the one hash of
    them all; nothing without words."""
    for _, some in runs(texts):
        words, begins = words_of(some)
        n = max(0, len(words) - SHINGLE + 1)
        rolled = np.zeros(n, U)
        for k in range(SHINGLE):
            rolled += words[k : k + n] * _STEP[k]
        rolled = mix(rolled)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(rolled[a : b - SHINGLE + 1])
            elif b > a:
                yield mix(mix((words[a:b] * _STEP[: b - a]).sum(dtype=U, keepdims=True)) + U(b - a))
            else:
                yield np.empty(0, U)
