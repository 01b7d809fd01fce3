"""Words of whole texts as 64-bit hashes, for a batch of texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all (in place for temporaries)."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + n // 4, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, A-Z in lower case, and for each text the place of its first word; one more place ends the last."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # the first byte is white, so edges alternate
    begin, end = edge[0::2], edge[1::2]
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.cumsum(_BYTE[_LOWER[data]] * up, dtype=np.uint64)
        words = mix((sums[end - 1] - sums[begin - 1]) * down[begin] + (end - begin).astype(np.uint64))
    borders = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return words, np.searchsorted(begin, borders)


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, ascending, one text after another, and the places where texts begin.

    A text of fewer words has its whole sequence as the one shingle; one without words has none.
    """
    words, at = word_hashes(texts)
    count = np.diff(at)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - k + 1)
        rolled = np.zeros(n, np.uint64)
        for i in range(k):
            rolled = rolled * _U(_BASE) + words[i : i + n]
        doc = np.repeat(np.arange(len(texts)), count)
        inside = doc[:n] == doc[k - 1 : k - 1 + n]
        hashes, of = mix(rolled[inside]), doc[:n][inside]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j, d in enumerate(short.tolist()):
                for w in words[at[d] : at[d + 1]].tolist():
                    own[j] = own[j] * _U(_BASE) + _U(w)
            hashes = np.concatenate([hashes, mix(own + count[short].astype(np.uint64))])
            of = np.concatenate([of, short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(len(texts) + 1))
