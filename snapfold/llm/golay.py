"""The extended binary Golay code [24, 12, 8] as a fuzzy hash: words within two bits of each other share a codeword index.

A segment of up to 23 bits is read as a 23-bit word and gets a parity bit, which makes its weight even. A word of even
weight either lies within two bits of one codeword, or four bits from exactly six, whose differences from it are six
disjoint fours of places (a sextet). Its keys are these codewords, one or six. Two such words two bits apart share a key:
the two places lie in one four, whose codeword is then two bits from the other word, or in two fours, whose codewords are
four bits from both. Words of the segment within two bits of each other stay within two bits when parity is added.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH = 23
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the binary Golay code.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for place in range(LENGTH - 1, 10, -1):
        if word >> place & 1:
            word ^= GENERATOR << (place - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndrome of each value of three bytes (by byte), the indices of the keys' differences by syndrome, and how many there are.

    A syndrome is the remainder of the 23 bits and, above it, the parity of all 24; an index is a codeword's upper 12 of 23 bits.
    """
    bit = [_remainder(1 << place) | 1 << 11 for place in range(LENGTH)] + [1 << 11]
    by_byte = np.zeros((3, 256), np.int64)
    for k in range(3):
        for value in range(256):
            for j in range(8):
                if value >> j & 1:
                    by_byte[k, value] ^= bit[8 * k + j]
    differences: list[list[int]] = [[] for _ in range(1 << 12)]
    for weight in (0, 2, 4):
        for places in combinations(range(24), weight):
            syndrome = index = 0
            for place in places:
                syndrome ^= bit[place]
                index ^= 1 << place
            differences[syndrome].append(index >> 11 & 0xFFF)
    many = np.array([len(d) for d in differences])
    table = np.array([(d + [0] * 6)[:6] for d in differences], np.int64)
    return by_byte, table, many


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: six columns of codeword indices (12 bits), and which of them are keys (one or all six)."""
    words = words.astype(np.int64)
    parity = np.bitwise_count(words.astype(np.uint64)).astype(np.int64) & 1
    full = words | parity << LENGTH
    by_byte, table, many = _tables()
    syndrome = by_byte[0, full & 255] ^ by_byte[1, full >> 8 & 255] ^ by_byte[2, full >> 16 & 255]
    return (words >> 11 & 0xFFF)[:, None] ^ table[syndrome], np.arange(6) < many[syndrome][:, None]
