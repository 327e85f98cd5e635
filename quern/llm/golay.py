"""The perfect binary [23, 12, 7] Golay code, as tables built from its generator polynomial.

Every 23-bit word lies within 3 bits of exactly one codeword. ``nearest`` decodes to it; ``near``
gives all codewords within 4 bits: that one alone if it is within 2, else it and five more. If two
words differ in one bit, the nearest codeword of either is among the near codewords of the other.
Codewords are named by their 12 leading bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
BITS, CHECK = 23, 11


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


_UNIT = np.array([_remainder(1 << i) for i in range(BITS)], np.int32)


def _linear(low: int, high: int) -> np.ndarray:
    """Remainders of all words of the bits low..high-1."""
    table = np.zeros(1, np.int32)
    for i in range(low, high):
        table = np.concatenate([table, table ^ _UNIT[i]])
    return table


_LOW, _HIGH = _linear(0, 12), _linear(12, BITS)


def _patterns(weight: int) -> tuple[np.ndarray, np.ndarray]:
    words = np.array([sum(1 << i for i in x) for x in combinations(range(BITS), weight)] or [0], np.int32)
    return words, remainder(words)


def remainder(words: np.ndarray) -> np.ndarray:
    return _LOW[words & 0xFFF] ^ _HIGH[words >> 12]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    leader = np.zeros(1 << CHECK, np.int32)
    for weight in range(4):
        words, rest = _patterns(weight)
        leader[rest] = words
    others = np.repeat(leader[:, None], 5, axis=1)
    words, rest = _patterns(4)
    order = np.argsort(rest, kind="stable")
    words, rest = words[order].reshape(-1, 5), rest[order].reshape(-1, 5)
    others[rest[:, 0]] = words
    return leader, others


LEADER, OTHERS = _tables()


def nearest(words: np.ndarray) -> np.ndarray:
    """The leading bits of the codeword within 3 bits of each word."""
    words = words.astype(np.int32)
    return (words ^ LEADER[remainder(words)]) >> CHECK


def near(words: np.ndarray) -> np.ndarray:
    """For each word six leading bits: of all codewords within 4 bits (repeated where there is only one)."""
    words = words.astype(np.int32)
    rest = remainder(words)
    return np.concatenate([(words ^ LEADER[rest])[:, None], words[:, None] ^ OTHERS[rest]], axis=1) >> CHECK
