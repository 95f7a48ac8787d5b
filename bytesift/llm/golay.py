"""The perfect binary Golay code of length 23 as a fuzzy hash.

Any two words within distance 2 share a codeword within distance 4 of both: the one nearest to the word between them,
which lies within 3 of that. A word has one such codeword or six, so six keys at most replace a search for neighbours.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value), and the code's length and redundancy.
GENERATOR, LENGTH, CHECKS = 0b110001110101, 23, 11
#: Differing bits that a shared key is sure to survive.
TOLERANCE = 2


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and for each syndrome the error words of weight up to 4 (-1: no more)."""
    bit = []
    for i in range(LENGTH):
        r = 1 << i
        for k in range(LENGTH - 1, CHECKS - 1, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - CHECKS)
        bit.append(r)

    def of_bits(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int32)
        for i, s in enumerate(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ s
        return out

    errors = [[] for _ in range(1 << CHECKS)]
    for weight in range(5):
        for at in combinations(range(LENGTH), weight):
            s = 0
            for i in at:
                s ^= bit[i]
            errors[s].append(sum(1 << i for i in at))
    table = np.full((1 << CHECKS, 6), -1, np.int32)
    for s, words in enumerate(errors):
        table[s, : len(words)] = words
    return of_bits(bit[:12]), of_bits(bit[12:]), table


def keys(words: np.ndarray) -> np.ndarray:
    """For each word of at most 23 bits the indices (12 bits) of the codewords within distance 4; -1 fills up to six."""
    low, high, table = _tables()
    words = words.astype(np.int32)
    errors = table[low[words & 0xFFF] ^ high[words >> 12]]
    # Any 12 neighbouring places of a cyclic code's words tell them apart.
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)
