"""Words and word shingles of batches of texts, in numpy over their UTF-8 bytes.

A word is a run between ASCII white space, with A-Z in lower case; a shingle is a run of words joined by one space each. A
text with fewer words has one shingle, all its words; a text without words has none. Shingles are told apart by XXH64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts whose words are found at once (a longer text is met alone), and shingles that are hashed at once.
TEXT_BYTES, HASHED = 1 << 19, 1 << 16
#: The seed of the shingles' XXH64.
SEED = 42

_BYTES = np.arange(256, dtype=np.uint8)
SPACE = (_BYTES == 0x20) | (_BYTES >= 0x09) & (_BYTES <= 0x0D)
LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)
BITS = ((_BYTES[:, None] >> np.arange(8)) & 1).astype(np.float64)

# The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _round(lane: np.ndarray) -> np.ndarray:
    return _turned(lane * P2, 31) * P1


def xxh64(data: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[begin : begin + size] for each pair; data are bytes."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    base, end = int(begin.min()), int((begin + size).max())
    near = np.zeros(end - base + 8, np.uint8)
    near[: end - base] = data[base:end]
    # The eight bytes from every place on, as one number each.
    eight = np.ascontiguousarray(np.lib.stride_tricks.as_strided(near[:8].view("<u8"), (end - base + 1,), (1,)))
    at, left = begin - base, size.astype(np.int64)
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(at), s + P5, np.uint64)
        own = np.flatnonzero(left >= 32)
        if len(own):
            v = [np.full(len(own), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            place, stripes = at[own], left[own] // 32
            go = np.arange(len(own))
            for k in range(int(stripes.max())):
                go = go[stripes[go] > k]
                for i in range(4):
                    v[i][go] = _turned(v[i][go] + eight[place[go] + (32 * k + 8 * i)] * P2, 31) * P1
            mixed = _turned(v[0], 1) + _turned(v[1], 7) + _turned(v[2], 12) + _turned(v[3], 18)
            for x in v:
                mixed = (mixed ^ _round(x)) * P1 + P4
            h[own] = mixed
            at = at.copy()
            at[own] += 32 * stripes
            left = left % 32
        h += size.astype(np.uint64)
        for _ in range(3):
            go = np.flatnonzero(left >= 8)
            if not len(go):
                break
            h[go] = _turned(h[go] ^ _round(eight[at[go]]), 27) * P1 + P4
            at, left = at + 8 * (left >= 8), np.where(left >= 8, left - 8, left)
        go = np.flatnonzero(left >= 4)
        h[go] = _turned(h[go] ^ (eight[at[go]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
        at, left = at + (left & 4), left & 3
        for k in range(3):
            go = np.flatnonzero(left > k)
            h[go] = _turned(h[go] ^ (eight[at[go] + k] & np.uint64(0xFF)) * P5, 11) * P1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        return h ^ h >> np.uint64(32)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of texts, or of bytes, without nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return ends, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def normal(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, size, count): all words with a space behind each, where each begins, its size, and the number in each text.

    ends: where the texts begin in data, and where the last one ends.
    """
    part = data[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~SPACE[part]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # A word ends with its text, even where the next text begins with a word.
    edge = ends[1:-1]
    edge = edge[(edge > 0) & (edge < len(part))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    begin = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = LOWER[part[inside]]
    return out, begin, size, np.diff(np.searchsorted(start, ends))


def runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring items in runs of at most `most` units (one item at least); ends: where each begins, and the last one's end."""
    i = 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, j
        i = j


def shingles(texts: pa.Array, n: int, digest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Run by run of neighbouring texts: the hashes of all shingles of n words, the number in each text, and if asked for 16
    bytes that tell the words of a text from those of others."""
    ends, data = buffers(texts)
    for i, j in runs(ends, TEXT_BYTES):
        out, begin, size, count = normal(data, ends[i : j + 1])
        many = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
        word = np.arange(int(many.sum())) + np.repeat(np.cumsum(count) - count - np.cumsum(many) + many, many)
        last = word + np.repeat(np.minimum(count, n), many) - 1
        hashes = np.zeros(len(word), np.uint64)
        for a in range(0, len(word), HASHED):
            x, y = word[a : a + HASHED], last[a : a + HASHED]
            hashes[a : a + HASHED] = xxh64(out, begin[x], begin[y] + size[y] - begin[x])
        marks = []
        if digest:
            stop = np.append(begin, len(out))[np.concatenate([[0], np.cumsum(count)])]
            view = memoryview(out)
            marks = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(stop[:-1].tolist(), stop[1:].tolist())]
        yield hashes, many, marks


def distinct(hashes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text sorted and without repeats, and the number of them."""
    ends = np.concatenate([[0], np.cumsum(many)]).tolist()
    parts = [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    return np.concatenate(parts) if parts else hashes, np.array([len(p) for p in parts], np.int64)


def parities(hashes: np.ndarray, many: np.ndarray, bits: int) -> np.ndarray:
    """(text, byte) bitmaps of runs of different hashes: a bit is 1 if an odd number of the hashes fall on it.

    Each hash that only one of two texts has turns one bit, so bitmaps differ in no more bits than there are such hashes.
    """
    out = np.zeros((len(many), bits // 8), np.uint8)
    ends = np.concatenate([[0], np.cumsum(many)])
    for x in range(0, len(many), 256):
        y = min(x + 256, len(many))
        at = np.repeat(np.arange(y - x) * bits, many[x:y]) + (hashes[ends[x] : ends[y]] >> np.uint64(64 - (bits - 1).bit_length())).astype(np.int64)
        out[x:y] = np.packbits(np.bincount(at, minlength=(y - x) * bits).reshape(y - x, bits) & 1, axis=1, bitorder="little")
    return out


def majority(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: a bit is 1 if set in over half of the run; 0 for an empty run."""
    out = np.zeros(len(many), np.uint64)
    own = hashes.view(np.uint8).reshape(-1, 8)
    ends = np.concatenate([[0], np.cumsum(many)])
    for i, j in runs(ends, HASHED):
        for x, y in ((a, min(a + 256, j)) for a in range(i, j, 256)):
            part = own[ends[x] : ends[y]]
            text = np.repeat(np.arange(y - x) << 8, many[x:y])
            # How often each text has each value at a byte tells how often it has each bit.
            for b in range(8):
                ones = np.bincount(text + part[:, b], minlength=(y - x) << 8).reshape(-1, 256) @ BITS
                bits = np.packbits(2 * ones > many[x:y, None], axis=1, bitorder="little")[:, 0]
                out[x:y] |= bits.astype(np.uint64) << np.uint64(8 * b)
    return out
