"""Words, shingles and their hashes against plain Python; row ids as bitmaps."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from bytesift.llm import common, shingles
from tests.llm.test_simhash import WORD, brute_print

TEXTS = ["", " ", "one", "One TWO", "a b c d e f", "\tx\x0by  z \n", "é É ß 中文 x", "A" * 100 + " b", "w " * 500, "trailing", "trailing ", " leading"]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def runs(text, n):
    w = words(text)
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def test_xxh64_of_slices():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    begin, size = rng.integers(0, 4700, 2000), rng.integers(0, 300, 2000)
    for seed in (0, 42):
        got = shingles.xxh64(data, begin, size, seed)
        assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), seed) for a, n in zip(begin.tolist(), size.tolist())]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("n", [1, 4, 5])
def test_shingles_of_texts(monkeypatch, kind, n):
    for most in (8, 1 << 19):
        monkeypatch.setattr(shingles, "TEXT_BYTES", most)
        monkeypatch.setattr(shingles, "HASHED", max(3, most // 4))
        column = pa.array(["skipped", *TEXTS, "skipped"], kind).slice(1, len(TEXTS))
        hashes, many, marks = [], [], []
        for h, c, m in shingles.shingles(column, n, digest=True):
            hashes += h.tolist()
            many += c.tolist()
            marks += m
        want = [[xxhash.xxh64_intdigest(r.encode(), 42) for r in runs(t, n)] for t in TEXTS]
        assert many == [len(w) for w in want] and hashes == [h for w in want for h in w]
        assert [[i for i, y in enumerate(TEXTS) if words(y) == words(x)] for x in TEXTS] == [[i for i, m in enumerate(marks) if m == marks[j]] for j in range(len(TEXTS))]


def test_fingerprints_and_parities():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(40)], n)) for n in (0, 1, 3, 50, 400, 2000)]
    prints, sets = [], []
    for h, many, _ in shingles.shingles(pa.array(texts), 4):
        prints += shingles.majority(h, many).tolist()
    assert prints == [brute_print(t, 4) for t in texts]
    for h, many, _ in shingles.shingles(pa.array(texts), 2):
        own, sizes = shingles.distinct(h, many)
        bits = shingles.parities(own, sizes, 256)
        ends = np.cumsum(sizes)
        sets += [set(own[e - n : e].tolist()) for e, n in zip(ends, sizes)]
    assert [len(s) for s in sets] == [len(set(runs(t, 2))) for t in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert int(np.bitwise_count(bits[i] ^ bits[j]).sum()) <= len(a ^ b)


@pytest.mark.parametrize("maps", [1 << 14, 0])
def test_rows_among_ids(spark, monkeypatch, maps):
    monkeypatch.setattr(common, "BITMAPS", max(1, maps))
    if not maps:
        monkeypatch.setattr(common, "cut", lambda df, *a: df.unionByName(df))  # more bitmaps than are sent
    rng = np.random.default_rng(2)
    own = sorted({int(p) << 33 | int(i) for p, i in zip(rng.integers(0, 3, 500), rng.integers(0, 70_000, 500))})
    df = spark.createDataFrame([(r, "x", r % 7) for r in own], "rid long, bucket_ string, bits_ long")
    ids = spark.createDataFrame([(r,) for r in own[::3]], "rid long")
    inside = common.among(df, "rid", ids)
    assert inside.columns == df.columns and sorted(r.rid for r in inside.collect()) == own[::3]
    outside = {r.rid for r in common.among(df, "rid", ids, inside=False).collect()}
    assert outside == set(own) - set(own[::3])
    assert common.among(df, "rid", ids.limit(0)).count() == 0 and common.among(df.limit(0), "rid", ids).count() == 0
    assert common.among(df, "rid", ids.limit(0), inside=False).agg(F.count("*")).first()[0] == len(own)
