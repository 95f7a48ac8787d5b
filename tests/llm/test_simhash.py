import re

import numpy as np
import pytest
import xxhash

from bytesift.llm import golay, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, k):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, k):
    """Smallest index reachable, by comparing all."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= k:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    keys = golay.keys(words)
    assert set((keys >= 0).sum(1)) <= {1, 6}
    for flips in (0, 1, 2):
        other = words.copy()
        for row in range(len(words)):
            for bit in rng.choice(23, flips, replace=False):
                other[row] ^= 1 << int(bit)
        theirs = golay.keys(other)
        assert all(({*a} - {-1}) & ({*b} - {-1}) for a, b in zip(keys, theirs))


@pytest.mark.parametrize(("bits", "chosen"), [(4, 2), (12, 1)])
def test_fuzzy_keys_lose_no_link(bits, chosen):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, bits + 1), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    own = [{*()} for _ in a], [{*()} for _ in a]
    for fps, sets in zip((a, b), own):
        for rows, keys in simhash.fuzzy_keys(fps, bits, chosen):
            for r, k in zip(rows.tolist(), keys.tolist()):
                sets[r].add(k)
    assert all(x & y for x, y in zip(*own))


@pytest.mark.parametrize("small", [3, 256])
def test_links_within_connect_each_key_as_all_pairs_do(small):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6).astype(np.uint64)
    fp = base[rng.integers(0, 6, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    key = np.sort(rng.integers(0, 9, 400))
    a, b = simhash.links_within(key, fp, 3, small)
    assert (key[a] == key[b]).all() and (np.bitwise_count(fp[a] ^ fp[b]) <= 3).all()

    def parts(pairs):
        label = np.arange(400)
        for x, y in pairs:
            label[label == label[x]] = label[y]
        return {frozenset(np.flatnonzero(label == g)) for g in set(label)}

    everything = [(i, j) for i in range(400) for j in range(i) if key[i] == key[j] and bin(int(fp[i] ^ fp[j])).count("1") <= 3]
    assert parts(zip(a, b)) == parts(everything)


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        words = list(rng.choice(vocabulary, rng.integers(1, 400)))
        texts.append(" ".join(words))
        for _ in range(rng.integers(0, 4)):
            other = list(words)
            other[rng.integers(0, len(words))] = "Edit"
            texts.append(" ".join(other))
    texts += [None, "", " \t\n", "one", "one two three", "ONE\ttwo\x0bthree", "é É ß 中文  x", "a b c d " * 60000]
    rows = [(i * 7, t, "extra") for i, t in enumerate(texts)] + [(None, "one", "x"), (3, "one", "y"), (3, "one", "y")]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, FP string")).collect()
    assert len(got) == len(rows)
    prints = [brute_print(t, 4) for _, t, _ in rows]
    groups = brute_groups(prints, 4)
    want = []
    for (doc, _, _), p, g in zip(rows, prints, groups):
        ids = [d for (d, _, _), h in zip(rows, groups) if h == g and d is not None]
        want.append((doc, f"{p:016x}", min(ids)))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_no_rows(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert simhash.near_duplicates_dropped(empty).collect() == []


def test_keys_beyond_a_block_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VERIFY_ROWS", 64)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    fp = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 60, (300, 3))})
    nodes = spark.createDataFrame([(f, f) for f in fp], "node long, fp long")
    links = simhash.candidate_links(nodes, 4, 2, block=32)
    labels = {r.node: r.label for r in simhash.components(links).collect()}
    groups = brute_groups(fp, 4)
    assert [labels.get(f, f) for f in fp] == [fp[g] for g in groups]


def test_components_of_chains_and_stars(spark):
    links = [(i + 1, i) for i in range(50)] + [(i, 100) for i in range(101, 200)] + [(301, 300)]
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 200)} | {300: 300, 301: 300}


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    near = list(words)
    near[150] = "changed"
    far = [f"v{i}" for i in rng.integers(0, 5000, 300)]
    half = words[:150] + far[:150]
    rows = [(5, " ".join(near), "a"), (4, " ".join(words), "b"), (6, " ".join(words), "c"), (6, " ".join(words), "c"), (7, " ".join(far), "d"), (8, " ".join(half), "e"), (9, None, "f"), (None, "", "g"), (10, "short text", "h")]
    got = simhash.near_duplicates_dropped(spark.createDataFrame(rows, "doc_id long, text string, row_id string"))
    assert got.columns == ["doc_id", "text", "row_id"]
    assert sorted(r.doc_id for r in got.collect()) == [4, 7, 8, 9, 10]


def brute_stay(rows, shingle=5, similarity=0.8):
    """The ids that stay among (id, text), and the least ids of their groups, by comparing all sets."""
    sets = []
    for _, text in rows:
        w = [x.lower() for x in text.split()]
        sets.append({" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    label = {i: i for i, _ in rows}
    for i, (x, _) in enumerate(rows):
        for j, (y, _) in enumerate(rows[:i]):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common) and label[x] != label[y]:
                gone, to = max(label[x], label[y]), min(label[x], label[y])
                label = {k: to if v == gone else v for k, v in label.items()}
    return sorted(set(label.values()))


def versions(rng, words, count, edits):
    """Versions of words with single words changed: as many as edits says, drawn for each."""
    out = []
    for k in range(count):
        other = list(words)
        for at in rng.choice(len(words), rng.integers(*edits), replace=False):
            other[at] = f"x{k}y{at}"
        out.append(" ".join(other))
    return out


def test_versions_around_the_threshold_are_all_compared(spark):
    rng = np.random.default_rng(8)
    rows = []
    for count in (3, 20, 60, 100):
        words = [f"w{i}" for i in rng.integers(0, 9000, 300)]
        rows += [(len(rows) + i, t) for i, t in enumerate(versions(rng, words, count, (2, 9)))]
    got = simhash.near_duplicates_dropped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == brute_stay(rows)


def test_pairs_beyond_the_bits_are_found(spark):
    rng = np.random.default_rng(9)
    rows, far = [], 0
    while far < 4:
        words = [f"w{i}" for i in rng.integers(0, 9000, 300)]
        pair = [" ".join(words), versions(rng, words, 1, (5, 7))[0]]
        if bin(brute_print(pair[0], 5) ^ brute_print(pair[1], 5)).count("1") >= 15:
            rows += [(len(rows) + i, t) for i, t in enumerate(pair)]
            far += 1
    got = simhash.near_duplicates_dropped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == brute_stay(rows) == [0, 2, 4, 6]


def test_fingerprints_of_sets_count_a_repeated_line_once(spark):
    rng = np.random.default_rng(10)
    words = [f"w{i}" for i in rng.integers(0, 9000, 300)]
    line = [f"v{i}" for i in range(8)]
    texts = [" ".join(words + line), " ".join(words + line * 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = (r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs, 5, ["doc_id"], sets=True).orderBy("doc_id").collect())
    assert bin(a ^ b).count("1") <= 8 < bin(brute_print(texts[0], 5) ^ brute_print(texts[1], 5)).count("1")
    assert [r.doc_id for r in simhash.near_duplicates_dropped(docs).collect()] == [0]


def test_many_short_versions_and_a_large_group(spark, tmp_path):
    rng = np.random.default_rng(15)
    rows = []
    for count, length, edits in [(24, 60, (0, 4))] * 25 + [(400, 120, (1, 6))]:
        words = [f"w{i}" for i in rng.integers(0, 9000, length)]
        rows += [(len(rows) + i, t) for i, t in enumerate(versions(rng, words, count, edits))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "docs"))
    got = simhash.near_duplicates_dropped(spark.read.parquet(str(tmp_path / "docs")))
    assert sorted(r.doc_id for r in got.collect()) == brute_stay(rows)


def test_first_keys_are_the_least_that_are_shared():
    rng = np.random.default_rng(16)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = a ^ np.uint64(1 << 5) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    b[:50] = rng.integers(0, 2**63, 50).astype(np.uint64)
    own = [{*()} for _ in a], [{*()} for _ in a]
    for fps, sets in zip((a, b), own):
        for rows, keys in simhash.fuzzy_keys(fps, 8, 2):
            for r, k in zip(rows.tolist(), keys.tolist()):
                sets[r].add(k)
    assert simhash.first_keys(a, b, 8, 2).tolist() == [min(x & y, default=-1) for x, y in zip(*own)]
