"""SimHash near-duplicates: fingerprints, candidates by Golay keys of fingerprint segments, verification, components.

With at most k differing bits over m = k // 3 + s segments, at most k // 3 segments have three or more of them; the
other s have at most two each, which a shared Golay key survives. So each choice of s segments gives a slot, a
fingerprint has the products of its segments' keys in each slot, and equal keys in a slot are candidates.
Candidates are verified by their distance, or by the Jaccard similarity of their shingles; pairs of that similarity which
fingerprints do not bring together are met by their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesift.llm import golay, shingles
from bytesift.llm.common import among, bounded_batches, cut, free_name, with_row_id

BITS = 64
#: Keyed rows looked at at once; members of a key that are compared in one task.
VERIFY_ROWS, BLOCK_MEMBERS = 1 << 18, 1 << 14
#: Bits of the bitmaps that tell how many shingles two texts don't share, at least.
PARITY = 1024
#: Shingles that a task counts at once, and common shingles that are held at most.
COUNTED, COMMON = 1 << 21, 1 << 18


def _each(texts: pa.Array, shingle: int, sets: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Run by run of texts: hashes, the number of them in each text, digests; with sets the hashes are sorted and without repeats."""
    for hashes, many, marks in shingles.shingles(texts, shingle, digest=sets):
        yield (*(shingles.distinct(hashes, many) if sets else (hashes, many)), marks)


def fingerprints(docs: DataFrame, shingle: int, keep: list[str], sets: bool = False) -> DataFrame:
    """The columns keep of docs (with text) and fp, the fingerprint as a signed long. No words: 0.

    sets: fingerprints are of distinct shingles, n is their number, parity a bitmap of them, and mark tells the words of a
    text from those of others.
    """
    bounded_batches(docs.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [*keep, "fp", *(["n", "parity", "mark"] if sets else [])]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for h, n, marks in _each(b.column(len(keep)), shingle, sets):
                out = [*(b.column(i).slice(done, len(n)) for i in range(len(keep))), pa.array(shingles.majority(h, n).view(np.int64))]
                if sets:
                    out += [pa.array(n, pa.int32()), pa.array([p.tobytes() for p in shingles.parities(h, n, PARITY)], pa.binary()), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=names)
                done += len(n)

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select(*keep, text).mapInArrow(prints, ", ".join(f"{c} {types[c]}" for c in keep) + ", fp long" + ", n int, parity binary, mark binary" * sets)


def shingle_sets(docs: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    """The columns keep of docs (with text) and s, the hashes of the text's distinct shingles."""
    bounded_batches(docs.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for h, n, _ in _each(b.column(len(keep)), shingle, True):
                own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(done, len(n)) for i in range(len(keep))), own], names=[*keep, "s"])
                done += len(n)

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select(*keep, text).mapInArrow(sets, ", ".join([*(f"{c} {types[c]}" for c in keep), "s array<long>"]))


def slots(max_bits: int, chosen: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """The segments (low bit, width) and the slots, each a choice of segments."""
    m = max_bits // (golay.TOLERANCE + 1) + chosen
    cuts = [BITS * i // m for i in range(m + 1)]
    if max(b - a for a, b in zip(cuts, cuts[1:])) > golay.LENGTH:
        raise ValueError("a segment is longer than a codeword; choose more segments")
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])], list(combinations(range(m), chosen))


def fuzzy_keys(fp: np.ndarray, max_bits: int, chosen: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) pairs of fingerprints, slot by slot."""
    segments, choices = slots(max_bits, chosen)
    own = [golay.keys(((fp >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64)) for a, w in segments]
    for slot, choice in enumerate(choices):
        for picks in product(range(6), repeat=chosen):
            row = np.flatnonzero(np.logical_and.reduce([own[s][:, p] >= 0 for s, p in zip(choice, picks)]))
            key = np.full(len(row), slot, np.int64)
            for s, p in zip(choice, picks):
                key = key << 12 | own[s][row, p]
            yield row, key


def first_keys(a: np.ndarray, b: np.ndarray, max_bits: int, chosen: int) -> np.ndarray:
    """The least key that each pair of fingerprints shares; -1 if there is none."""
    if len(a) > 4096:
        return np.concatenate([first_keys(a[i : i + 4096], b[i : i + 4096], max_bits, chosen) for i in range(0, len(a), 4096)])
    segments, choices = slots(max_bits, chosen)
    least = []
    for low, width in segments:
        x, y = (golay.keys(((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)) for fp in (a, b))
        shared = np.where((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0), x[:, :, None], 1 << 12)
        least.append(shared.min((1, 2)).astype(np.int64))
    out = np.full(len(a), -1, np.int64)
    for slot, choice in enumerate(choices):
        key = np.full(len(a), slot, np.int64)
        for s in choice:
            key = key << 12 | least[s]
        own = (out < 0) & np.logical_and.reduce([least[s] < 1 << 12 for s in choice])
        out[own] = key[own]
    return out


def _nearest_forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fp, nearest links first, by growing trees; memory grows with fp only."""
    n, links = len(fp), []
    best, via, open_ = np.full(n, BITS + 1, np.int16), np.zeros(n, np.int64), np.ones(n, bool)
    for _ in range(n):
        i = int(np.argmin(np.where(open_, best, BITS + 2)))
        if best[i] <= max_bits:
            links.append((int(via[i]), i))
        open_[i] = False
        d = np.bitwise_count(fp ^ fp[i]).astype(np.int16)
        closer = open_ & (d < best) & (d <= max_bits)
        best[closer], via[closer] = d[closer], i
    return links


def links_within(key: np.ndarray, fp: np.ndarray, max_bits: int, small: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links among rows with equal keys (sorted): per key a spanning forest of all its links, nearest first."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(first, append=len(key))
    left, right, dist = [], [], []
    group = np.repeat(np.arange(len(first)), sizes)
    at = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= small)) if len(key) else np.zeros(0, np.int64)
    step = 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[group[at + step] == group[at]]
        d = np.bitwise_count(fp[at] ^ fp[at + step])
        near = d <= max_bits
        left.append(at[near]), right.append(at[near] + step), dist.append(d[near])
        step += 1
    a, b, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, dist))
    # Where a key has as many links as members, only a forest of them is kept.
    links = np.bincount(group[a], minlength=len(first)) if len(a) else np.zeros(len(first), np.int64)
    dense = links[group[a]] >= sizes[group[a]] if len(a) else np.zeros(0, bool)
    out = [(a[~dense], b[~dense])]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    order = np.argsort(d[dense], kind="stable")
    for x, y in zip(a[dense][order].tolist(), b[dense][order].tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            out.append((np.array([x]), np.array([y])))
    for g in np.flatnonzero(sizes > small).tolist():
        found = _nearest_forest(fp[first[g] : first[g] + sizes[g]], max_bits)
        if found:
            x, y = np.array(found).T + first[g]
            out.append((x, y))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


LINK = "a long, b long, key long, block int"


def _verify(max_bits: int, chosen: int, block: int):
    """Keyed rows, sorted by key -> links (a, b); members of a key beyond one block also come out with the block's number.

    A key hands on the links whose first key it is: two nodes whose link it keeps back meet under a lesser key, where
    its links connect them, or keep theirs back for a lesser one still.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows, blocks, last = 0, 0, None

        def out(a, b, key, blk) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64()), pa.array(blk, pa.int32())], names=["a", "b", "key", "block"])

        def links(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            fp = part[2].view(np.uint64)
            a, b = links_within(part[0], fp, max_bits)
            first = first_keys(fp[a], fp[b], max_bits, chosen) == part[0][a]
            a, b = a[first], b[first]
            if len(a):
                none = np.full(len(a), -1)
                yield out(part[1][a], part[1][b], none, none)

        def members(part: np.ndarray, number: int) -> pa.RecordBatch:
            return out(part[1], part[2], part[0], np.full(part.shape[1], number))

        for batch in batches:
            part = np.stack([batch.column(i).to_numpy() for i in range(3)])
            held.append(part)
            rows += part.shape[1]
            if rows < VERIFY_ROWS:
                continue
            now = np.concatenate(held, axis=1)
            tail = int(np.searchsorted(now[0], now[0, -1]))  # the last key may go on
            if last is not None and now[0, 0] != last:
                blocks = 0
            yield from links(now[:, :tail])
            if last is not None and blocks and tail and now[0, 0] == last:
                end = int(np.searchsorted(now[0], last, "right"))
                yield members(now[:, :end], blocks)
                blocks = 0
            rest = now[:, tail:]
            last = int(now[0, -1])
            if tail:
                blocks = 0
            while rest.shape[1] >= block:
                yield from links(rest[:, :block])
                yield members(rest[:, :block], blocks)
                blocks, rest = blocks + 1, rest[:, block:]
            held, rows = [rest], rest.shape[1]
        if rows:
            now = np.concatenate(held, axis=1)
            yield from links(now)
            if blocks and now[0, 0] == last:
                yield members(now[:, : int(np.searchsorted(now[0], last, "right"))], blocks)

    return verify


def _across(max_bits: int, chosen: int):
    """Links between two blocks of one key, and within them once more, whose first key it is."""

    def across(group):
        import pandas as pd

        fp = group["b"].to_numpy(np.int64).view(np.uint64)
        found = np.array(_nearest_forest(fp, max_bits), dtype=np.int64).reshape(-1, 2)
        node = group["a"].to_numpy(np.int64)
        found = found[first_keys(fp[found[:, 0]], fp[found[:, 1]], max_bits, chosen) == group["key"].iloc[0]]
        return pd.DataFrame({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    return across


def candidate_links(nodes: DataFrame, max_bits: int, chosen: int, block: int = BLOCK_MEMBERS) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints differ in at most max_bits: enough of them to connect whatever is linked.

    nodes: node, fp, one row a node. A key's members are compared in one task up to a block of them; a key with
    more is cut into blocks, and each pair of blocks is compared in a task of its own.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            for row, key in fuzzy_keys(fp.view(np.uint64), max_bits, chosen):
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[row]), pa.array(fp[row])], names=["key", "node", "fp"])

    keyed = nodes.select("node", "fp").mapInArrow(spread, "key long, node long, fp long")
    found = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(max_bits, chosen, block), LINK))
    links = found.filter("block < 0").select("a", "b")
    crowd = found.filter("block >= 0")
    if not crowd.isEmpty():
        numbers = cut(crowd.groupBy("key").agg(F.max("block").alias("top")))
        pairs = crowd.join(numbers, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("top")))).filter("other <> block")
        pairs = pairs.select("a", "b", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        links = links.unionByName(pairs.groupBy("key", "i", "j").applyInPandas(_across(max_bits, chosen), "a long, b long"))
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for each node with a link, by alternating large and small stars.

    links: a, b with a > b. Each step writes to the shared folder, and no step gathers a node's neighbours: a node with
    many is one row of a minimum, and one side of a join that can be split.
    """
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    links = cut(links)
    now = state(links)
    most = 2 * now[0]  # rows of any step
    while now[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), most)
        large = cut(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), most)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), most)
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), most)
        before, now = now, state(links)
        if now == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id for each row of docs.

    Fingerprints link at max_bits or fewer differing bits; component_id is the smallest doc_id that can be reached.
    Null texts and texts without words have fingerprint 0 and link like any other. A null doc_id is passed over
    by the minimum. Repeated rows each get a row; other columns are not read; no rows give no rows.
    """
    prints = cut(fingerprints(docs.select("doc_id", "text"), shingle, ["doc_id"]))
    nodes = cut(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")))
    chosen = 2 if max_bits <= 4 else 1
    labels = components(candidate_links(nodes.withColumn("fp", F.col("node")), max_bits, chosen))
    labelled = cut(nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")))
    least = cut(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
    of = labelled.select("node", "label").join(least, "label").select(F.col("node").alias("fp"), "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _ranks(values: np.ndarray, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The count of each value in common (rows hash, count, sorted by hash; seen: a bit for each value of their low bits), or 0."""
    out = np.zeros(len(values), np.int64)
    may = np.flatnonzero(seen[(values & np.uint64(len(seen) - 1)).astype(np.int64)])
    if len(may):
        at = np.minimum(np.searchsorted(common[0], values[may]), common.shape[1] - 1)
        out[may] = np.where(common[0][at] == values[may], common[1][at], 0).astype(np.int64)
    return out


def prefix_size(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles of a set of n are enough to meet any set of that similarity, whatever the order of all shingles."""
    return np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)


def prefixes(docs: DataFrame, shingle: int, similarity: float, common: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """The columns keep of docs (with text), n (distinct shingles) and prefix: the first of its shingles, rarest first.

    Under one order of all shingles - those of `common` (hash, count) last, by count; else by hash - two sets of that similarity
    share one within n - ceil(similarity * n) + 1 of each. Any order is right; a good one gives few candidates.
    """
    bounded_batches(docs.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    known = np.array(sorted((h & (1 << 64) - 1, c) for h, c in common), np.uint64).reshape(-1, 2).T.copy()
    seen = np.zeros(1 << 22, bool)
    seen[(known[0] & np.uint64(len(seen) - 1)).astype(np.int64)] = True

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for h, n, _ in _each(b.column(len(keep)), shingle, True):
                row = np.repeat(np.arange(len(n)), n)
                h = h[np.argsort(row << 32 | _ranks(h, known, seen), kind="stable")]
                size = prefix_size(n, similarity)
                own = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(size, n)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(h[own].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(done, len(n)) for i in range(len(keep))), pa.array(n, pa.int32()), prefix], names=[*keep, "n", "prefix"])
                done += len(n)

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select(*keep, text).mapInArrow(first, ", ".join(f"{c} {types[c]}" for c in keep) + ", n int, prefix array<long>")


def common_shingles(docs: DataFrame, shingle: int) -> list[tuple[int, int]]:
    """(hash, count) of the most frequent shingles of docs (text), up to COMMON. Only the order of shingles hangs on them.

    Each task counts the shingles of its own texts, COUNTED at a time, and hands on those that recur there; what recurs in no
    such run of texts is rare enough.
    """

    def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts(held: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

        held: list[np.ndarray] = []
        for b in batches:
            for h, _, _ in _each(b.column(0), shingle, True):
                held.append(h)
                if sum(map(len, held)) >= COUNTED:
                    yield counts(held)
                    held = []
        if held:
            yield counts(held)

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    counts = docs.select(text).mapInArrow(recurring, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 2")
    return [(r.h, r.n) for r in counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are sorted by the first one, in parts of about VERIFY_ROWS that end where a key ends."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < VERIFY_ROWS:
            continue
        now = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = now.column(0).to_numpy()
        tail = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if tail:
            yield now.slice(0, tail)
        held, rows = [now.slice(tail)], now.num_rows - tail
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, other, at), sorted by key and label, those (key, node, at) whose key has two labels or more."""
    for part in _by_key(batches):
        key, node, other, at = (c.to_numpy() for c in part.columns)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        last = np.append(first[1:], len(key)) - 1
        label = node ^ other
        own = np.repeat(label[first] != label[last], last - first + 1)
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in (key, node, at)], names=["key", "node", "at"])


def prefix_pairs(key: np.ndarray, label: np.ndarray, n: np.ndarray, at: np.ndarray, parity: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of rows with equal keys and other labels whose sets may have that similarity. Rows are sorted by key, then label."""
    change = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(change) - 1
    end = np.append(np.flatnonzero(change)[1:], len(key))[group]
    run = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (label[1:] != label[:-1])])) - 1
    after = np.cumsum(np.bincount(run))[run]  # where the next label begins
    many = end - after
    rows = np.flatnonzero(many)
    ends = np.concatenate([[0], np.cumsum(many[rows])])
    for i, j in shingles.runs(ends, VERIFY_ROWS):
        own = rows[i:j]
        a = np.repeat(own, many[own])
        b = np.arange(len(a)) - np.repeat(np.cumsum(many[own]) - many[own], many[own]) + after[a]
        least = np.ceil(similarity * (n[a] + n[b]) / (1 + similarity) - 1e-9).astype(np.int64)  # what similar sets share
        # Sets share no more than this key and what is behind it in both, if it is their first.
        may = np.minimum(n[a] - at[a], n[b] - at[b]) >= least
        a, b, least = a[may], b[may], least[may]
        for k in range(0, len(a), 1 << 16):
            x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            apart = np.bitwise_count(parity[x] ^ parity[y]).sum(1)
            near = apart <= n[x] + n[y] - 2 * least[k : k + (1 << 16)]
            yield x[near], y[near]


def prefix_links(docs: DataFrame, heads: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes with other labels that may have that similarity: none that has is missing.

    docs: rid, text. heads: rid, node, label, n, parity, one row a node. First the keys that two labels share are found; then
    their nodes meet with all that tells them apart, so that few pairs come out.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_key(batches):
            key, node, label, n, at = (part.column(i).to_numpy() for i in range(5))
            ends, data = shingles.buffers(part.column(5))
            parity = np.ascontiguousarray(data[ends[0] : ends[-1]]).view(np.uint64).reshape(len(key), -1)
            for a, b in prefix_pairs(key, label, n.astype(np.int64), at, parity, similarity):
                if len(a):
                    both = np.unique(np.sort(np.stack([node[a], node[b]]), axis=0), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[1]), pa.array(both[0])], names=["a", "b"])

    first = prefixes(docs, shingle, similarity, common_shingles(docs, shingle), ["rid"]).join(heads.select("rid", "node", "label"), "rid")
    # Most labels are the node itself; as a difference they cost next to nothing.
    keyed = first.select(F.posexplode("prefix").alias("at", "key"), "node", F.col("node").bitwiseXOR(F.col("label")).alias("other"))
    sorted_ = keyed.select("key", "node", "other", F.col("at").cast("long").alias("at")).repartition("key").sortWithinPartitions("key", F.col("node").bitwiseXOR(F.col("other")))
    met = cut(sorted_.mapInArrow(recurring, "key long, node long, at long")).join(heads.select("node", "label", "n", "parity"), "node")
    met = met.select("key", "node", "label", "n", "at", "parity").repartition("key").sortWithinPartitions("key", "label")
    return met.mapInArrow(pairs, "a long, b long").distinct()


def near_duplicates_dropped(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 8) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest doc_id stays (null ids last; among equal ids one row).

    Texts link at a Jaccard similarity of their sets of shingles of `shingle` words of `similarity` or more, and a group is what
    links connect. First links are sought along a forest of fingerprints that differ in at most max_bits; then every pair
    that these leave in two groups is met by prefix filtering, so no link is lost and max_bits is a matter of speed.
    Texts with equal words are one node, told apart by 128 bits. Null texts and texts without words are one group. Very long
    texts are read whole. Repeated rows are one node too, and one of them stays. No rows give no rows. docs must be a
    deterministic scan, for rows are found again by their place in it; its columns may have any names.
    """
    rid = free_name(docs, "row_id")
    marked = with_row_id(docs, rid)
    rows = marked.select(F.col(rid).alias("rid"), "doc_id", F.col("text"))
    prints = cut(fingerprints(rows, shingle, ["rid", "doc_id"], sets=True))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid")))
    nodes = cut(prints.groupBy("mark").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("parity").alias("parity"), first.alias("first")).select(F.col("first.rid").alias("node"), "fp", "n", "parity", "first"))

    def alike(links: DataFrame) -> DataFrame:
        """Those of links (a, b) whose shingle sets are similar enough."""
        # Sets whose sizes differ by more can't be so similar; what is left goes to the shingles themselves.
        na, nb = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
        links = links.join(na, "a").join(nb, "b")
        links = cut(links.filter(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb")).select("a", "b"))
        n = links.count()
        ends = cut(links.select(F.col("a").alias("rid")).union(links.select("b")).distinct(), 2 * n)
        sets = cut(shingle_sets(among(rows, "rid", ends), shingle, ["rid"]))
        x, y = (sets.select(F.col("rid").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
        common = F.size(F.array_intersect("sa", "sb"))
        return cut(links.join(x, "a").join(y, "b").filter(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b"), n, 1000)

    near = alike(candidate_links(nodes, max_bits, 2))
    heads = nodes.join(components(near), "node", "left").select(F.col("node").alias("rid"), "node", F.coalesce("label", "node").alias("label"), "n", "parity")
    labels = components(near.unionByName(alike(prefix_links(rows.select("rid", "text"), cut(heads), shingle, similarity))))
    labelled = cut(nodes.join(labels, "node", "left").select("first", F.coalesce("label", "node").alias("label")))
    stay = labelled.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
    gone = cut(prints.select("rid").join(stay, "rid", "left_anti")).withColumnRenamed("rid", rid)
    return among(marked, rid, gone, inside=False).select(*[F.col(f"`{c}`") for c in docs.columns])
