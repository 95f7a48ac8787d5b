"""Best-fit packing of token sequences, with certified bin counts.

Pieces are dealt to partitions. Each partition packs by best-fit decreasing and bounds its number of bins from
below by dual feasible functions. A partition that meets its bound is certified and settles all bins but its
emptiest; one with a gap settles its full bins. The documents of the other bins are exchanged - dealt anew among
fewer partitions - and packed again, until one partition is left or a round settles nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesift.llm.common import bounded_batches, cut
from bytesift.llm.encoders import byte_level_encoder

#: Pieces that one partition packs; what a task holds is bounded by it.
PARTITION_PIECES = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """Where a document of n ids is cut: whole if it fits, else full pieces after a first one that takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((a, a + capacity) for a in range(first, n, capacity))]


def encode_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: its ids, then end_id, cut only if they exceed capacity. with_ids adds the ids."""
    bounded_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_level_encoder(tokenizer_path)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = encoder(text) + end
                for k, (x, y) in enumerate(cut_points(len(ids) // 4, capacity)):
                    own = ids[4 * x : 4 * y]
                    out.append((doc, k, x, y - x, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype("int64")] if with_ids else [])))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(pieces, PIECES + (", ids array<long>" if with_ids else ""))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and the offset of each size, and the number of bins. Residual capacities are bits of one integer, so a best fit is one bit scan."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fit = mask >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            own = open_bins[left].pop()
            if not open_bins[left]:
                mask &= ~(1 << left)
        else:
            left, own, n = capacity, n, n + 1
        bins[i], offsets[i] = own, capacity - left
        left -= size
        open_bins[left].append(own)
        mask |= 1 << left
    return bins, offsets, n


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins. The largest sum over two families of dual feasible functions: one that drops the
    sizes below a threshold and rounds up the large ones, one that rounds to multiples of 1 / k; both hold the plain volume."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    many, volume = np.cumsum(count), np.cumsum(count * x)
    for t in range(capacity // 2 + 1):  # above capacity - t: 1; below t: 0; else x
        large = int(many[capacity] - many[capacity - t])
        middle = int(volume[capacity - t] - (volume[t - 1] if t else 0))
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 101):  # x if (k + 1) x is whole, else floor((k + 1) x) / k, in capacities
        whole = (k + 1) * x % capacity == 0
        scaled = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def _pack(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sizes = group["length"].to_numpy(np.int64)
        bins, offsets, n = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
        gap = n - lower_bound(sizes, capacity)
        # Settled: full bins, and if the count is certified all but the emptiest bin, whose documents may fit elsewhere.
        settled = (fill == capacity) | ((gap == 0) & (np.arange(n) != fill.argmin()))
        return group.assign(bin=bins, offset=offsets, settled=settled[bins], gap=gap)

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = 1024, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """pieces with sequence_id and offset: each piece has its place in one sequence of at most capacity ids.

    pieces: doc_id, piece, start, length (1 to capacity), ids_crc32. Rows are packed each for itself, repeated ones
    and null ids too. Full pieces are sequences already and take no part. An empty table gives an empty result.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = pieces.select(*names)
    number = lambda round_, part, bin_: F.lit(round_ << 52) + part.cast("long") * (1 << 24) + bin_
    done = [pieces.filter(F.col("length") == capacity).select(*names, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool, before = pieces.filter(F.col("length") < capacity), None
    for round_ in count(1):  # a round that settles nothing is the last
        n = pool.count()
        if not n:
            break
        parts = -(-n // partition_pieces)
        # Repeated rows are dealt by their place as well, or they would all meet in one part.
        place = F.monotonically_increasing_id() % 1024
        dealt = pool.withColumn("part", F.pmod(F.xxhash64(F.lit(round_), "doc_id", "piece", "ids_crc32", F.lit("deal"), place), F.lit(parts)).cast("int"))
        packed = cut(dealt.groupBy("part").applyInPandas(_pack(capacity), PIECES + ", part int, bin long, offset long, settled boolean, gap long"))
        placed = packed.select(*names, number(round_, F.col("part"), F.col("bin")).alias("sequence_id"), "offset", "settled")
        if parts == 1 or before is not None and n >= before:
            done.append(placed.drop("settled"))
            break
        before = n
        done.append(placed.filter("settled").drop("settled"))
        pool = packed.filter("NOT settled").select(*names)
    return reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs.

    A null or empty text is the end id alone. Rows with equal or null ids are packed each for itself; very long texts are cut
    into full pieces after a first one with the remainder; other columns are not read; no rows give no rows.
    """
    return pack_pieces(cut(encode_pieces(docs, tokenizer_path, end_id, capacity)), capacity, partition_pieces)
