"""Exact top-k by integer inner products: norm-sorted, with rotated partial sums and Cauchy-Schwarz bounds.

Vectors are met in descending length. Coordinates are rotated by the singular vectors of a sample, so that the leading ones
carry most; they are summed in stages, and after each the rest is bounded by the product of the two residual lengths. What
cannot reach a query's k-th score, known from the start from a sample, is not looked at in the next stage, and once
length times length cannot, nothing that follows is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesift.llm.common import cut
from bytesift.llm.vectors import best, dimensions, grid, groups, matrix, packed, sample

#: Vectors that the first bounds are taken from: a share of all. Squared length that the stages leave, as shares of all.
FLOOR_SHARE, LEFT = 1 / 16, (0.5, 0.25, 0.12, 0.06)
#: Vectors and queries of a cell; queries and vectors that are compared at once; pairs beyond which a stage is summed densely, as a share.
SHARD_ROWS, BLOCK_QUERIES, CHUNK_QUERIES, CHUNK_ROWS, DENSE = 16_384, 8192, 256, 1024, 0.25
#: Sums below this are exact in doubles.
EXACT = float(1 << 53)
TOP = np.iinfo(np.int64)


def rotation(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Right singular vectors of x as columns, by descending singular value, and the dimensions at which stages end.

    Any orthogonal matrix and any stages are right; these prune.
    """
    y = x / (np.abs(x).max(initial=0) or 1)
    _, power, turn = np.linalg.svd(y.T @ y)  # memory does not grow with the rows of x
    left = 1 - np.cumsum(power) / (power.sum() or 1)
    stops = {int(np.searchsorted(-left, -share)) + 1 for share in LEFT}
    return turn.T, sorted(s for s in stops if s < len(power))


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles; where that is no double, x itself, as big as it is."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    return out if np.isfinite(out).all() else x


def exact_scores(q: np.ndarray, x: np.ndarray, scale: float) -> np.ndarray:
    """Inner products of pairs of rows of floor(scale * component), in Python integers, held to 64 bits."""

    def ints(row: np.ndarray) -> list[int]:
        # Beyond 2^53 a double is an integer, and so is its product.
        return [int(v) * int(scale) if abs(v) >= EXACT and scale == int(scale) else int(np.floor(scale * v)) for v in row.tolist()]

    return np.array([min(max(sum(i * j for i, j in zip(ints(u), ints(v))), TOP.min), TOP.max) for u, v in zip(q, x)], np.int64)


def top_k(q: np.ndarray, x: np.ndarray, tie: np.ndarray, k: int, turn: np.ndarray, stops: list[int], scale: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """(query, index into x, score) of each query's k highest, ties to the lower `tie`, and the work done: pairs, terms, products.

    floor: what a query's k-th score is at least, as far as known. terms: products of two components; products: whole inner products.
    """
    with np.errstate(over="ignore"):
        plain = scale * np.abs(q).max(initial=0) * scale * np.abs(x).max(initial=0) * q.shape[1] < EXACT
    qi, xi = whole(q, scale), whole(x, scale)
    sq, sx = np.abs(qi).max(initial=0) or 1.0, np.abs(xi).max(initial=0) or 1.0
    with np.errstate(over="ignore"):
        unit = sq * sx * (1.0 if qi is not q else scale) * (1.0 if xi is not x else scale)
    # Lengths and sums in units in which no square overflows. Rounding of the bounds is far below 1e-9 of the lengths.
    qr, xr = (qi / sq) @ turn, (xi / sx) @ turn
    ql, xl = np.sqrt((qr * qr).sum(1)), np.sqrt((xr * xr).sum(1))
    order = np.lexsort((tie, -xl))
    xr, xl = xr[order], xl[order]
    ends = [*stops, q.shape[1]]
    q_rest, x_rest = ([np.sqrt((m[:, e:] ** 2).sum(1)) for e in ends] for m in (qr, xr))
    work = {"pairs": len(q) * len(x), "terms": 0, "products": 0}
    found = []
    for a in range(0, len(q), CHUNK_QUERIES):
        mine = np.arange(a, min(a + CHUNK_QUERIES, len(q)))
        least = np.full(len(mine), -np.inf) if floor is None else floor[mine].astype(float)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, place in order, score
        at, step = 0, min(64, CHUNK_ROWS) if floor is None else CHUNK_ROWS
        while at < len(order):
            to = min(at + step, len(order))
            slack = 1e-9 * ql[mine] * xl[at] + 1e-12
            with np.errstate(invalid="ignore"):
                need = np.where(least > TOP.min, least / unit, -np.inf) - slack
            live = np.flatnonzero(ql[mine] * xl[at] >= need)
            if not len(live):
                break
            own = mine[live]
            part = np.zeros((len(live), to - at))
            may = np.ones(part.shape, bool)
            begin, pairs = 0, None
            for s, end in enumerate(ends):
                if pairs is None:
                    part += qr[own, begin:end] @ xr[at:to, begin:end].T
                    work["terms"] += part.size * (end - begin)
                    may = part + q_rest[s][own][:, None] * x_rest[s][at:to] >= need[live][:, None]
                    if may.mean() < DENSE:
                        pairs = np.nonzero(may)
                        sums = part[pairs]
                else:
                    i, j = pairs
                    sums = sums + np.einsum("ij,ij->i", qr[own[i], begin:end], xr[at + j, begin:end])
                    work["terms"] += len(i) * (end - begin)
                    stay = sums + q_rest[s][own[i]] * x_rest[s][at + j] >= need[live[i]]
                    pairs, sums = (i[stay], j[stay]), sums[stay]
                begin = end
            i, j = np.nonzero(may) if pairs is None else pairs
            if len(i):
                work["products"] += len(i)
                u, v = own[i], order[at + j]
                score = np.einsum("ij,ij->i", qi[u], xi[v]).astype(np.int64) if plain else exact_scores(q[u], x[v], scale)
                who, place, score = (np.concatenate(z) for z in zip(held, (live[i], at + j, score)))
                by = np.lexsort((tie[order[place]], ~score, who))
                who, place, score = who[by], place[by], score[by]
                first = np.searchsorted(who, np.arange(len(mine) + 1))
                rank = np.arange(len(who)) - first[who]
                held = tuple(z[rank < k] for z in (who, place, score))
                full = np.flatnonzero(np.diff(first) >= k)
                least[full] = np.maximum(least[full], score[first[full] + k - 1])
            at, step = to, min(2 * step, CHUNK_ROWS)
        found.append((mine[held[0]], order[held[1]], held[2]))
    return *(np.concatenate(z) if found else np.zeros(0, np.int64) for z in (zip(*found) if found else ((), (), ()))), work


def floors(q: np.ndarray, x: np.ndarray, k: int, scale: float) -> np.ndarray:
    """What the k-th highest score of each query is at least: its k-th highest in x; the least number where that isn't exact."""
    out = np.full(len(q), TOP.min, np.int64)
    with np.errstate(over="ignore"):
        plain = scale * np.abs(q).max(initial=0) * scale * np.abs(x).max(initial=0) * q.shape[1] < EXACT
    if plain and len(x) >= k:
        a, b = np.floor(scale * q), np.floor(scale * x).T
        for i in range(0, len(q), CHUNK_QUERIES):
            out[i : i + CHUNK_QUERIES] = np.partition(a[i : i + CHUNK_QUERIES] @ b, len(x) - k, 1)[:, len(x) - k].astype(np.int64)
    return out


def search(vectors: DataFrame, is_query, scale: float = 1024.0, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with is_query(vec_id) the k other rows with the highest inner products
    of floor(scale * component).

    Vectors that are null or hold null or non-finite components take no part; zero and empty ones do. Shorter vectors count as
    padded with zeros. Of rows with equal ids each is a candidate, and a query of its own. Copies of a vector are one candidate up to
    the last step. Ties go to the smaller vec_id. Scores beyond 64 bits are held to the nearest that fits, components of any finite
    size being whole numbers. Other columns are not read. No rows give no rows.
    """
    rows, kind = packed(vectors, id_col, vector_col, zeros=True)
    heads, members = groups(rows, k)
    dims = dimensions(rows, kind)
    drawn = matrix(sample(heads, share=FLOOR_SHARE), dims, kind)
    turn, stops = rotation(drawn if len(drawn) else np.zeros((1, dims)))
    ids = dict(rows.dtypes)["vec_id"]

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(floor=floors(matrix(b["v"], dims, kind), drawn, k + 1, scale))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"qid": [], "query_id": [], "gid": [], "vec_id": [], "score": []})
        x = x.sort_values(["vec_id", "gid"], kind="stable", na_position="last")
        u, v, score, _ = top_k(matrix(y["v"], dims, kind), matrix(x["v"], dims, kind), np.arange(len(x)), k + 1, turn, stops, scale, y["floor"].to_numpy())
        return pd.DataFrame({"qid": y["qid"].to_numpy()[u], "query_id": y["query_id"].to_numpy()[u], "gid": x["gid"].to_numpy()[v], "vec_id": x["vec_id"].to_numpy()[v], "score": score})

    queries = rows.filter(is_query(F.col("vec_id"))).select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"), "v")
    queries = cut(queries.mapInPandas(bounded, f"qid long, query_id {ids}, v binary, floor long"))
    x, y = grid(heads, queries, shard_rows, block_queries)
    found = x.groupBy("shard", "block").cogroup(y.groupBy("shard", "block")).applyInPandas(run, f"qid long, query_id {ids}, gid long, vec_id {ids}, score long")
    return best(found, members, k)
