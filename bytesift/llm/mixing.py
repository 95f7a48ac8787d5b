"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target divided by its size is the expected number of copies of each of its rows. The whole copies are
certain; the fraction is an inclusion probability. Within blocks of a source the cube method moves the
probabilities through the null space of two constraints, the block's tokens and its documents, until at most two
stay fractional; those of all blocks meet in new blocks, and so on, until a source has one small landing problem.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytesift.llm.common import WORD, cut, free_name, with_row_id

#: Rows of a block; what a task holds is bounded by it.
BLOCK_ROWS = 4096
#: Sources up to which the table of targets, a few dozen bytes a source, is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 50_000
#: Rows of a source's last block that skip the flight, so that the landing has ways enough to come near the target.
LANDING_ROWS = 12
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """source, source_size, target, ratio, n, and a running number k of each source, by code point with null last.

    sizes: source, size. Sources weigh weights in turn, repeating, and share `share` of all sizes; no target exceeds cap times its source's
    size, and the excess is reshared by weight until none is above: sources in order of cap * size / weight are full as
    long as the level, what is left over the weight that is left, lies above theirs.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    per = per.withColumn("k", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    filling = Window.orderBy((F.col("most") / F.col("weight")).asc(), "k")
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    per = per.withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source whose bound lies above its level sets the level for itself and all after it.
    per = per.withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")), ignorenulls=True).over(everything))
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("most")), F.col("most"))
    per = per.withColumn("target", target).withColumn("ratio", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0)))
    return per.select("source", "source_size", "target", "ratio", "n", "k")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: p, moved until at most two entries lie strictly between 0 and 1, with sum(p) and sum(p * size) as they were.

    Three open units have a direction that keeps both sums; it is followed until one of them closes, either way with
    the probability that keeps every expectation.
    """
    p, s = p.tolist(), size.astype(float).tolist()
    draws = iter(rng.random(len(p)).tolist())
    held: list[int] = []
    for i, x in enumerate(p):
        if not EPS < x < 1 - EPS:
            p[i] = round(x)
            continue
        held.append(i)
        while len(held) >= 3:
            a, b, c = held
            u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min(((1 - p[j]) / v if v > 0 else p[j] / -v) for j, v in zip(held, u) if v)
            down = min((p[j] / v if v > 0 else (1 - p[j]) / -v) for j, v in zip(held, u) if v)
            step = up if next(draws) * (up + down) < down else -down
            still = []
            for j, v in zip(held, u):
                x = p[j] + step * v
                if EPS < x < 1 - EPS:
                    p[j] = x
                    still.append(j)
                else:
                    p[j] = float(round(x))
            held = still if len(still) < 3 else still[:2]  # a step always closes one; this only guards rounding
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The landing: of all ways to close the few open units, the one nearest to their tokens, then to their number."""
    i = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    p = p.copy()
    ways = (np.arange(2 ** len(i))[:, None] >> np.arange(len(i))) & 1
    off = np.abs(ways @ size[i] - p[i] @ size[i])
    p[i] = ways[np.lexsort((np.abs(ways.sum(1) - p[i].sum()), off))[0]]
    return p


def _fly(level: int, seed: int):
    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "size"], kind="stable")
        p, size = group["p"].to_numpy(float), group["size"].to_numpy(float)
        rng = np.random.default_rng([seed, level, int(group["k"].iloc[0]), int(group["block"].iloc[0])])
        last = group["blocks"].iloc[0] == 1
        aside = np.flatnonzero((p > EPS) & (p < 1 - EPS))[-LANDING_ROWS:] if last else []
        kept = np.delete(np.arange(len(p)), aside)
        p[kept] = flight(p[kept], size[kept], rng)
        return group.assign(p=land(p, size) if last else p)

    return fly


def mix(rows: DataFrame, block_rows: int = BLOCK_ROWS, seed: int = 0, **shares) -> DataFrame:
    """rows (key, source, size, order) with source_size, target and copies: how often the mix takes each row.

    order, a number that does not depend on how rows lie in files, decides where ties are broken. Copies are the
    floor of the source's ratio or one more. A null source is a source of its own. Sources without words get
    target 0 and no copies. Equal rows are drawn each for itself. No rows give no rows.
    """
    targets = cut(source_targets(rows, **shares))
    n = targets.count()
    table = F.broadcast(targets) if n <= BROADCAST_SOURCES else targets
    joined = rows.join(table.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
    base = F.floor(F.col("ratio") + EPS)
    state = joined.select("key", "source", "size", "order", "source_size", "target", "k", base.cast("int").alias("base"), F.greatest(F.col("ratio") - base, F.lit(0.0)).alias("p"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks"))
    schema = {f.name: f.dataType for f in rows.schema.fields}
    ddl = f"key {schema['key'].simpleString()}, source {schema['source'].simpleString()}, size long, order long, source_size long, target double, k int, base int, p double, blocks long, block long"
    done: list[DataFrame] = []
    most = targets.agg(F.max(F.ceil(F.col("n") / block_rows))).first()[0] or 0
    if block_rows < 8:
        raise ValueError("a block has eight rows at least, or levels would not end")
    for level in count():
        dealt = state.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "order"), F.col("blocks")))
        flown = cut(dealt.groupBy("k", "block").applyInPandas(_fly(level, seed), ddl))
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(flown.filter(~open_))
        if most <= 1:
            break
        # At most two rows of a block stay open, so the next level has so many blocks at most.
        most = -(-2 * most // block_rows)
        state = flown.filter(open_).drop("block").withColumn("blocks", F.ceil(2 * F.col("blocks") / block_rows).cast("long"))
    out = reduce(DataFrame.unionByName, done)
    return out.select("key", "source", "size", "source_size", "target", (F.col("base") + F.round("p").cast("int")).alias("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (words the mix takes) for each row of docs.

    A null text has no words; texts without words are taken no more than their source's ratio says and add nothing. Very long texts are one
    unit each, counted whole. Null ids pass through; a null source is a source of its own; repeated rows are drawn each for itself, but
    as they share their order they also share a block, whose size they alone don't bound. Other columns are not read. No rows give
    no rows. The landing takes the nearest of all ways for the last rows of a source: the flight before it keeps every expectation, the
    landing keeps the total.
    """
    rows = docs.select(F.col("doc_id").alias("key"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("order"))
    return mix(rows, **options).select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with the columns of docs.

    docs must be a deterministic scan (a table or files), for rows are found again by their place in it. Nulls, ties, long texts and empty
    tables are as in mix_documents; columns of docs may have any names.
    """
    rid, times = free_name(docs, "row_id"), free_name(docs, "row_copies")
    marked = with_row_id(docs, rid)
    rows = marked.select(F.col(rid).alias("key"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("order"))
    taken = mix(rows, **options).filter("copies > 0").select(F.col("key").alias(rid), F.array_repeat(F.lit(0), F.col("copies")).alias(times))
    return marked.join(taken, rid).withColumn(times, F.explode(times)).select(*[F.col(f"`{c}`") for c in docs.columns])
