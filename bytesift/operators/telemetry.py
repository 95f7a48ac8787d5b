"""Figures about searches and tables: rolling percentiles, sizes of filters, what the second tier adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytesift.operators import search
from bytesift.plans.policy import Policy
from bytesift.plans.resolve import Query

#: Samples of a rolling window.
WINDOW = 16


def rolling_percentile(samples: DataFrame, value: str, by: list[str], order: list[str], share: float = 0.95, size: int = WINDOW) -> Column:
    """The nearest-rank percentile of value over a sample and the size - 1 before it, of each series."""
    last = F.sort_array(F.collect_list(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - size, 0)))
    return F.element_at(last, F.greatest(F.ceil(F.size(last) * share), F.lit(1)).cast("int"))


def filter_sizes(docs: DataFrame) -> DataFrame:
    """tier, log2_words, docs, bytes: how many documents have filters of each size."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.col(f"t{t}_log2").alias("log2_words")) for t in (1, 2)]))
    sized = docs.select(each.alias("f")).groupBy("f.tier", "f.log2_words").agg(F.count("*").alias("docs"))
    return sized.withColumn("bytes", F.col("docs") * F.pow(F.lit(2), F.col("log2_words") + 3).cast("long"))


def weighted_quantiles(sizes: DataFrame, shares: list[float]) -> DataFrame:
    """tier, share, log2_words: the smallest size within which lies that share of the tier's documents. sizes: see filter_sizes."""
    up = F.sum("docs").over(Window.partitionBy("tier").orderBy("log2_words"))
    total = F.sum("docs").over(Window.partitionBy("tier"))
    part = sizes.select("tier", "log2_words", (up / total).alias("within"))
    wanted = F.explode(F.array(*map(F.lit, shares)))
    return part.withColumn("share", wanted).filter(F.col("within") >= F.col("share") - 1e-12).groupBy("tier", "share").agg(F.min("log2_words").alias("log2_words"))


def tier_narrowing(docs: DataFrame, queries: list[Query], policy: Policy) -> DataFrame:
    """rule, tier1, tier2, ratio: candidates by the first tier alone, by both, and what share the second lets through."""
    count = lambda q, tiers: F.count_if(search.may_match(q, policy, search.Options(0, tiers=tiers)))
    each = [F.struct(F.lit(q.name).alias("rule"), count(q, frozenset([1])).alias("tier1"), count(q, search.ALL_TIERS).alias("tier2")) for q in queries]
    rows = docs.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return rows.withColumn("ratio", F.when(F.col("tier1") > 0, F.col("tier2") / F.col("tier1")))
