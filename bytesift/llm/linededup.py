"""Line dedup by distinct-site spread. Only DataFrame functions.

Each line's sites are counted by a HyperLogLog sketch per line hash, merged by aggregation. Lines whose estimate is
within the sketch's error of the threshold get an exact distinct count. A line on enough sites is boilerplate; its first
occurrence stays, all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytesift.llm.common import cut, free_name, with_row_id

#: White space that does not tell lines apart at their ends.
BLANKS = " \t\r\x0b\x0c"
#: Boilerplate lines, 16 bytes each, up to which they are broadcast; beyond, they are joined.
BROADCAST_LINES = 100_000
LG_K = 12


def line_keys(line: Column) -> list[Column]:
    """128 bits that stand for a trimmed line."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def boilerplate_keys(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """k1, k2 of the lines (k1, k2, site) that occur on min_sites distinct sites or more. Null sites count for nothing."""
    spread = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    spread = spread.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("sites"))
    error = 3 * 1.04 / 2 ** (lg_k / 2)  # three standard errors of the estimate
    low, high = min_sites * (1 - error) - 0.5, min_sites * (1 + error) + 0.5
    wide = cut(spread.filter(F.col("sites") >= low))
    near = cut(wide.filter(F.col("sites") <= high).select("k1", "k2"))
    # Broadcast, the few near lines leave a very common line to partial counts; joined, its rows would meet in one task.
    near = F.broadcast(near) if near.count() <= BROADCAST_LINES else near
    exact = lines.join(near, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count_distinct("site").alias("sites"))
    return cut(wide.filter(F.col("sites") > high).select("k1", "k2").unionByName(exact.filter(F.col("sites") >= min_sites).select("k1", "k2")))


def dedup_lines(docs: DataFrame, min_sites: int, site: str = "source", lg_k: int = LG_K) -> DataFrame:
    """docs with text rewritten, and n_lines and n_removed (or _n_lines, ... if docs has such columns).

    Lines end at LF and are compared without the white space at their ends; blank lines always stay. Of a
    boilerplate line the occurrence with the smallest doc_id, then position, stays (null ids last; among rows with
    one id the one with the smaller text hash, then the one that is read first). Rows all of whose lines go keep an empty text; null texts stay null. A null site
    counts for nothing, but its lines go like others. Repeated rows are rows of their own, of which the first one keeps its lines. Very
    long texts are split and rewritten whole. Other columns pass through. No rows give no rows. docs must be a deterministic
    scan, for rows are found again by their place in it.
    """
    rid = free_name(docs, "row_id")
    gone_name = free_name(docs, "gone_lines")
    names = [free_name(docs, c) for c in ("n_lines", "n_removed")]
    marked = with_row_id(docs, rid)
    split = F.split(F.col("text"), "\n")
    lines = marked.select(F.col(rid).alias("rid"), "doc_id", F.col(site).cast("string").alias("site"), F.xxhash64("text").alias("th"), F.posexplode(split).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter("line <> ''").select("rid", "doc_id", "site", "th", "pos", *line_keys(F.col("line")))
    wide = boilerplate_keys(lines.select("k1", "k2", "site"), min_sites, lg_k)
    few = wide.count() <= BROADCAST_LINES
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"), F.col("rid"), F.col("pos"))
    found = cut(lines.join(F.broadcast(wide) if few else wide, ["k1", "k2"]).select("k1", "k2", "rid", "pos", place.alias("place")))
    first = cut(found.groupBy("k1", "k2").agg(F.min("place").alias("first")))
    gone = found.join(F.broadcast(first) if few else first, ["k1", "k2"]).filter(~F.col("place").eqNullSafe(F.col("first")))
    gone = gone.groupBy("rid").agg(F.collect_list("pos").alias("gone")).withColumnRenamed("rid", rid).withColumnRenamed("gone", gone_name)
    joined = marked.join(gone, rid, "left")
    took = F.col(gone_name)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), took)
    text = F.when(took.isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    counts = [F.when(x.isNull(), 0).otherwise(F.size(y)).alias(c) for x, y, c in ((F.col("text"), split, names[0]), (took, took, names[1]))]
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *counts)


#: The same in DuckDB, with exact counts throughout.
SQL = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key FROM l),
wide AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {min_sites}),
gone AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS nth
         FROM k WHERE key IN (SELECT key FROM wide)) WHERE nth > 1),
kept AS (SELECT k.doc_id, string_agg(k.line, chr(10) ORDER BY k.pos) AS text FROM k ANTI JOIN gone g ON g.doc_id = k.doc_id AND g.pos = k.pos GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
SELECT d.doc_id, d.source, CAST(coalesce(len(d.ls), 0) AS INT) AS n_lines, CAST(coalesce(n.n_removed, 0) AS INT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
