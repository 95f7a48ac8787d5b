"""Registered queries of the engine with the same in DuckDB SQL, over the driver's tables.

Rule queries scan whole tables exactly; index queries ingest a whole table first and search the index they made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytesift.functions import content as fc
from bytesift.operators import maintenance, search, telemetry
from bytesift.operators.features import feature_rows, shard_of
from bytesift.plans.check import check_frame, check_source
from bytesift.plans.policy import Policy
from bytesift.plans.resolve import compile_source
from bytesift.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: table -> (its id columns, its text column)
TABLES = {"documents": (["doc_id"], "text"), "pages": (["page_id"], "html"), "conversations": (["conv_id", "turn"], "text")}
#: Query time of rules that compare with it.
NOW = 1_700_000_000
#: Passages without five parts that one pass over the texts looks for.
SHORT_BLOCK = 200
#: Bytes of text in one file of a stream's batch.
FILE_TEXT = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def contents(spark: SparkSession, sf_dir: str, table: str = "documents", charset: str = "UTF-8", keep: tuple[str, ...] = ()) -> DataFrame:
    """A table's ids and the bytes of its texts."""
    fc.bounded_batches(spark)
    ids, text = TABLES[table]
    return read(spark, sf_dir, table).filter(F.col(text).isNotNull()).select(*ids, *keep, F.encode(F.col(text), charset).alias("content"))


def rule(name: str, body: str, where: str, table: str = "documents", charset: str = "UTF-8") -> None:
    """Registers the ids of the rows that a rule matches, and the same as a WHERE clause over t (the text) and b (its bytes)."""
    ids, text = TABLES[table]
    source = f"rule r {{ {body} }}"
    QUERIES[name] = lambda spark, sf, q=source, t=table, c=charset: search.scan(contents(spark, sf, t, c), q, now=NOW).select(*TABLES[t][0])
    SQL[name] = f"SELECT {', '.join(ids)} FROM (SELECT *, {text} AS t, encode({text}) AS b FROM {table}) WHERE t IS NOT NULL AND ({where})"


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HAS = lambda s: f"contains(t, '{s}')"
SIZE = "octet_length(b)"

# literals and booleans
rule("lit_ascii", 'strings: $a = "the " condition: $a', HAS("the "))
rule("lit_and", 'strings: $a = "the " $b = "and " condition: $a and $b', f"{HAS('the ')} AND {HAS('and ')}")
rule("lit_or", 'strings: $a = "tion" $b = "ment" condition: $a or $b', f"{HAS('tion')} OR {HAS('ment')}")
rule("lit_and_not", 'strings: $a = "the " $b = "License" condition: $a and not $b', f"{HAS('the ')} AND NOT {HAS('License')}")
rule("lit_nocase", 'strings: $a = "license" nocase condition: $a', "regexp_matches(t, '(?i)license')")
rule("lit_fullword", 'strings: $a = "than" fullword condition: $a', "regexp_matches(t, '(^|[^A-Za-z0-9_])than($|[^A-Za-z0-9_])')")
rule("lit_utf8", 'strings: $a = "été" $b = "über" $c = "ción" condition: any of them', f"{HAS('été')} OR {HAS('über')} OR {HAS('ción')}")
rule("lit_wide", 'strings: $a = "tion" wide condition: $a', HAS("tion"), charset="UTF-16LE")
rule("lit_escape", 'strings: $a = "\\x74\\x68e\\x20" condition: $a', HAS("the "))
rule("lit_anonymous", 'strings: $ = "the " $ = "est " condition: all of them', f"{HAS('the ')} AND {HAS('est ')}")
rule("lit_nocase_wide_fullword", 'strings: $a = "THE" nocase wide fullword condition: $a', "regexp_matches(t, '(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])')", charset="UTF-16LE")
# regular expressions
rule("regex_anchor", "strings: $a = /applic[a-z]+|licensed? under/ condition: $a", "regexp_matches(t, 'applic[a-z]+|licensed? under')")
rule("regex_alt", "strings: $a = /th(an|en|is) / condition: $a", "regexp_matches(t, 'th(an|en|is) ')")
rule("regex_repeat", "strings: $a = /(th){2,3}e[a-z]*t/ condition: $a", "regexp_matches(t, '(th){2,3}e[a-z]*t')")
rule("regex_class", "strings: $a = /[0-9]{3}-[0-9]{4}/ condition: $a", "regexp_matches(t, '[0-9]{3}-[0-9]{4}')")
rule("regex_nocase", "strings: $a = /the +[a-z]+tion\\b/i condition: $a", "regexp_matches(t, '(?i)the +[a-z]+tion([^0-9A-Za-z_]|$)')")
rule("regex_start", "strings: $a = /^The [a-z]/ condition: $a", "regexp_matches(t, '^The [a-z]')")
rule("regex_end", "strings: $a = /tion\\.$/ condition: $a", "regexp_matches(t, 'tion\\.$')")
rule("regex_dot", "strings: $a = /the.{1,4}and/ condition: $a", "regexp_matches(hex(t), '^(..)*746865([^0].|0[^A]){1,4}616E64')")
# hex strings
rule("hex_bytes", "strings: $a = { 74 68 65 20 } condition: $a", HAS("the "))
rule("hex_wild", "strings: $a = { 74 ?? 65 20 6? } condition: $a", "regexp_matches(hex(t), '^(..)*74..65206')")
rule("hex_jump", "strings: $a = { 74 68 65 20 [2-5] 6E 64 20 } condition: $a", "regexp_matches(hex(t), '^(..)*74686520(..){2,5}6E6420')")
rule("hex_alt", "strings: $a = { 74 68 ( 61 6E | 65 6E | 69 73 ) 20 } condition: $a", "regexp_matches(t, 'th(an|en|is) ')")
rule("hex_open_jump", "strings: $a = { 54 68 65 20 [-] 6C 69 63 65 6E 73 65 } condition: $a", "regexp_matches(hex(t), '^(..)*54686520(..)*6C6963656E7365')")
# sets
rule("any_of", 'strings: $a = "license" $b = "password" $c = "@" condition: any of them', f"{HAS('license')} OR {HAS('password')} OR {HAS('@')}")
rule("all_of", 'strings: $a = "the " $b = "of " $c = "in " condition: all of ($a, $b, $c)', f"{HAS('the ')} AND {HAS('of ')} AND {HAS('in ')}")
rule("n_of", 'strings: $a = "the " $b = "que " $c = "und " $d = "con " condition: 2 of them', " + ".join(f"CAST({HAS(x)} AS INT)" for x in ("the ", "que ", "und ", "con ")) + " >= 2")
rule("wildcard_set", 'strings: $x1 = "the " $x2 = "of " $y = "que " condition: all of ($x*) and not $y', f"{HAS('the ')} AND {HAS('of ')} AND NOT {HAS('que ')}")
rule("n_of_impossible", 'strings: $a = "the " condition: 2 of them', "false")
# sizes, digests, reads
rule("filesize_range", 'strings: $a = "the " condition: $a and filesize >= 512 and filesize < 2KB', f"{HAS('the ')} AND {SIZE} >= 512 AND {SIZE} < 2048")
rule("numeric_read", "condition: uint16(0) == 0x6854 or uint32be(0) == 0x416E6420", "starts_with(t, 'Th') OR starts_with(t, 'And ')")
# places and counts
rule("at_offset", 'strings: $a = "The " $b = "hat" condition: $a at 0 or $b at 1', "starts_with(t, 'The ') OR starts_with(substr(t, 2), 'hat') AND ascii(t) < 128")
rule("in_range", 'strings: $a = "the " condition: $a in (0..20)', "contains(t, 'the ') AND octet_length(encode(split_part(t, 'the ', 1))) <= 20")
rule("in_tail", "strings: $a = /tion\\./ condition: $a in (filesize-5..filesize)", "ends_with(t, 'tion.')")
rule("count_ge", 'strings: $a = "the " condition: #a >= 5', "len(string_split(t, 'the ')) - 1 >= 5")
rule("count_lt", 'strings: $a = "the " condition: #a < 3', "len(string_split(t, 'the ')) - 1 < 3")
rule("count_zero", 'strings: $a = "the " condition: #a == 0', f"NOT {HAS('the ')}")
rule("loop_matches", 'strings: $a = "the " condition: for any i in (1..#a) : ( @a[i] < 16 )', "contains(t, 'the ') AND octet_length(encode(split_part(t, 'the ', 1))) < 16")
rule("for_of_at", 'strings: $a = "The " $b = "And " condition: for any of them : ( $ at 0 )', "starts_with(t, 'The ') OR starts_with(t, 'And ')")
# other tables
rule("pages_html_rule", 'strings: $a = "<article>" $b = /<h1>[A-Z]/ $c = "&copy;" condition: all of them', "contains(t, '<article>') AND regexp_matches(t, '<h1>[A-Z]') AND contains(t, '&copy;')", table="pages")
rule("conv_role_rule", 'strings: $a = "the " $b = "?" condition: any of them and filesize > 100', f"({HAS('the ')} OR {HAS('?')}) AND {SIZE} > 100", table="conversations")


def _first(spark: SparkSession, sf: str, value) -> object:
    """A value of the document with the smallest id: something that rules can be compared with on any table."""
    rows = contents(spark, sf).orderBy("doc_id").limit(1)
    return rows.select(value(F.col("content"))).first()[0]


FIRST = "(SELECT {} FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 1)"


def about_first(name: str, body: str, value, where: str) -> None:
    """Registers a rule that compares each document with the first one: body has a place for the value, where for the same in SQL."""
    QUERIES[name] = lambda spark, sf: search.scan(contents(spark, sf), f"rule r {{ condition: {body.format(_first(spark, sf, value))} }}").select("doc_id")
    SQL[name] = f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {where}"


for op, sql in (("==", "="), ("!=", "<>"), ("<", "<"), ("<=", "<="), (">", ">"), (">=", ">=")):
    name = {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}[op]
    about_first(f"filesize_{name}", f"filesize {op} {{}}", F.octet_length, f"octet_length(encode(text)) {sql} {FIRST.format('octet_length(encode(text))')}")
for kind in ("md5", "sha1", "sha256"):
    about_first(f"id_{kind}", f'hash.{kind}(0, filesize) == "{{}}"', lambda c, k=kind: fc.digest(c, k), f"{kind}(text) = {FIRST.format(f'{kind}(text)')}")
    about_first(f"id_{kind}_not", f'not hash.{kind}(0, filesize) == "{{}}"', lambda c, k=kind: fc.digest(c, k), f"{kind}(text) <> {FIRST.format(f'{kind}(text)')}")


@register("SELECT doc_id FROM documents WHERE contains(text, 'tion')")
def lit_wide_ascii(spark, sf):
    """Texts in UTF-8 and in UTF-16 by turns: one string finds both."""
    docs = read(spark, sf, "documents").filter("text IS NOT NULL")
    both = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16LE"))
    return search.scan(docs.select("doc_id", both.alias("content")), 'rule r { strings: $a = "tion" wide ascii condition: $a }').select("doc_id")


MULTI = """
private rule helper { strings: $h = "the " condition: $h }
rule small { condition: helper and filesize < 1KB }
rule licensed { strings: $l = "icense" condition: $l and helper }
rule big { strings: $x = "tion" condition: #x > 20 }
"""
MULTI_SQL = f"""
WITH d AS (SELECT doc_id, text AS t, encode(text) AS b FROM documents WHERE text IS NOT NULL)
SELECT 'small' AS rule, doc_id FROM d WHERE {HAS('the ')} AND {SIZE} < 1024
UNION ALL SELECT 'licensed', doc_id FROM d WHERE {HAS('icense')} AND {HAS('the ')}
UNION ALL SELECT 'big', doc_id FROM d WHERE len(string_split(t, 'tion')) - 1 > 20
"""


@register(MULTI_SQL)
def bundle(spark, sf):
    """Three rules and a private helper in one scan."""
    return search.scan(contents(spark, sf), MULTI).select("rule", "doc_id")


@register(f"SELECT doc_id FROM (SELECT doc_id, text AS t, encode(text) AS b FROM documents) WHERE {HAS('the ')} AND {SIZE} < 1024")
def rule_ref(spark, sf):
    return search.scan(contents(spark, sf), compile_source(MULTI)[:1]).select("doc_id")


@register("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_contamination(spark, sf):
    """Documents that hold a benchmark passage as a whole.

    The second to fourth of a passage's parts between spaces are whole parts of any text that holds it, so passages and
    texts meet by the hash of three parts, and containment is tested where they meet. Passages of fewer
    than five parts are looked for in every text, SHORT_BLOCK of them in a pass.
    """
    items = read(spark, sf, "benchmark").filter("text IS NOT NULL").select("item_id", F.col("text").alias("needle"), F.split("text", " ").alias("p"))
    keyed = items.filter(F.size("p") >= 5).select("item_id", "needle", F.xxhash64(F.concat_ws(" ", F.slice("p", 2, 3))).alias("k"))
    docs = read(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "text", F.split("text", " ").alias("p"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("p") - 2, F.lit(1)))
    grams = docs.select("doc_id", "text", F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", F.slice("p", i, 3))))).alias("g"))
    # explode_outer: the filter that explode implies would compute the parts once for each window
    grams = grams.select("doc_id", F.explode_outer("g").alias("k"))
    keys = keyed.select("k").distinct()
    few = keys.count() <= 1_000_000  # 8 bytes each; then parts that begin no passage are dropped where they are made
    met = grams.join(F.broadcast(keys) if few else keys, "k", "left_semi").join(keyed.select("item_id", "k"), "k").select("doc_id", "item_id").distinct()
    hits = met.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", "needle"), "item_id").filter(F.contains("text", "needle")).select("doc_id", "item_id")
    # A passage of fewer parts has no part that is whole in every text: its bytes are looked for, all passages of a block in one pass.
    short = items.filter(F.size("p") < 5).select("item_id", "needle")
    n = short.count()
    for block in range(0, n, SHORT_BLOCK):
        own = short.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_id", "needle")) - 1).filter(F.col("n").between(block, block + SHORT_BLOCK - 1)).collect()
        found = F.filter(F.array(*[F.when(F.contains("text", F.lit(r["needle"])), F.lit(r["item_id"])) for r in own]), lambda x: x.isNotNull())
        hits = hits.unionByName(docs.select("doc_id", F.explode(found).alias("item_id")))
    return hits.distinct()


@register(f"""SELECT l.quality, count(*) AS n_candidates, sum(l.toxic)::BIGINT AS n_toxic FROM (SELECT doc_id, text AS t FROM documents) d JOIN labels l USING (doc_id)
WHERE {HAS('the ')} GROUP BY 1""")
def label_precision(spark, sf):
    hits = search.scan(contents(spark, sf), 'rule r { strings: $a = "the " condition: $a }').select("doc_id")
    labels = read(spark, sf, "labels")
    return hits.join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n_candidates"), F.sum("toxic").cast("long").alias("n_toxic"))


# --- the index -----------------------------------------------------------------------------------------------------


def shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; in local mode, if unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="bytesift-")
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def indexed(spark: SparkSession, sf: str, table: str = "documents", policy: Policy = Policy(store_path=True)) -> Store:
    """A table made from all texts of a table; its external_id is the first id column."""
    store = Store(spark, shared(spark))
    store.init(policy)
    maintenance.insert(store, contents(spark, sf, table).select(F.col(TABLES[table][0][0]).cast("string").alias("external_id"), "content"))
    return store


INDEX_RULES = """
rule lit { strings: $a = "license" condition: $a }
rule both { strings: $a = "thanedble" $b = "Eriner" condition: $a and $b }
rule either { strings: $a = "éelle" $b = "schaft" condition: any of them }
rule caps { strings: $a = "gnu general" nocase condition: $a and filesize < 20KB }
rule rx { strings: $a = /licensed? under the [A-Z]/ condition: $a }
rule hex { strings: $a = { 4C 69 63 65 6E 73 65 [1-4] } condition: $a }
rule absent { strings: $a = "the " $b = "license" condition: $a and not $b and filesize > 100 }
rule counted { strings: $a = "tion" condition: #a > 3 and #a < 9 }
rule place { strings: $a = "Then" condition: $a at 0 }
rule digest { condition: hash.sha256(0, filesize) == "0000000000000000000000000000000000000000000000000000000000000000" }
"""


@register("SELECT 0::BIGINT AS violations")
def superset_violations(spark, sf):
    """Exact matches that the index would have missed, over ten rules: none."""
    store, policy = indexed(spark, sf), Policy()
    queries = compile_source(INDEX_RULES)
    options = search.Options(cap_percent=0, now=NOW)
    found = search.candidates(store.docs(), queries, policy, options).select("rule", "identity_hex")
    exact = search.scan(contents(spark, sf).select(fc.digest(F.col("content"), "sha256").alias("identity_hex"), "content"), queries, now=NOW).select("rule", "identity_hex")
    return exact.join(found, ["rule", "identity_hex"], "left_anti").agg(F.count("*").alias("violations"))


@register(f"""
WITH d AS (SELECT sha256(text) AS h, any_value(text) AS t, encode(any_value(text)) AS b FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT 'both' AS rule, h AS identity_hex FROM d WHERE {HAS('thanedble')} AND {HAS('Eriner')}
UNION ALL SELECT 'caps', h FROM d WHERE regexp_matches(t, '(?i)gnu general') AND {SIZE} < 20480
UNION ALL SELECT 'lit', h FROM d WHERE {HAS('license')}
UNION ALL SELECT 'rx', h FROM d WHERE regexp_matches(t, 'licensed? under the [A-Z]')
""")
def index_search_verified(spark, sf):
    """Four rules: candidates from the index, then verification of what they left over."""
    store = indexed(spark, sf)
    queries = [q for q in compile_source(INDEX_RULES) if q.name in ("both", "caps", "lit", "rx")]
    found = search.distinct_hits(search.candidates(store.docs(), queries, store.policy(), search.Options(0)))
    texts = contents(spark, sf).select(F.col("doc_id").cast("string").alias("external_id"), "content")
    return search.verify(found, texts, queries).filter("state = 'matched'").select("rule", "identity_hex")


@register(f"""
WITH d AS (SELECT sha256(text) AS h, any_value(text) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1), n AS (SELECT count(*) AS live FROM d)
SELECT 'sized' AS rule, least(count(*), ceil(max(live) * 0.1))::BIGINT AS candidates, count(*) > ceil(max(live) * 0.1) AS truncated,
       CASE WHEN count(*) > ceil(max(live) * 0.1) THEN ceil(max(live) * 0.1)::BIGINT END AS truncated_limit
FROM d, n WHERE octet_length(encode(t)) > 1024
""")
def cap_summary(spark, sf):
    """The cap of ten percent of live documents."""
    store = indexed(spark, sf)
    docs = store.docs()
    found = search.candidates(docs, compile_source("rule sized { condition: filesize > 1KB }"), store.policy())
    return search.capped(found, docs.count(), 10.0)[1]


@register("""
WITH d AS (SELECT sha256(text) AS identity_hex FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT identity_hex FROM (SELECT identity_hex, row_number() OVER (ORDER BY identity_hex) AS n FROM d) WHERE n > 50 AND n <= 150
""")
def result_page(spark, sf):
    """The second page and a half of all documents by identity: pagination itself."""
    docs = feature_rows(contents(spark, sf).select(F.col("doc_id").cast("string").alias("external_id"), "content"), Policy())
    found = docs.select(F.lit("r").alias("rule"), "identity_hex").distinct()
    return search.page(found, 50, 100).select("identity_hex")


@register("""
SELECT 'lit' AS rule, count(*) AS checked, count_if(contains(t, 'license'))::BIGINT AS matched, 0::BIGINT AS skipped FROM (SELECT any_value(text) AS t FROM documents WHERE text IS NOT NULL GROUP BY sha256(text))
""")
def verify_stats(spark, sf):
    """Counts of a verification of all documents."""
    rows = contents(spark, sf).select(F.col("doc_id").cast("string").alias("external_id"), fc.digest(F.col("content"), "sha256").alias("identity_hex"), "content")
    one = rows.groupBy("identity_hex").agg(F.min("external_id").alias("external_id")).withColumn("rule", F.lit("lit"))
    return search.verified_counts(search.verify(one, rows.select("external_id", "content"), compile_source('rule lit { strings: $a = "license" condition: $a }')))


# --- features ------------------------------------------------------------------------------------------------------


@register("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size FROM documents WHERE text IS NOT NULL")
def digests(spark, sf):
    c = F.col("content")
    return contents(spark, sf).select("doc_id", fc.digest(c, "md5").alias("md5"), fc.digest(c, "sha1").alias("sha1"), fc.digest(c, "sha256").alias("sha256"), F.octet_length(c).cast("long").alias("size"))


@register()
def digest_sha512(spark, sf):
    return contents(spark, sf).select("doc_id", fc.digest(F.col("content"), "sha512").alias("sha512"))


@register("""
SELECT doc_id, count(DISTINCT CASE WHEN i <= n - 2 THEN substr(h, 2 * i - 1, 6) END) AS grams3, count(DISTINCT CASE WHEN i <= n - 3 THEN substr(h, 2 * i - 1, 8) END) AS grams4
FROM (SELECT doc_id, hex(text) AS h, octet_length(encode(text)) AS n, unnest(generate_series(1, greatest(octet_length(encode(text)), 1))) AS i FROM documents WHERE text IS NOT NULL) GROUP BY 1
""")
def distinct_grams(spark, sf):
    """Distinct runs of 3 and of 4 bytes of each document."""
    c = F.col("content")
    return contents(spark, sf).select("doc_id", fc.distinct_grams_of(c, 3).alias("grams3"), fc.distinct_grams_of(c, 4).alias("grams4"))


@register("SELECT doc_id, true AS near3, true AS near4 FROM documents WHERE text IS NOT NULL")
def gram_estimates(spark, sf):
    """Whether estimates of the distinct runs of bytes are within 3 % (or 2) of the exact numbers."""
    c = F.col("content")
    rows = contents(spark, sf).select("doc_id", *[f(c, n).alias(f"{name}{n}") for n in (3, 4) for name, f in (("exact", fc.distinct_grams_of), ("about", fc.estimated_grams_of))])
    near = lambda n: F.abs(F.col(f"about{n}") - F.col(f"exact{n}")) <= F.greatest(0.03 * F.col(f"exact{n}"), F.lit(2.0))
    return rows.select("doc_id", near(3).alias("near3"), near(4).alias("near4"))


_WORDS = "greatest(1, ceil(log2(greatest(n * {k} / ln(2) / 64, 1))))::INT"
SIZES = f"""
WITH g AS (SELECT h, count(DISTINCT CASE WHEN i <= n - 2 THEN substr(x, 2 * i - 1, 6) END) AS n3, count(DISTINCT CASE WHEN i <= n - 3 THEN substr(x, 2 * i - 1, 8) END) AS n4
    FROM (SELECT h, hex(t) AS x, octet_length(encode(t)) AS n, unnest(generate_series(1, greatest(octet_length(encode(t)), 1))) AS i
          FROM (SELECT sha256(text) AS h, any_value(text) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1)) GROUP BY 1),
s AS (SELECT tier, log2_words, count(*) AS docs FROM (SELECT 1 AS tier, {_WORDS.format(k=1).replace("n *", "n3 *")} AS log2_words FROM g UNION ALL SELECT 2, {_WORDS.format(k=2).replace("n *", "n4 *")} FROM g) GROUP BY 1, 2)
"""


@register(SIZES + "SELECT tier, log2_words, docs, (docs * 2 ** (log2_words + 3))::BIGINT AS bytes FROM s")
def filter_sizes(spark, sf):
    """How many documents have filters of each size, which follows from their distinct runs of bytes."""
    return telemetry.filter_sizes(indexed(spark, sf).docs())


@register(SIZES + """SELECT tier, share, min(log2_words) AS log2_words FROM (SELECT tier, log2_words, sum(docs) OVER (PARTITION BY tier ORDER BY log2_words) / sum(docs) OVER (PARTITION BY tier) AS within FROM s),
(SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS share) WHERE within >= share - 1e-12 GROUP BY 1, 2""")
def filter_size_quantiles(spark, sf):
    return telemetry.weighted_quantiles(telemetry.filter_sizes(indexed(spark, sf).docs()), [0.5, 0.9, 0.99])


@register("""SELECT event_id, list_sort(list(value) OVER w)[greatest(ceil(len(list(value) OVER w) * 0.95), 1)::INT] AS p95 FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def rolling_p95(spark, sf):
    """The 95th percentile of the last sixteen values of each kind of event."""
    events = read(spark, sf, "events")
    return events.select("event_id", telemetry.rolling_percentile(events, "value", ["event_type"], ["ts", "event_id"]).alias("p95"))


@register("SELECT unnest(['both', 'lit', 'rx']) AS rule, true AS narrows")
def tier_narrowing(spark, sf):
    """Whether the second tier lets through no more than the first, and no fewer than match."""
    store = indexed(spark, sf)
    queries = [q for q in compile_source(INDEX_RULES) if q.name in ("both", "lit", "rx")]
    rows = contents(spark, sf).select(fc.digest(F.col("content"), "sha256").alias("identity_hex"), "content")
    hits = search.scan(rows, queries).distinct().groupBy("rule").agg(F.count("*").alias("hits"))
    out = telemetry.tier_narrowing(store.docs(), queries, store.policy()).join(hits, "rule", "left")
    return out.select("rule", ((F.col("tier2") <= F.col("tier1")) & (F.col("tier2") >= F.coalesce("hits", F.lit(0)))).alias("narrows"))


BYTES = """
WITH c AS (SELECT doc_id, octet_length(encode(text)) AS n, substr(hex(text), 2 * i::BIGINT - 1, 2) AS ch
    FROM (SELECT doc_id, text, unnest(generate_series(1, octet_length(encode(text)))) AS i FROM documents WHERE text IS NOT NULL)),
f AS (SELECT doc_id, max(n) AS n, ch, count(*) AS k FROM c GROUP BY doc_id, ch),
e AS (SELECT doc_id, -sum(k / n * log2(k / n)) AS entropy FROM f GROUP BY 1)
"""


@register(BYTES + "SELECT doc_id, round(coalesce(entropy, 0), 3) AS entropy FROM documents LEFT JOIN e USING (doc_id) WHERE text IS NOT NULL")
def entropy_values(spark, sf):
    return contents(spark, sf).select("doc_id", F.round(fc.entropy_of("content").cast("double"), 3).alias("entropy"))


@register(BYTES + "SELECT doc_id FROM e WHERE entropy > 4.1")
def entropy_gt(spark, sf):
    return search.scan(contents(spark, sf), "rule r { condition: math.entropy(0, filesize) > 4.1 }").select("doc_id")


@register("""
SELECT shard, count(*) AS n FROM (SELECT ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 8 AS shard
FROM (SELECT sha256(text) AS h FROM documents WHERE text IS NOT NULL)) GROUP BY 1
""")
def shard_histogram(spark, sf):
    rows = contents(spark, sf).select(shard_of(fc.digest(F.col("content"), "sha256"), 8).cast("long").alias("shard"))
    return rows.groupBy("shard").agg(F.count("*").alias("n"))


@register(BYTES + """SELECT CAST(doc_id AS VARCHAR) AS external_id, sha256(text) AS identity_hex, octet_length(encode(text))::BIGINT AS file_size, false AS special_population,
substr(hex(text), 1, 16) AS prefix8, round(coalesce(entropy, 0), 3) AS entropy, false AS is_pe FROM documents LEFT JOIN e USING (doc_id) WHERE text IS NOT NULL""")
def feature_table(spark, sf):
    """The index columns of all documents but the filters."""
    rows = feature_rows(contents(spark, sf).select(F.col("doc_id").cast("string").alias("external_id"), "content"), Policy())
    return rows.select("external_id", "identity_hex", "file_size", "special_population", F.hex("prefix8").alias("prefix8"), F.round(F.col("entropy").cast("double"), 3).alias("entropy"), F.col("meta.pe_is_pe").alias("is_pe"))


# --- maintenance ---------------------------------------------------------------------------------------------------


def placed(spark, sf) -> DataFrame:
    """Documents as stored rows: identity and place, with doc_id as the number."""
    return contents(spark, sf).select(fc.digest(F.col("content"), "sha256").alias("identity_hex"), F.floor(F.col("doc_id") / 5000).cast("int").alias("tree"), F.lit(0).alias("shard"), "doc_id")


@register("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def dedup_victims(spark, sf):
    return maintenance.duplicate_victims(placed(spark, sf)).select("doc_id")


@register("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1")
def dedup_groups(spark, sf):
    return placed(spark, sf).groupBy("identity_hex").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1").select("doc_id", "copies")


@register("SELECT CASE WHEN n = 1 THEN 'inserted' ELSE 'already_exists' END AS status, count(*) AS n_docs FROM (SELECT row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def insert_status(spark, sf):
    store = Store(spark, shared(spark))
    store.init(Policy())
    out = maintenance.insert(store, contents(spark, sf).select(F.col("doc_id").cast("string").alias("external_id"), "content"))
    return out.groupBy("status").agg(F.count("*").alias("n_docs"))


@register(f"""
WITH d AS (SELECT sha256(text) AS h, any_value(text) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT count(*) AS live, (SELECT count(*) FROM d WHERE octet_length(encode(t)) < 1024) AS deleted FROM d WHERE octet_length(encode(t)) >= 1024
""")
def delete_antijoin(spark, sf):
    """Deletes all documents below 1 KB and counts what stays and what has gone."""
    store = indexed(spark, sf)
    small = store.docs().filter("file_size < 1024").select("identity_hex")
    maintenance.delete(store, small)
    return maintenance.stats(store).select(F.col("live_docs").alias("live"), F.col("deleted_docs").alias("deleted"))


@register(f"""
WITH d AS (SELECT sha256(text) AS h, any_value(text) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT CASE WHEN octet_length(encode(t)) < 1024 THEN 'restored' ELSE 'already_exists' END AS status, count(*) AS n FROM d GROUP BY 1
""")
def reinsert_status(spark, sf):
    """Deletes all documents below 1 KB and inserts everything once more."""
    store = indexed(spark, sf)
    maintenance.delete(store, store.docs().filter("file_size < 1024").select("identity_hex"))
    one = contents(spark, sf).groupBy("content").agg(F.min("doc_id").cast("string").alias("external_id"))
    return maintenance.insert(store, one.select("external_id", "content")).groupBy("status").agg(F.count("*").alias("n"))


@register(f"SELECT count(DISTINCT sha256(text)) AS live, 0::BIGINT AS deleted, 1::BIGINT AS folders FROM documents WHERE octet_length(encode(text)) >= 1024")
def compaction(spark, sf):
    """Deletes, compacts, and counts: one folder of live rows is left, and no tombstone."""
    store = indexed(spark, sf)
    maintenance.delete(store, store.docs().filter("file_size < 1024").select("identity_hex"))
    maintenance.compact(store, force=True)
    maintenance.collect_garbage(store)
    folders = len(store.state()[0]["docs"])
    return maintenance.stats(store).select(F.col("live_docs").alias("live"), F.col("deleted_docs").alias("deleted"), F.lit(folders).cast("long").alias("folders"))


@register("SELECT sha256(text) AS identity_hex, doc_id, true AS in_order FROM documents WHERE text IS NOT NULL")
def source_reference(spark, sf):
    """The sorted reference of identities, and whether each row lies behind the one before it in its part."""
    ref = maintenance.source_reference(placed(spark, sf)).withColumn("row", F.monotonically_increasing_id())
    part = Window.partitionBy(F.shiftrightunsigned("row", 33)).orderBy("row")
    before = F.lag(F.struct("identity_hex", "doc_id")).over(part)
    return ref.select("identity_hex", "doc_id", F.coalesce(before <= F.struct("identity_hex", "doc_id"), F.lit(True)).alias("in_order"))


def write_batches(docs: DataFrame, path: str, batches: int) -> int:
    """Writes doc_id and text as about so many batches of files of at most about FILE_TEXT bytes of text, each read by a task; the files of a batch."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    docs.repartition(batches * max(1, -(-size // (batches * FILE_TEXT))), "doc_id").write.parquet(path)
    return max(1, -(-len(docs.sparkSession.read.parquet(path).inputFiles()) // batches))


@register("SELECT count(*) AS docs, count(DISTINCT sha256(text)) AS live FROM documents WHERE text IS NOT NULL")
def stream_ingest_counts(spark, sf):
    """Documents through a stream of micro-batches into a table."""
    from bytesift.streaming.ingest import ingest_stream, table_stream

    root = shared(spark)
    store = Store(spark, f"{root}/table")
    store.init(Policy())
    files = write_batches(read(spark, sf, "documents").select("doc_id", "text"), f"{root}/incoming", 3)
    ingest_stream(table_stream(spark, f"{root}/incoming", "doc_id", "text", max_files=files), store, f"{root}/checkpoint").awaitTermination()
    live = store.docs().agg(F.count("*").alias("live"))
    total = spark.read.parquet(f"{root}/incoming").filter("text IS NOT NULL").count()
    return live.select(F.lit(total).cast("long").alias("docs"), "live")


@register("SELECT count(DISTINCT sha256(text)) AS live, true AS few_folders FROM documents WHERE text IS NOT NULL AND doc_id % 5 = 0")
def stream_many_batches(spark, sf):
    """A fifth of the documents in forty small batches: folders are merged as they become many."""
    from bytesift.streaming.ingest import ingest_stream, table_stream

    root = shared(spark)
    store = Store(spark, f"{root}/table")
    store.init(Policy(max_folders=8))
    files = write_batches(read(spark, sf, "documents").filter("text IS NOT NULL AND doc_id % 5 = 0").select("doc_id", "text"), f"{root}/incoming", 40)
    ingest_stream(table_stream(spark, f"{root}/incoming", "doc_id", "text", max_files=files), store, f"{root}/checkpoint").awaitTermination()
    return store.docs().agg(F.count("*").alias("live")).select("live", F.lit(len(store.state()[0]["docs"]) <= 8).alias("few_folders"))


@register("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_events(spark, sf):
    """The events table through micro-batches into Parquet, counted by type."""
    root = shared(spark)
    events = read(spark, sf, "events")
    events.repartition(4, "event_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stream.select("event_type", "user_id").writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.schema("event_type string, user_id long").parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@register("""
WITH d AS (SELECT sha256(text) AS h, doc_id FROM documents WHERE text IS NOT NULL), f AS (SELECT h, min(doc_id) AS first FROM d GROUP BY 1)
SELECT d.doc_id AS "order", d.h AS identity_hex, CAST(f.first AS VARCHAR) AS external_id, f.first AS doc_id FROM d JOIN f USING (h)
""")
def identity_lookup(spark, sf):
    """The stored document of each document's identity."""
    rows = placed(spark, sf).withColumn("external_id", F.col("doc_id").cast("string"))
    return maintenance.lookup(rows, rows.select(F.col("doc_id").alias("order"), "identity_hex"))


@register(f"""
WITH d AS (SELECT sha256(text) AS h, any_value(text) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT 'lit' AS rule, count(*) AS matches, 0::BIGINT AS missed, 1.0::DOUBLE AS recall FROM d WHERE {HAS('license')}
UNION ALL SELECT 'both', count(*), 0, 1.0 FROM d WHERE {HAS('thanedble')} AND {HAS('Eriner')}
UNION ALL SELECT 'rx', count(*), 0, 1.0 FROM d WHERE regexp_matches(t, 'licensed? under the [A-Z]')
""")
def truth_join(spark, sf):
    """Exact matches of three rules against candidates that the filters of an index let through: none is missed."""
    store = indexed(spark, sf)
    queries = [q for q in compile_source(INDEX_RULES) if q.name in ("both", "lit", "rx")]
    rows = contents(spark, sf).select(fc.digest(F.col("content"), "sha256").alias("identity_hex"), "content")
    found = search.candidates(store.docs(), queries, store.policy(), search.Options(0))
    return search.join_truth(search.scan(rows, queries).distinct(), found, ["identity_hex"]).select("rule", "matches", "missed", "recall")


@register("SELECT 'both' AS rule, true AS precise UNION ALL SELECT 'lit', true UNION ALL SELECT 'place', true")
def candidate_precision(spark, sf):
    """Whether at least half of what the filters let through are matches, for rules of literals."""
    store = indexed(spark, sf)
    queries = [q for q in compile_source(INDEX_RULES) if q.name in ("both", "lit", "place")]
    rows = contents(spark, sf).select(fc.digest(F.col("content"), "sha256").alias("identity_hex"), "content")
    found = search.candidates(store.docs(), queries, store.policy(), search.Options(0))
    out = search.join_truth(search.scan(rows, queries).distinct(), found, ["identity_hex"])
    return out.select("rule", (F.col("precision") >= 0.5).alias("precise"))


@register("SELECT 'inserted' AS status, count(DISTINCT sha256(text)) AS n FROM documents WHERE text IS NOT NULL")
def export_import(spark, sf):
    """A table's live rows exported and imported into another."""
    store, at = indexed(spark, sf), shared(spark)
    maintenance.export_live(store, f"{at}/rows")
    other = Store(spark, f"{at}/table")
    other.init(Policy(store_path=True))
    return maintenance.import_rows(other, f"{at}/rows").groupBy("status").agg(F.count("*").alias("n"))


@register("""
SELECT 'sized' AS rule, h AS identity_hex FROM (SELECT sha256(text) AS h, octet_length(encode(text)) AS n FROM documents UNION SELECT sha256(text), octet_length(encode(text)) FROM conversations) WHERE n > 1024
""")
def multi_table_search(spark, sf):
    """Two tables, of documents and of conversations, searched as one."""
    stores = [indexed(spark, sf), indexed(spark, sf, "conversations")]
    docs = stores[0].docs().unionByName(stores[1].docs())
    return search.distinct_hits(search.candidates(docs, compile_source("rule sized { condition: filesize > 1KB }"), Policy(), search.Options(0))).select("rule", "identity_hex")


@register("""
WITH d AS (SELECT sha256(text) AS h, any_value(text) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT count(*) AS live_docs, 0::BIGINT AS deleted_docs, sum(octet_length(encode(t)))::BIGINT AS bytes, 0::BIGINT AS special_docs, ceil(count(*) / 5000)::BIGINT AS trees FROM d
""")
def table_stats(spark, sf):
    return maintenance.stats(indexed(spark, sf)).select("live_docs", "deleted_docs", "bytes", "special_docs", "trees")


@register("""
SELECT * FROM (VALUES
    ('good', false, 'searchable', '', '', '', NULL::INT, NULL::INT),
    ('later', false, 'searchable-needs-verify', 'verifier-only', 'warning', 'the index does not decide count conditions', 3, 1),
    ('loose', false, 'unsupported', 'regex-no-mandatory-literal', 'error', 'an expression has no run of fixed bytes', 4, 1),
    ('negated', false, 'unsupported', 'negated-search-unbounded', 'error', 'a match needs nothing but the absence of strings', 5, 1),
    ('negated', false, 'unsupported', 'negated-search', 'warning', 'the index does not decide the absence of strings', 5, 1),
    ('other', false, 'unsupported', 'hash-identity-mismatch', 'error', 'hash.md5 is compared, the current source is sha256', 6, 1)
) AS t(rule, is_private, status, code, severity, message, line, "column")
""")
def rule_check(spark, sf):
    """Reports on one rule of each kind."""
    source = """
rule good { strings: $a = "ABCDEF" condition: $a }
rule later { strings: $a = "ABCDEF" condition: #a > 3 }
rule loose { strings: $a = /[0-9]+/ condition: $a }
rule negated { strings: $a = "ABCDEF" condition: not $a }
rule other { condition: hash.md5(0, filesize) == "d41d8cd98f00b204e9800998ecf8427e" }
"""
    return check_frame(spark, check_source(source))


FLAGSHIP = 'rule flagship { strings: $a = "the " $b = "and " condition: all of them and filesize > 1KB }'
SQL["flagship"] = f"SELECT doc_id FROM (SELECT doc_id, text AS t, encode(text) AS b FROM documents) WHERE {HAS('the ')} AND {HAS('and ')} AND {SIZE} > 1024"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return search.scan(contents(spark, sf), FLAGSHIP).select("doc_id")


QUERIES["flagship"] = flagship
