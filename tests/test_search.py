"""Exact and index predicates over bytes; searches, bundles, caps, verification."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from bytesift.engine import Engine
from bytesift.operators import maintenance, search
from bytesift.operators.features import feature_rows
from bytesift.plans.errors import RuleError
from bytesift.plans.policy import Policy
from bytesift.plans.resolve import compile_source
from bytesift.sources.store import Store
from bytesift.streaming.adaptive import Pace, ingest_paced
from bytesift.streaming.ingest import table_stream
from tests.test_functions import pe

FILES = {
    "ABCD": b"ABCD1234", "ABCD9": b"ABCD12345", "hit": b"ALPHA BETA GAMMA", "part": b"ALPHA BETA", "delta": b"DELTA",
    "full": b".WORD!", "inside": b"xWORDx", "apple": b"ZZapplesause123", "apple2": b"applesauseABC", "rep": b"xabbcdx",
    "foo": b"foo1barsfoo2bars", "wide": "xWide Textx".encode("utf-16-le"), "aaaa": b"aaaaaaa", "empty": b"", "bin": bytes(range(256)),
    "num": struct.pack("<HIq", 0x5A4D, 77, -5) + struct.pack(">d", 1.5), "pe": pe(), "nl": b"one\ntwo\n", "utf": "é ß 中文".encode(),
}

CASES = {
    '$a = "ABCD" | $a and filesize == 8': {"ABCD"},
    '$a = "ABCD" $b = "345" | $a and not $b and filesize >= 8 and filesize < 9': {"ABCD"},
    '$ra = "ALPHA" $rb = "BETA" $rc = "GAMMA" | any of ($ra,$rb) and all of ($r*)': {"hit"},
    '$a = "WORD" fullword | $a': {"full"},
    '$a = "word" nocase | $a': {"full", "inside"},
    "$a = /[A-Z]+applesause[0-9]+/ | $a": {"apple"},
    "$a = /ab+cd/ | $a": {"rep", "bin"},
    "$a = /(foo.*bars){2}/ | $a": {"foo"},
    '$a = "Wide Text" wide | $a': {"wide"},
    '$a = "wide text" wide nocase ascii | $a': {"wide"},
    '$a = "aa" | #a == 6': {"aaaa"},
    '$a = "aa" | #a > 6': set(),
    '$a = "aaa" | #a < 6 and filesize == 7': {"aaaa", "rep"},
    "$a = { 10 11 ?? 13 [2-3] 17 ( 18 | 99 ) } | $a": {"bin"},
    "$a = { FE FF } | $a at 254": {"bin"},
    "$a = { FE FF } | $a at filesize - 2": {"bin"},
    "$a = { FE FF } | $a in (0..253)": set(),
    "$a = { FE FF } | $a in (filesize-2..filesize)": {"bin"},
    "$a = { FE FF } | $a in (filesize-1..filesize)": set(),
    '$a = "BETA" | $a in (6..6)': {"hit", "part"},
    "$a = /B.TA/ | $a in (1..5)": set(),
    "$a = /B.TA/ | $a in (3..filesize)": {"hit", "part"},
    '$a = "BETA" | $a in (7..filesize)': set(),
    "| uint16(0) == 0x5A4D and uint32(2) == 77 and int64(6) == -5 and float64be(14) == 1.5": {"num"},
    "| uint16be(0) == 0x4D5A and filesize < 30": {"num"},
    "| pe.is_pe and pe.machine == 0x14c and pe.subsystem != 2 and not pe.is_dll": {"pe"},
    '$a = "ENTRYPOINT" | $a at pe.entry_point': {"pe"},
    '$a = "POINT" | $a at pe.entry_point + 5': {"pe"},
    "$a = /POI[A-Z]T/ | $a at pe.entry_point + 5": {"pe"},
    "| pe.timestamp < time.now and pe.characteristics < pe.timestamp": {"pe"},
    "| math.entropy(0, filesize) == 8": {"bin"},
    "| filesize == 0": {"empty"},
    "| hash.md5(0, filesize) == \"d41d8cd98f00b204e9800998ecf8427e\"": {"empty"},
    "$a = /^one$/ | $a": set(),
    "$a = /two\\n$/ | $a": {"nl"},
    '$a = "é ß" | $a': {"utf"},
    '$a = "ABCD" | 2 of them': set(),
    '$a = "GAMMA" $b = "zzzz" $c = "BETA" | 2 of them': {"hit"},
    '$a = "BETA" | for any i in (1..#a) : (@a[i] > 5 and @a[i] < 7)': {"hit", "part"},
    '$a = "BETA" | not ($a or pe.is_pe) and filesize > 200': {"bin"},
}


def rules():
    out = []
    for i, case in enumerate(CASES):
        strings, _, condition = case.rpartition("|")
        out.append(f"rule r{i} {{ {'strings: ' + strings if strings.strip() else ''} condition: {condition} }}")
    return "\n".join(out)


@pytest.fixture(scope="module")
def contents(spark):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "external_id string, content binary").cache()


def test_exact_matches(contents):
    found = {}
    queries = compile_source(rules())
    for start in range(0, len(queries), 10):
        for r in search.scan(contents, queries[start : start + 10], now=1_700_000_000).select("rule", "external_id").collect():
            found.setdefault(r.rule, set()).add(r.external_id)
    for i, (case, want) in enumerate(CASES.items()):
        assert found.get(f"r{i}", set()) == want, case


def test_unknown_modules_cannot_be_verified(contents):
    with pytest.raises(RuleError):
        search.scan(contents, "rule r { condition: androguard.permission(/SMS/) or filesize > 1 }").count()


@pytest.mark.parametrize("grams", [(3, 4), (4, 7)])
def test_candidates_hold_all_matches(contents, grams):
    policy = Policy(grams=grams, id_source="md5")
    docs = feature_rows(contents, policy).withColumn("tree", F.lit(0)).withColumn("doc_id", F.lit(0)).cache()
    queries = compile_source(rules())
    sizes = 0
    for q in queries:
        found = {r.external_id for r in search.candidates(docs, [q], policy, search.Options(0, now=1_700_000_000)).collect()}
        assert CASES[list(CASES)[int(q.name[1:])]] <= found, q.name
        sizes += len(found)
    assert sizes < 0.5 * len(queries) * len(FILES)  # it does rule out


def test_what_the_index_cannot_decide_is_kept(spark):
    """Conditions that hold without a string, or that only a module or a header could decide, rule nothing out."""
    contents = spark.createDataFrame([("none", bytearray(b"nothing of it")), ("abc", bytearray(b"abc"))], "external_id string, content binary")
    docs = feature_rows(contents, Policy()).withColumn("tree", F.lit(0)).withColumn("doc_id", F.lit(0))
    bare = docs.withColumn("meta", F.lit(None).cast(docs.schema["meta"].dataType))
    found = lambda d, rule: {r.external_id for r in search.candidates(d, compile_source(rule), Policy(), search.Options(0)).collect()}
    assert found(docs, 'rule r { strings: $a = "absent" condition: #a < 5 }') == {"none", "abc"}
    assert found(docs, 'rule r { strings: $a = "absent" condition: $a or androguard.url("x") }') == {"none", "abc"}
    assert found(docs, "rule r { strings: $a = /abc/ ascii wide condition: $a }") == {"abc"}
    assert found(docs, 'rule r { strings: $a = "absent" condition: not $a }') == {"none", "abc"}
    assert found(docs, "rule r { condition: not pe.is_dll }") == {"none", "abc"}
    assert found(bare, "rule r { condition: not pe.is_pe or pe.machine == 3 }") == {"none", "abc"}
    assert found(docs, "rule r { condition: pe.is_pe }") == set() and found(bare, "rule r { condition: pe.is_pe }") == {"none", "abc"}
    assert found(docs, 'rule r { strings: $a = "abc" condition: not ($a or filesize > 5) and filesize == 3 }') == {"abc"}


def test_random_literals_are_never_missed(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcde \n") for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    contents = spark.createDataFrame([(str(i), bytearray(t.encode())) for i, t in enumerate(texts)], "external_id string, content binary")
    docs = feature_rows(contents, Policy()).withColumn("tree", F.lit(0)).withColumn("doc_id", F.lit(0)).cache()
    source = []
    for i in range(25):
        t = rnd.choice([x for x in texts if len(x) > 20])
        a = rnd.randrange(len(t) - 8)
        lit = t[a : a + rnd.randint(3, 8)].replace("\n", "\\n")
        source.append(f'rule q{i} {{ strings: $a = "{lit}" $b = "{lit[::-1] if chr(92) not in lit else lit}" condition: $a {rnd.choice(["and", "or", "and not"])} $b }}')
    queries = compile_source("\n".join(source))
    for start in range(0, 25, 8):
        own = queries[start : start + 8]
        exact = {(r.rule, r.external_id) for r in search.scan(contents, own).collect()}
        found = {(r.rule, r.external_id) for r in search.candidates(docs, own, Policy(), search.Options(0)).collect()}
        assert exact <= found


def test_caps_tiers_and_impossible_queries():
    assert [search.cap(n, p) for n, p in ((1000, 10), (5, 10), (0, 10), (10, 0), (10, float("nan")), (11, 10))] == [100, 1, 1, None, None, 2]
    (q,) = compile_source('rule r { strings: $a = "AAAA" condition: 2 of them or filesize < 5 and false }')
    assert search.impossible(q)


def test_engine_life(spark, tmp_path, contents):
    engine = Engine(spark, str(tmp_path / "t")).init(Policy(id_source="md5", store_path=True, tree_docs=7, shards=3, dedup_min_docs=1, compaction_cooldown_s=0))
    with pytest.raises(FileExistsError):
        Engine(spark, str(tmp_path / "t")).init()
    status = lambda df: {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}
    assert status(engine.ingest(contents)) == {"inserted": len(FILES)}
    assert status(engine.ingest(contents)) == {"already_exists": len(FILES)}
    info = engine.info().first()
    assert (info.live_docs, info.deleted_docs, info.trees) == (len(FILES), 0, 3)
    places = engine.store.docs().select("doc_id").collect()
    assert sorted(r.doc_id for r in places) == list(range(len(FILES)))
    rule = 'rule beta { strings: $a = "BETA" condition: $a } rule word { strings: $a = "WORDx" condition: $a }'
    result = engine.search(rule, search.Options(0), contents)
    assert {(r.rule, r.external_id, r.state) for r in result.hits.collect()} >= {("beta", "hit", "matched"), ("beta", "part", "matched"), ("word", "inside", "matched")}
    assert result.tiers == {"beta": "tier1+tier2", "word": "tier1+tier2"}
    one = engine.search('rule beta { strings: $a = "BETA" condition: $a }', search.Options(0.1))
    s = one.summary.first()
    assert (s.truncated, s.truncated_limit, one.hits.count()) == (True, 1, 1)
    gone = contents.filter("external_id <> 'hit'")
    states = {r.external_id: r.state for r in engine.search(rule, search.Options(0), gone).hits.filter("rule = 'beta'").collect()}
    assert states["hit"] == "skipped" and states["part"] == "matched"
    with pytest.raises(ValueError, match="negated-search-unbounded"):
        engine.search('rule n { strings: $a = "BETA" condition: not $a }')
    import hashlib

    digest = hashlib.md5(FILES["hit"]).hexdigest()
    assert engine.delete([digest]).first().status == "deleted" and engine.delete([digest]).first().status == "missing"
    assert engine.search(rule, search.Options(0)).hits.filter("rule = 'beta' and external_id = 'hit'").count() == 0
    assert status(engine.ingest(contents.filter("external_id = 'hit'"))) == {"restored": 1}
    engine.delete([digest])
    before = {r.identity_hex for r in engine.store.docs().collect()}
    assert engine.compact() == [{"compacted": True, "rows": len(FILES) - 1}]
    assert {r.identity_hex for r in engine.store.docs().collect()} == before
    from bytesift.operators.maintenance import collect_garbage, export_live, import_rows

    assert collect_garbage(engine.store) > 0
    assert {r.identity_hex for r in engine.store.docs().collect()} == before
    export_live(engine.store, str(tmp_path / "out"))
    other = Engine(spark, str(tmp_path / "u")).init(Policy(id_source="md5", store_path=True))
    assert status(import_rows(other.store, str(tmp_path / "out"))) == {"inserted": len(FILES) - 1}
    both = Engine(spark, [str(tmp_path / "t"), str(tmp_path / "u")])
    assert both.search(rule, search.Options(0)).hits.filter("rule = 'beta'").count() == engine.search(rule, search.Options(0)).hits.filter("rule = 'beta'").count()
    bare = Engine(spark, str(tmp_path / "w")).init(Policy())
    bare.ingest(contents)
    assert {r.external_id for r in bare.store.docs().collect()} == {None}
    with pytest.raises(ValueError, match="policies differ"):
        Engine(spark, str(tmp_path / "v")).init(Policy())
        Engine(spark, [str(tmp_path / "t"), str(tmp_path / "v")]).policy()


def test_a_second_writer_is_told(spark, tmp_path):
    from bytesift.sources.store import ConcurrentChange, Store

    store = Store(spark, str(tmp_path / "t"))
    store.init(Policy())
    state, version = store.state()
    store.commit(state, version)
    with pytest.raises(ConcurrentChange):
        store.commit(state, version)


def test_dedup_keeps_the_oldest(spark):
    from bytesift.operators.maintenance import duplicate_victims

    rows = spark.createDataFrame([("a", 1, 0, 5), ("a", 0, 2, 9), ("a", 0, 2, 8), ("b", 0, 0, 1)], "identity_hex string, tree int, shard int, doc_id long")
    assert sorted(r.doc_id for r in duplicate_victims(rows).collect()) == [5, 9]


def test_files_and_command_line(spark, tmp_path, capsys):
    import io
    import json

    from bytesift.cli import main

    data = tmp_path / "data" / "sub"
    data.mkdir(parents=True)
    (data / "one.bin").write_bytes(b"xx needle yy")
    (data / "two.bin").write_bytes(b"nothing")
    (tmp_path / "r.yar").write_text('include "inc.yar"\nrule top { strings: $a = "needle" condition: $a and helper }')
    (tmp_path / "inc.yar").write_text("private rule helper { condition: filesize < 1KB }")
    (tmp_path / "list.txt").write_text(f"{tmp_path / 'data'}\n\n")

    def run(*args):
        out = io.StringIO()
        return main(list(args), out), out.getvalue()

    root = str(tmp_path / "t")
    assert run("init", "--root", root, "--store-path")[0] == 0
    assert run("index", "--root", root, "--path-list", str(tmp_path / "list.txt")) == (0, "inserted: 2\n")
    code, text = run("search", "--root", root, "--rule", str(tmp_path / "r.yar"), "--max-candidates", "0", "--verify")
    assert code == 0 and "verified_matched: 1" in text and "one.bin" in text and "tier_used: tier1+tier2" in text
    code, text = run("scan", "--rule", str(tmp_path / "r.yar"), str(tmp_path / "data"))
    assert text.strip() == f"top {data / 'one.bin'}"
    assert run("--rule", str(tmp_path / "r.yar"), str(tmp_path / "data"))[1] == text  # a scan is what is done without a command
    code, text = run("--perf-report", str(tmp_path / "perf.json"), "local", "info", "--root", root)
    report = json.loads((tmp_path / "perf.json").read_text())
    assert code == 0 and report["command"] == "info" and report["seconds"] > 0 and report["exit"] == 0
    code, text = run("rule-check", "--rule", str(tmp_path / "r.yar"), "--json")
    assert code == 0 and json.loads(text)["status"] == "searchable"
    assert json.loads(run("info", "--root", root)[1])["live_docs"] == 2
    assert run("delete", "--root", root, str(data / "two.bin"))[1].endswith("deleted\n")
    (tmp_path / "bad.yar").write_text("rule bad { condition: nothing }")
    assert run("rule-check", "--rule", str(tmp_path / "bad.yar"))[0] == 1
    assert run("search", "--root", root, "--rule", str(tmp_path / "bad.yar"))[0] == 1


def test_stream(spark, tmp_path):
    from bytesift.sources.store import Store
    from bytesift.streaming.ingest import file_stream, ingest_stream

    store = Store(spark, str(tmp_path / "t"))
    store.init(Policy())
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        (source / f"{i}.bin").write_bytes(b"content %d" % (i % 3))
    for _ in range(2):
        ingest_stream(file_stream(spark, str(source), max_files=2), store, str(tmp_path / "c")).awaitTermination()
        assert store.docs().count() == 3
        (source / "9.bin").write_bytes(b"content 1")


def test_cap_keeps_the_first_by_identity(spark):
    rows = [(r, f"{(i * 2654435761) % (1 << 32):08x}", None, 0, i) for r, n in (("a", 500), ("b", 40), ("c", 41)) for i in range(n)]
    rows += [("d", "0000aaaa", None, 0, i) for i in range(90)]  # one range holds the whole rule
    found = spark.createDataFrame(rows, "rule string, identity_hex string, external_id string, tree int, doc_id int")
    kept, summary = search.capped(found, 400, 10.0)
    want = {r: sorted((x[1], x[4]) for x in rows if x[0] == r)[:40] for r in "abcd"}
    assert {r: sorted((x.identity_hex, x.doc_id) for x in kept.collect() if x.rule == r) for r in "abcd"} == want
    assert {(r.rule, r.candidates, r.truncated, r.truncated_limit) for r in summary.collect()} == {("a", 40, True, 40), ("b", 40, False, None), ("c", 40, True, 40), ("d", 40, True, 40)}


def test_merged_folders_hold_the_same_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    store.init(Policy(max_folders=4))
    for i in range(7):
        rows = [(str(j), f"text {j}".encode()) for j in range(i * 3, i * 3 + 5)]
        maintenance.insert(store, spark.createDataFrame(rows, "external_id string, content binary"))
        if i == 3:
            maintenance.delete(store, spark.createDataFrame([(hashlib.sha256(f"text {j}".encode()).hexdigest(),) for j in range(4)], "identity_hex string"))
        maintenance.merge_folders(store)
        assert len(store.state()[0]["docs"]) <= 4
    assert store.docs().count() == 23 - 4 and store.all_docs().count() == 23
    again = spark.createDataFrame([(str(j), f"text {j}".encode()) for j in range(23)], "external_id string, content binary")
    status = {r.status: r["count"] for r in maintenance.insert(store, again).groupBy("status").count().collect()}
    assert status == {"already_exists": 19, "restored": 4} and store.docs().count() == 23


def test_pace_follows_how_long_batches_take(spark, tmp_path):
    pace = Pace(quick_s=1, slow_s=5, short_s=0.5, middle_s=2, longest_s=20)
    assert [pace.after(0.2) for _ in range(3)] == [0.5] * 3
    assert pace.after(3) == 2 and pace.after(8) == 4 and pace.after(8) == 8 and [pace.after(9) for _ in range(3)] == [16, 20, 20]
    assert [pace.after(0.1) for _ in range(16)][-1] == 0.5  # the slow ones have left the window
    root, pauses = tmp_path / "in", []
    store = Store(spark, str(tmp_path / "t"))
    store.init(Policy())
    rounds = iter(range(3))

    def more():
        i = next(rounds, None)
        if i is None:
            return False
        spark.createDataFrame([(i, f"text {i}"), (i + 100, f"other {i}")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(root))
        return True

    assert ingest_paced(lambda: table_stream(spark, str(root), "doc_id", "text"), store, str(tmp_path / "c"), Pace(), more, pauses.append) == 3
    assert store.docs().count() == 6 and len(pauses) == 3 and store.state()[0]["next_doc_id"] == 6


def test_scan_by_tag_and_with_a_timeout(spark, tmp_path, capsys):
    import io

    from bytesift import cli
    from bytesift.plans.resolve import compile_source as compiled

    (tmp_path / "a").write_bytes(b"needle")
    source = 'rule one : red blue { strings: $a = "needle" condition: $a } rule two : blue { strings: $a = "needle" condition: $a } rule three { strings: $a = "needle" condition: $a }'
    engine = Engine(spark, [])
    names = lambda tag: sorted(r.rule for r in engine.scan(source, [str(tmp_path / "a")], tag).collect())
    assert names(None) == ["one", "three", "two"] and names("blue") == ["one", "two"] and names("red") == ["one"] and names("none") == []
    assert compiled(source)[0] is compiled(source)[0]
    out = io.StringIO()
    assert cli.scan(spark, engine.scan(source, [str(tmp_path / "a")], "red"), 60, out) == 0 and out.getvalue().startswith("one ")
    slow = spark.range(0, 10**13, 1, 4).filter(F.xxhash64("id") == 0).select(F.lit("r").alias("rule"), F.lit("x").alias("external_id"))
    assert cli.scan(spark, slow, 2, out) == 2 and "cancelled" in capsys.readouterr().err
