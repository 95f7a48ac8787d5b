"""Filters, header fields, entropy."""

import math
import random
import re
import struct

import numpy as np
import pytest

from bytesift.functions import bloom
from bytesift.functions.automaton import Automaton
from bytesift.functions.headers import LNK, entropy, header_fields, is_special, sampled_entropy
from bytesift.operators import search
from bytesift.plans.ast import StringDef
from bytesift.plans.patterns import compile_string


def test_filters_hold_what_was_put_in(spark):
    rng = np.random.default_rng(1)
    data = [b"", b"ab", b"abc", rng.bytes(5000), b"abcabcabc" * 50]
    for n, k in ((3, 1), (4, 2), (8, 7)):
        rows = []
        for i, d in enumerate(data):
            words, log2 = bloom.build(bloom.grams_of(d, n), k)
            assert len(words) == 1 << log2
            rows.append((i, words.tolist(), log2))
        df = spark.createDataFrame(rows, "i int, w array<long>, l int")
        for i, d in enumerate(data):
            own = {d[j : j + n] for j in range(len(d) - n + 1)}
            assert len(bloom.grams_of(d, n)) == len(own)
            for gram in sorted(own)[:5]:
                test = bloom.may_hold(df["w"], df["l"], bloom.packed(gram), k)
                assert df.filter(df["i"] == i).select(test).first()[0] is True
    words, log2 = bloom.build(bloom.grams_of(data[3], 3), 2)
    absent = spark.createDataFrame([(words.tolist(), log2)], "w array<long>, l int")
    tests = [bloom.may_hold(absent["w"], absent["l"], g, 2) for g in rng.integers(0, 1 << 24, 300).tolist()]
    assert sum(absent.select(*[t.alias(str(i)) for i, t in enumerate(tests)]).first()) < 150


def test_literal_grams_are_spread():
    assert bloom.literal_grams(b"ABCD", 3, 16) == [bloom.packed(b"ABC"), bloom.packed(b"BCD")]
    own = bloom.literal_grams(bytes(range(100)), 3, 16)
    assert len(own) == 16 and own[0] == bloom.packed(bytes([0, 1, 2])) and own[-1] == bloom.packed(bytes([97, 98, 99]))
    assert bloom.literal_grams(b"AB", 3, 16) == []


def test_gram_estimates_are_near():
    rng = np.random.default_rng(3)
    for size in (0, 3, 10, 1000, 40_000, 300_000):
        data = rng.bytes(size)
        assert abs(bloom.estimated_grams(data, 4) - len(bloom.grams_of(data, 4))) <= max(2, 0.03 * size)


def test_gram_estimates_are_near_for_every_content():
    errors = []
    for seed in range(600):
        data = np.random.default_rng(seed).bytes(12_000)
        exact = len(bloom.grams_of(data, 4))
        errors.append(bloom.estimated_grams(data, 4) / exact - 1)
    assert max(map(abs, errors)) < 0.015  # far from the 3 % that an estimate may be away
    for size in (100_000, 160_000, 250_000, 2_000_000):  # where an estimate from empty registers hands over
        data = np.random.default_rng(size).bytes(size)
        assert abs(bloom.estimated_grams(data, 4) / len(bloom.grams_of(data, 4)) - 1) < 0.02


REPEATS = [r"(ab|c)+x", r"(a|bc)*d", r"((a|bc)+d?)+b", r"\b(ab|cd)+\b", r"^(ab|c)*d$", r"x(a|bc){0,200}\Bd", r"([ab]c|d)+?[^a]", r"(ab|cd)+", r"(a{2}|b)+c.d", r"(ab?){3,}c$"]


@pytest.mark.parametrize("source", REPEATS)
@pytest.mark.parametrize("modifiers", [(), ("fullword",), ("wide",), ("wide", "ascii", "fullword"), ("nocase",)])
def test_automaton_finds_the_starts_that_backtracking_finds(source, modifiers):
    random.seed(source)
    p = compile_string(StringDef("$a", "regex", source, frozenset(modifiers), 0))
    assert p.forms
    own = Automaton(p.forms)
    other = re.compile(b"(?=" + p.regex.replace(r"\z", r"\Z").encode("latin-1") + b")", re.S)
    for _ in range(80):
        data = bytes(random.choice(random.choice([b"abcdx", b"abcdx _", b"abc\0d\0x", b"ABCDabcd"])) for _ in range(random.randint(0, 40)))
        if "wide" in modifiers and random.random() < 0.7:
            data = b"".join(bytes([b, 0]) for b in data)
        assert list(own.starts(data)) == sorted({m.start() for m in other.finditer(data)}, reverse=True)


def test_repeats_over_long_contents(spark):
    ten = 10 << 20
    rows = [(1, b"abcd" * (ten // 4)), (2, b"abcd" * (ten // 4) + b"x"), (3, b"a" * ten + b"bcd"), (4, b"bc" * (ten // 2)), (5, None), (6, b"")]
    df = spark.createDataFrame(rows, "i int, content binary")
    source = r"""
rule tail { strings: $a = /(ab|cd)+x/ condition: $a }
rule middle { strings: $a = /(a|bc)*d/ condition: $a }
rule nested { strings: $a = /((ab?|cd)+c?)+x/ condition: $a at 0 }
rule many { strings: $a = /(ab|cd)+x/ condition: #a > 1000 }
"""
    got = {(r.rule, r.i) for r in search.scan(df, source).select("rule", "i").collect()}
    assert got == {("tail", 2), ("middle", 1), ("middle", 2), ("middle", 3), ("nested", 2), ("many", 2)}


def pe(machine=0x14C, traits=0x0200, magic=0x20B, signed=(1, 8), dotnet=(0, 0)):
    data = bytearray(0x240)
    data[:2], data[0x3C:0x40], data[0x80:0x84] = b"MZ", struct.pack("<I", 0x80), b"PE\0\0"
    struct.pack_into("<HHIIIHH", data, 0x84, machine, 1, 0x12345678, 0, 0, 0xF0, traits)
    head = 0x98
    struct.pack_into("<H", data, head, magic)
    struct.pack_into("<I", data, head + 16, 0x1000)
    struct.pack_into("<I", data, head + 60, 0x200)
    struct.pack_into("<H", data, head + 68, 3)
    directories = head + (112 if magic == 0x20B else 96)
    struct.pack_into("<I", data, directories - 4, 16)
    struct.pack_into("<II", data, directories + 8 * 4, *signed)
    if directories + 8 * 14 + 8 <= 0x200:
        struct.pack_into("<II", data, directories + 8 * 14, *dotnet)
    struct.pack_into("<8sIIII", data, 0x80 + 24 + 0xF0, b".text", 0x100, 0x1000, 0x40, 0x200)
    data[0x200:0x210] = b"ENTRYPOINT-PE!!!"
    return bytes(data)


def test_pe():
    f = header_fields(pe())
    assert (f["pe_is_pe"], f["pe_is_64bit"], f["pe_is_32bit"], f["pe_is_dll"], f["pe_is_signed"], f["dotnet_is_dotnet"]) == (True, True, False, False, False, False)
    assert (f["pe_machine"], f["pe_subsystem"], f["pe_timestamp"], f["pe_characteristics"]) == ([0x14C], [3], [0x12345678], [0x0200])
    assert (f["pe_entry_point"], f["pe_entry_bytes"]) == (0x200, b"ENTRYPOINT-PE!!!")
    assert header_fields(pe(traits=0x2000))["pe_is_dll"] and header_fields(pe(magic=0x10B))["pe_is_32bit"]
    assert header_fields(pe(signed=(0x100, 64)))["pe_is_signed"] and header_fields(pe(dotnet=(0x1000, 72)))["dotnet_is_dotnet"]
    for cut in range(0, 0x240, 7):  # truncated headers are no error
        header_fields(pe()[:cut])
    f = header_fields(b"MZ" + b"\xff" * 100)
    assert f["pe_is_pe"] is False and f["pe_is_dll"] is None and f["pe_machine"] == []


def test_other_formats():
    elf = b"\x7fELF\x02\x01\x01\x03" + bytes(8) + struct.pack("<HH", 2, 62)
    f = header_fields(elf)
    assert (f["elf_is_elf"], f["elf_type"], f["elf_machine"], f["elf_os_abi"]) == (True, [2], [62], [3])
    big = b"\x7fELF\x02\x02\x01\x03" + bytes(8) + struct.pack(">HH", 2, 21)
    assert header_fields(big)["elf_machine"] == [21]
    thin = struct.pack("<IIII", 0xFEEDFACF, 7, 3, 2)
    assert header_fields(thin)["macho_cpu_type"] == [7]
    fat = struct.pack(">II", 0xCAFEBABE, 2) + struct.pack(">IIIII", 0, 0, 48, 16, 0) + struct.pack(">IIIII", 0, 0, 64, 16, 0) + thin + struct.pack(">IIII", 0xFEEDFACE, 12, 9, 6)
    f = header_fields(fat)
    assert (f["macho_is_macho"], f["macho_cpu_type"], f["macho_file_type"]) == (True, [7, 12], [2, 6])
    f = header_fields(b"dex\n035\0")
    assert (f["dex_is_dex"], f["dex_version"]) == (True, [35])
    ticks = [(1_700_000_000 + i + 11_644_473_600) * 10_000_000 for i in range(3)]
    lnk = LNK + bytes(8) + struct.pack("<QQQ", *ticks) + bytes(24)
    f = header_fields(lnk)
    assert (f["lnk_creation_time"], f["lnk_access_time"], f["lnk_write_time"]) == ([1_700_000_000], [1_700_000_001], [1_700_000_002])
    assert header_fields(b"Cr24xxxx")["crx_is_crx"] and header_fields(b"PK\x03\x04")["crx_is_crx"] is False
    assert all(v is False or v in (None, []) for v in header_fields(b"").values())


def test_entropy():
    assert entropy(b"") == 0 and entropy(b"aaaa") == 0 and entropy(bytes(range(256))) == 8
    assert math.isclose(entropy(b"aab"), 0.918296, rel_tol=1e-5)
    assert sampled_entropy(b"x" * 100) is None
    assert is_special(np.random.default_rng(1).bytes(8 << 20)) and not is_special(bytes(8 << 20)) and not is_special(b"\x00\xff")


def test_short_reads_see_no_key_beyond_two_bytes(spark, tmp_path):
    from bytesift import registry_files

    keys = [1, 137, 138, 65_534, 65_535, 65_536, 65_536 + 137, 3 * 65_536 + 137, (1 << 32) + 137]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    found = registry_files.QUERIES["numeric_reads"](spark, str(tmp_path)).collect()
    for kind in ("int16", "uint16", "int32", "uint32", "int64", "uint64"):
        assert [r.p_partkey for r in found if r.rule in (kind, f"{kind}be")] == [137, 137]
    assert sorted(r.p_partkey for r in found if r.rule == "negative") == sorted(k for k in keys if k % 100 == 37)


def test_expressions_of_a_scan_share_one_python_worker(spark):
    from bytesift.operators import search

    rules = "\n".join(f"rule r{i} {{ strings: $a = /(an|on|{w})+x/ condition: $a }}" for i, w in enumerate(("th", "er", "in", "at")))
    out = search.scan(spark.createDataFrame([(1, bytearray(b"ananx")), (2, bytearray(b"thx")), (3, None)], "id long, content binary"), rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2  # of the filter and of the names
    assert sorted((r.rule, r.id) for r in out.collect()) == [("r0", 1), ("r0", 2), ("r1", 1), ("r2", 1), ("r3", 1)]
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 128
