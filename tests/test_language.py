"""Parser, patterns and rule check."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytesift.plans import patterns as pt
from bytesift.plans.ast import And, At, Contains, Count, FileSize, In, NOf, Not, Offset, Or, StringDef, Verified
from bytesift.plans.check import check_source
from bytesift.plans.errors import RuleError
from bytesift.plans.parser import expand_includes, parse_rules, targets
from bytesift.plans.policy import Policy
from bytesift.plans.resolve import compile_source


def condition(text, strings='$a = "AAAA" $b = "BBBB" $x1 = "CCCC" $x2 = "DDDD"'):
    return parse_rules(f"rule r {{ strings: {strings} condition: {text} }}")[0].condition


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("$a and $b or not $a", Or((And((Contains("$a"), Contains("$b"))), Not(Contains("$a"))))),
        ("#a > 0", Contains("$a")),
        ("#a >= 1", Contains("$a")),
        ("#a == 0", Not(Contains("$a"))),
        ("#a < 1", Not(Contains("$a"))),
        ("#a > 2", Count("$a", ">", 2)),
        ("any of ($x*)", NOf(1, (Contains("$x1"), Contains("$x2")))),
        ("all of them", NOf(4, tuple(map(Contains, ("$a", "$b", "$x1", "$x2"))))),
        ("2 of ($a, $a, $b)", NOf(2, (Contains("$a"), Contains("$b")))),
        ("$a at 5", At("$a", Offset(5))),
        ("$a at pe.entry_point + 3", At("$a", Offset(3, "pe.entry_point"))),
        ("$a in (0..filesize-4)", In("$a", Offset(0), Offset(-4, "filesize"))),
        ("filesize <= 10KB and 1024 < filesize", And((FileSize("<=", 10240), FileSize(">", 1024)))),
        ("for any of ($a,$b) : ($ at 0)", Or((At("$a", Offset(0)), At("$b", Offset(0))))),
        ("for any i in (1..#a) : (@a[i] < 9)", Verified(In("$a", Offset(0), Offset(8)), Contains("$a"))),
    ],
)
def test_conditions(text, want):
    assert condition(text) == want


@pytest.mark.parametrize(
    ("source", "code"),
    [
        ("", "no-parseable-rule-block"),
        ("rule r { }", "no-condition-section"),
        ('rule r { strings: $a = "x" xor condition: $a }', "unsupported-literal-flags"),
        ("rule r { strings: $a = /x/g condition: $a }", "unsupported-regex-flags"),
        ("rule r { strings: $a = { 4G } condition: $a }", "unsupported-hex-syntax"),
        ("rule r { strings: $a = /(?=x)/ condition: $a }", "unsupported-regex-syntax"),
        ('rule r { strings: $a = "x condition: $a }', "invalid-literal-string"),
        ("rule r { condition: $a }", "unknown-string-reference"),
        ("rule r { condition: other }", "unknown-rule-reference"),
        ("rule r { condition: pe.nonsense == 1 }", "unsupported-condition-field"),
        ("rule r { condition: uint16(filesize) == 1 }", "nonliteral-byte-offset"),
        ("rule r { condition: uint16(0) == 0x10000 }", "numeric-read-literal-out-of-range"),
        ('rule r { strings: $a = "xxx" condition: #a > 1.5 }', "count-requires-integer-literal"),
        ("rule r { condition: hash.crc32(0, filesize) == \"00\" }", "unsupported-hash-function"),
        ('rule r { condition: hash.md5(1, filesize) == "00" }', "whole-file-only"),
        ("rule a { condition: b } rule b { condition: a }", "cyclic-rule-reference"),
        ('rule r { condition: hash.md5(0, filesize) == "d41d8cd98f00b204e9800998ecf8427e" }', "hash-identity-mismatch"),
        ('rule r { strings: $a = "ABCDEF" condition: not $a }', "negated-search-unbounded"),
        ("rule r { strings: $a = /[0-9]+/ condition: $a }", "regex-no-mandatory-literal"),
        ('rule r { strings: $a = "AB" condition: $a }', "requires-anchorable-literal"),
        ('rule r { strings: $a = "ABC" condition: $a }', "low-information-single-pattern"),
        ('rule r { strings: $a = "ABC" condition: $a in (0..100) }', "low-information-range-rule"),
        ('rule r { strings: $a = "ABC" condition: $a at pe.entry_point + 1 }', "low-information-entrypoint-stub"),
        ("rule r { condition: cuckoo.network.http(/x/) }", "ignored-module-no-anchor"),
        ("rule r { strings: " + " ".join(f'$s{i} = "abcde{i}fgh" nocase wide ascii' for i in range(4)) + " condition: any of them }", "overbroad-union"),
    ],
)
def test_issue_codes(source, code):
    report = check_source(source)
    assert report.status == "unsupported"
    assert code in [i.code for i in report.issues]


def test_check_places_warnings_and_roll_up():
    source = 'private rule p {\n strings: $z = /[0-9]+/ condition: $z }\nrule a {\n strings: $a = "ABCDEF"\n condition: $a and #a > 3 and not p }\nrule b { strings: $a = "ABCDEF" condition: $a or androguard.url("x") }'
    report = check_source(source)
    assert [r.status for r in report.rules] == ["unsupported", "searchable-needs-verify", "unsupported"]
    assert report.status == "unsupported" and report.verifier_only_kinds == ["count"]
    assert report.rules[2].ignored_module_calls == ['androguard.url("x")']
    bad = check_source('rule a {\n condition:\n  filesize ~ 3 }').issues[0]
    assert (bad.line, bad.snippet) == (3, "filesize ~ 3 }")
    assert check_source('rule a { strings: $a = "ABCDEF" condition: $a }').status == "searchable"
    assert check_source('rule a { condition: hash.md5(0,filesize) == "d41d8cd98f00b204e9800998ecf8427e" }', Policy(id_source="md5")).status == "searchable"


def test_comments_sections_modifiers_and_targets():
    source = """
    import "pe" /* block " */
    private global rule P : t1 t2 { meta: a = "x // y" b = 3 c = true condition: true }
    rule Q { strings: $a = "x/*y*/z" // line
      $ = { 41 42 // hex comment
            43 } private
      $r = /a\\/b[/]c/ condition: $a and any of them }
    """
    rules = parse_rules(source)
    assert [(r.name, r.private, r.is_global, r.tags) for r in rules] == [("P", True, True, ("t1", "t2")), ("Q", False, False, ())]
    assert dict(rules[0].meta) == {"a": "x // y", "b": 3, "c": True}
    assert rules[1].strings[0].value == b"x/*y*/z" and rules[1].strings[2].value == "a\\/b[/]c"
    assert [r.name for r in targets(rules)] == ["Q"]
    assert [q.name for q in compile_source("private rule one { condition: true } private rule two { condition: true }")] == ["one"]


def test_includes():
    files = {"top.yar": 'include "sub/one.yar"\nrule t { condition: one }', "sub/one.yar": 'include "../two.yar"\nrule one { condition: two }', "two.yar": "rule two { condition: true }"}
    text = expand_includes("top.yar", files.__getitem__)
    assert [q.name for q in compile_source(text)] == ["two", "one", "t"]
    with pytest.raises(RuleError, match="includes itself"):
        expand_includes("a", {"a": 'include "a"'}.__getitem__)
    with pytest.raises(RuleError, match="cannot read"):
        expand_includes("a", {"a": 'include "b"'}.__getitem__)


def compiled(kind, value, *modifiers):
    return pt.compile_string(StringDef("$a", kind, value, frozenset(modifiers), 0))


@pytest.mark.parametrize(
    ("regex", "text", "hit"),
    [
        (r"ab+cd", b"xabbcdx", True),
        (r"(foo.*bars){2}", b"foo1barsfoo2bars", True),
        (r"[A-Z]+applesause[0-9]+", b"ZZapplesause123", True),
        (r"[A-Z]+applesause[0-9]+", b"applesauseABC", False),
        (r"fooba(bar|baz)qux", b"xxfoobabarquxzz", True),
        (r"fooba(bar|baz)qux", b"xxfoobatquxzz", False),
        (r"a.c", b"a\nc", False),
        (r"\x41\.\d{2,3}", b"A.12", True),
        (r"^abc$", b"abc\n", False),
        (r"a[^\]b]c", b"a]c", False),
        (r"\bword\b", b"a word.", True),
        (r"\bword\b", b"swords", False),
    ],
)
def test_expressions_and_their_anchors(regex, text, hit):
    p = compiled("regex", regex)
    # Python's byte expressions read the same syntax as the JVM's over ISO-8859-1, but for the end of text
    assert bool(re.search(p.regex.replace(r"\z", r"\Z").encode(), text)) is hit
    own = p.anchors(3)
    if hit and own is not None:
        assert any(a in text for a in own)


def test_anchor_sets():
    assert compiled("text", b"abc", "ascii", "wide").anchors(4) is None  # the plain form is too short
    assert compiled("text", b"abcd", "ascii", "wide").anchors(4) == {b"abcd", b"a\0b\0c\0d\0"}
    assert compiled("regex", "ab+cd").anchors(3) == {b"bcd"}
    assert compiled("hex", "01 02 ?? 04 05 [1-2] 06 07 08 09").anchors(3) == {bytes([6, 7, 8, 9])}
    assert compiled("regex", "[0-9]+").anchors(3) is None
    assert compiled("regex", "(abcd|efgh)?xy").anchors(3) is None
    assert all(len(a) >= 4 for a in compiled("text", b"Some Longer Text", "nocase").anchors(4))


pieces = st.recursive(
    st.sampled_from(["a", "b", "c", "ab", "abc", "[ab]", ".", "x"]),
    lambda inner: st.one_of(
        st.tuples(inner, inner).map("".join),
        st.tuples(inner, inner).map(lambda t: f"(?:{t[0]}|{t[1]})"),
        st.tuples(inner, st.sampled_from(["?", "*", "+", "{2}", "{1,2}", "{0,1}", "+?"])).map(lambda t: f"(?:{t[0]}){t[1]}"),
    ),
    max_leaves=8,
)


@settings(max_examples=400, deadline=None)
@given(pieces, st.text("abcx", max_size=14))
def test_anchors_miss_no_match(regex, text):
    p = compiled("regex", regex)
    own = p.anchors(3)
    hit = re.search(regex, text)
    assert bool(re.search(p.regex.encode(), text.encode())) is bool(hit)
    if hit and own is not None:
        assert any(a in hit.group().encode() for a in own)


def test_policies():
    for bad in ({"grams": (4, 3)}, {"grams": (2, 4)}, {"grams": (3, 9)}, {"tier1_fp": 0.6}, {"id_source": "crc"}, {"shards": 0}):
        with pytest.raises(ValueError):
            Policy(**bad)
    p = Policy(grams=(5, 8), id_source="sha512")
    assert Policy.from_json(p.to_json()) == p and not p.searches_with(Policy())
