"""Errors of the rule language, each with a stable code and a place in the source."""

from __future__ import annotations

#: What to do about an error of each code (fixed texts of this library).
REMEDIES = {
    "no-parseable-rule-block": "Write at least one `rule NAME { condition: ... }`.",
    "no-condition-section": "Add a `condition:` section.",
    "unsupported-literal-flags": "Use only ascii, wide, nocase, fullword and private on text strings.",
    "unsupported-regex-flags": "Use only ascii, wide, nocase and fullword, and the flags i and s.",
    "unsupported-hex-syntax": "Use hex bytes, ?, ??, [n], [n-m], [n-], [-] and ( .. | .. ).",
    "unsupported-regex-syntax": "Leave out back references, look-around and named groups.",
    "invalid-literal-string": "Close the string and use only the escapes \\\\ \\\" \\n \\r \\t \\xHH.",
    "unsupported-strings-declaration": "Write `$id = \"text\"`, `$id = /regex/` or `$id = { hex }`.",
    "unsupported-condition-field": "Compare a supported field; see the list of fields.",
    "unsupported-condition-syntax": "Rewrite the condition with the supported operators.",
    "unsupported-comparison-operator": "Use the comparison that this construct allows.",
    "nonliteral-byte-offset": "Give the byte offset as a whole number.",
    "count-requires-integer-literal": "Compare the count with a whole number.",
    "numeric-read-literal-out-of-range": "Use a value that fits the width that is read.",
    "unknown-rule-reference": "Define the rule before it is used, or correct its name.",
    "unknown-string-reference": "Declare the string in the strings section.",
    "cyclic-rule-reference": "Rules must not refer to each other in a circle.",
    "cyclic-include": "Files must not include each other in a circle.",
    "include-not-found": "Correct the path; it is relative to the including file.",
    "hash-identity-mismatch": "Use the digest that the table's identities are, or verify the search.",
    "hash-identity-source-unknown": "Name the identity source of the table.",
    "unsupported-hash-function": "Use hash.md5, hash.sha1, hash.sha256 or hash.sha512.",
    "whole-file-only": "Hash and entropy functions take (0, filesize).",
    "negated-search-unbounded": "Add a positive string, size or header condition beside the negated strings.",
    "overbroad-union": "Require one anchored string on every path, or search fewer alternatives.",
    "regex-no-mandatory-literal": "Give the expression a run of fixed bytes at least as long as a gram.",
    "nocase-no-anchorable-window": "Use a longer literal, or one with fewer letters.",
    "requires-anchorable-literal": "Use a string with a run of fixed bytes at least as long as a gram.",
    "verifier-only-no-anchor": "Combine the condition with an anchored string, a size or a header field.",
    "low-information-entrypoint-stub": "Use a longer or less common byte sequence.",
    "low-information-range-rule": "Use longer strings in range conditions.",
    "low-information-single-pattern": "Use a longer string, or a second one.",
    "ignored-module-no-anchor": "Combine the module's predicate with an anchored string.",
    "ignored-module": "The index treats the call as unknown; verification can't evaluate it.",
    "verifier-only": "Search with verification for exact results.",
    "negated-search": "Search with verification for exact results.",
}


class RuleError(ValueError):
    """A rule that can't be used: code, message and the offset in the source, if known."""

    def __init__(self, code: str, message: str, offset: int | None = None):
        super().__init__(message)
        self.code, self.message, self.offset = code, message, offset

    @property
    def remedy(self) -> str | None:
        return REMEDIES.get(self.code)


def place(source: str, offset: int | None) -> tuple[int | None, int | None, str | None]:
    """Line and column, from 1, and the line's text."""
    if offset is None:
        return None, None, None
    offset = min(offset, len(source))
    start = source.rfind("\n", 0, offset) + 1
    end = source.find("\n", offset)
    return source.count("\n", 0, offset) + 1, offset - start + 1, source[start : end if end >= 0 else len(source)].strip()
