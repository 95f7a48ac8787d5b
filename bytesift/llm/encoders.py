"""Exact tokenizer front ends that remember the encoding of recurring words.

Both tokenizers split a text into parts that no merge can cross; a part's ids do not depend on its neighbours.
Each worker keeps a bounded memo from part to ids, so a recurring word is encoded once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: The pre-tokenizer's own pattern of byte-level BPE with use_regex (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries after which a memo of ids, or of numbers of pieces, takes no more (what recurs most came first), and characters of the longest.
MEMO_ENTRIES, MEMO_COUNTS, MEMO_CHARS = 200_000, 800_000, 48
#: What stands for a space in sentencepiece's vocabularies.
MARK = "\u2581"


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer's version: a digest of its file and of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    sha = hashlib.sha256(f"{lib.__name__} {lib.__version__}\n".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            sha.update(block)
    return sha.hexdigest()


def byte_alphabet() -> dict[str, int]:
    """The characters in which byte-level vocabularies write bytes: visible Latin-1 stands for itself, the other bytes in order for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(model: dict) -> dict[bytes, int] | None:
    """bytes -> id, where ids are in order of the merges, as the fast encoder needs them; else None."""
    vocab, alphabet = model["vocab"], byte_alphabet()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab.get("".join(m), -1) for m in pairs]
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges") or any(a >= b for a, b in zip(made, made[1:])):
        return None
    tokens = [*alphabet, *("".join(m) for m in pairs)]
    if any(t not in vocab for t in tokens):
        return None
    return {bytes(alphabet[c] for c in t): vocab[t] for t in tokens}


class ByteLevelEncoder:
    """A tokenizers .json with byte-level BPE: texts -> little-endian unsigned 32-bit ids, as the library gives them.

    A space starts a part of its own wherever the character before it or after it is no white space, so texts are
    split at spaces and recurring chunks come from a memo. New chunks are encoded with the same file's vocabulary
    as ranks, which gives the library's ids at several times its speed (tests hold the two against each other).
    Texts with an added token, which the library turns into its single id, and all texts of a file with a
    normalizer, a template, another pre-tokenizer or unordered merges are left to the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tk = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        ranks = _ranks(spec["model"]) if plain else None
        self.fast = ranks and tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.odd = re.compile("|".join([r"\s (?:\s|$)", *(re.escape(a["content"]) for a in added)])).search
        self.added = re.compile("|".join(re.escape(a["content"]) for a in added) or r"(?!)").search
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _new(self, chunk: str) -> bytes:
        ids = array("I", self.fast(" " + chunk)).tobytes()
        if len(self.memo) < MEMO_ENTRIES and len(chunk) <= MEMO_CHARS:
            self.memo[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.fast or self.added(text):
            return self.whole(text)
        if self.odd(text):
            return array("I", self.fast(text)).tobytes()
        head, *rest = text.split(" ")
        get, new = self.memo.get, self._new
        return array("I", self.fast(head)).tobytes() + b"".join([get(c) or new(c) for c in rest])

    def many(self, texts: list[str]) -> list[bytes]:
        return [self(x) for x in texts]


class PieceCounter:
    """A sentencepiece .model: texts -> numbers of pieces, without begin and end.

    Where the model changes nothing before it splits (identity normalizer, white space kept, a dummy prefix) and no
    piece has a space after another character, a run of spaces and the word after it are encoded alone: the dummy
    prefix stands for the last space of the run. Recurring words come from a memo, new ones are encoded in one
    call, for the pieces show where each begins. Other models are encoded text by text.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n = spec.normalizer_spec
        user = [p.piece for p in spec.pieces if p.type == p.USER_DEFINED]
        self.by_part = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix and spec.trainer_spec.model_type == spec.trainer_spec.BPE and not user and not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
        self.starts = np.array([p.piece.startswith(MARK) for p in spec.pieces])
        self.parts = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+").findall
        self.odd = re.compile(f"  |^ | $|{MARK}").search
        self.of_word: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.sp.encode(text))

    def _run(self, text: str) -> int:
        """A text with runs of spaces, or with the model's own mark, which is a space to it."""
        first, *rest = self.parts(text)
        return self.whole(first) + sum(self.whole(p[1:]) if len(p) > 1 else self.whole("a ") - self.whole("a") for p in rest)

    def many(self, texts: list[str]) -> list[int]:
        if not self.by_part:
            return [self.whole(x) for x in texts]
        cut = [None if not x or self.odd(x) else x.split(" ") for x in texts]
        new = list(set().union(*(c for c in cut if c)) - self.of_word.keys())
        fresh: dict[str, int] = {}
        if new:
            fresh = self._split(new)
        get = self.of_word.get
        out = [(self._run(x) if x else 0) if c is None else sum([get(w) or fresh[w] for w in c]) for x, c in zip(texts, cut)]
        if len(self.of_word) < MEMO_COUNTS:
            self.of_word.update((w, n) for w, n in fresh.items() if len(w) <= MEMO_CHARS)
        return out

    def _split(self, words: list[str]) -> dict[str, int]:
        ids = np.array(self.sp.encode(" ".join(words)))
        at = np.flatnonzero(self.starts[ids])
        if len(at) != len(words):
            return {w: self.whole(w) for w in words}
        return dict(zip(words, np.diff(at, append=len(ids)).tolist()))


@lru_cache(maxsize=4)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


@lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_many(path: str, texts: list[str]) -> list[int]:
    """The number of tokens of each text, by the library that reads path."""
    if path.endswith(".model"):
        return piece_counter(path).many(texts)
    return [len(x) // 4 for x in byte_level_encoder(path).many(texts)]
