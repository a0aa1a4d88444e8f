"""Exact encoding of texts through the tokenizers library, one distinct pre-token at a time.

The library encodes each pre-token on its own, so a text's ids are the concatenation of its pre-tokens' ids. A worker
keeps the ids of the pre-tokens it has met in a table of bounded size; only new ones go through the merge procedure.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries after which a worker's table starts anew.
TABLE_LIMIT = 200_000
#: Characters of text whose new pre-tokens are encoded together.
CHUNK_CHARS = 1_000_000

#: Fixed value: the split pattern of byte-level BPE vocabularies, with Unicode White_Space spelled out.
_WS = r"\t-\r\x20\x85\xa0  -     　"
BYTE_LEVEL_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


#: The letters, numbers and white space up to U+00FF. Texts of these alone take a faster matcher.
_NARROW = {r"\p{L}": r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": r"0-9\xb2\xb3\xb9\xbc-\xbe"}
#: Characters whose class is the same in every Unicode version from 6 on; texts with others are split by the library, or sent to it whole where it normalises.
_SETTLED = regex.compile("[^\u0000-\u036f\u0400-\u04ff\u2000-\u203f\u4e00-\u9fa5]")


def narrow(pattern: str) -> re.Pattern:
    """The split for texts up to U+00FF; classes stand inside brackets there."""
    pattern = re.sub(r" \?(\\p\{[LN]\})\+", r" ?[\1]+", pattern)
    for name, members in _NARROW.items():
        pattern = pattern.replace(name, members)
    return re.compile(pattern)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where visible, else the next free one from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class Vocabulary:
    """What the operators need from a tokenizer file: ids, merges in rank order, the split, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.byte_level, split = True, BYTE_LEVEL_SPLIT
        elif pre["type"] == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and pre["pretokenizers"][0]["invert"]:
            split = pre["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", rf"[^{_WS}")  # classes already in brackets
            self.byte_level = False
        else:
            raise ValueError(f"unsupported split in {path}")
        self.pattern, self.narrow, self._split = regex.compile(split), narrow(split), None

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._library_split(text) if self.byte_level and _SETTLED.search(text) else self.pattern.findall(text)
        return self.narrow.findall(text)

    def _library_split(self, text: str) -> list[str]:
        """The library's own split, where a character's class depends on the Unicode version."""
        if self._split is None:
            from tokenizers import Tokenizer

            self._split = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        return [text[a:b] for _, (a, b) in self._split(text)]

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which are kept as segments of their own."""
        if self._cut is None or not self._cut.search(text):
            return [text]
        return [s for s in self._cut.split(text) if s]


class TableEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: Vocabulary, encode_words: Callable[[list[str]], Iterable[bytes]], normalize: Callable[[str], str] | None = None, whole: Callable[[str], bytes] | None = None, limit: int = TABLE_LIMIT):
        self.vocabulary, self.encode_words, self.normalize, self.whole, self.limit = vocabulary, encode_words, normalize, whole, limit
        self.table: dict[str, bytes] = {}
        self.special = {s: i.to_bytes(4, "little") for s, i in vocabulary.special.items()}

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; special strings stand for themselves."""
        find, out = self.vocabulary.split, []
        for s in self.vocabulary.segments(text):
            if s in self.special:
                out.append(s)
            else:
                out += find(self.normalize(s) if self.normalize else s)
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out: list[bytes] = []
        held: list[list[str]] = []
        chars = 0
        for t in texts:
            if self.whole and not t.isascii() and _SETTLED.search(t):
                out += self._encode(held)
                out.append(self.whole(t))
                held, chars = [], 0
                continue
            held.append(self.words(t))
            chars += len(t)
            if chars >= CHUNK_CHARS:
                out += self._encode(held)
                held, chars = [], 0
        return out + self._encode(held)

    def _encode(self, held: list[list[str]]) -> list[bytes]:
        if len(self.table) > self.limit:
            self.table.clear()
        table = self.table
        if not table:
            table.update(self.special)
        new = list(set().union(*held).difference(table)) if held else []
        if new:
            table.update(zip(new, self.encode_words(new), strict=True))
        get = table.__getitem__
        return [b"".join(map(get, words)) for words in held]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def library_encoder(path: str) -> TableEncoder:
    """An encoder whose new pre-tokens go through the tokenizers library."""
    from tokenizers import Tokenizer

    vocab, tok = vocabulary(path), Tokenizer.from_file(path)
    letters = dict(enumerate(byte_alphabet()))
    model = tok.model  # merges one pre-token, spelled in the byte alphabet

    def encode_words(words: list[str]) -> Iterable[bytes]:
        for w in words:
            yield array("I", [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(letters))]).tobytes()

    def whole(text: str) -> bytes:
        return array("I", tok_whole.encode(text, add_special_tokens=False).ids).tobytes()

    rust = tok.normalizer.normalize_str if tok.normalizer is not None else None
    if rust is None:
        return TableEncoder(vocab, encode_words)
    tok_whole = Tokenizer.from_file(path)
    tok_whole.no_truncation()
    tok_whole.no_padding()

    def normalize(text: str) -> str:
        try:  # up to U+00FF all characters are composed already and have simple lower-case forms
            text.encode("latin-1")
        except UnicodeEncodeError:
            return rust(text)
        return text.lower()

    return TableEncoder(vocab, encode_words, normalize, whole)
