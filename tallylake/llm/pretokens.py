"""Splitting texts into pre-tokens exactly as the public tokenizers do.

Texts that fit Latin-1 take the standard ``re`` engine with explicit character classes; all others take the tokenizers library's own
splitter, so that letters, numbers and white space are those of its Unicode version. Both give the same pieces; only their speed differs.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

# White space, letters and numbers of Latin-1.
LATIN_WHITE = "\\t-\\r \\x85\\xa0"
LATIN_LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
LATIN_NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"


def explicit(pattern: str) -> str:
    """``pattern`` with its classes written out for Latin-1."""
    out = pattern.replace("[^\\s", f"[^{LATIN_WHITE}").replace("\\S", f"[^{LATIN_WHITE}]").replace("\\s", f"[{LATIN_WHITE}]")
    out = re.sub(r"\[\\p\{([LN])\}\]", r"\\p{\1}", out)
    inside = lambda m: m[0].replace("\\p{L}", LATIN_LETTERS).replace("\\p{N}", LATIN_NUMBERS)
    out = re.sub(r"\[\^[^\]]*\]", inside, out)
    return out.replace("\\p{L}", f"[{LATIN_LETTERS}]").replace("\\p{N}", f"[{LATIN_NUMBERS}]")


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """``pattern`` applied to whole texts; ``(text)`` gives the list of matches."""

    def __init__(self, pattern: str):
        self.latin = re.compile(explicit(pattern))
        self.wide = Split(Regex(pattern), "removed", invert=True)

    def __call__(self, text: str) -> list[str]:
        if is_latin(text):
            return self.latin.findall(text)
        return [text[a:b] for _, (a, b) in self.wide.pre_tokenize_str(text)]


@lru_cache
def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte, as a translation table of code points."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def spelled(word: str) -> str:
    """``word`` in the byte alphabet."""
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(byte_alphabet())


class WordSplitter:
    """Pre-tokens of a lower-casing word vocabulary (a tokenizers .json file).

    ``(text)`` gives the pre-tokens and the special strings found in the raw text, in order, as ``(words, special)``
    segments: special strings are taken whole, as the library does by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = Splitter(split["pattern"]["Regex"])
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.merges = spec["model"]["merges"]

    def words(self, text: str) -> list[str]:
        # Composed Latin-1 text needs no normaliser beyond lower-casing; all other texts take the library's.
        text = text.lower() if is_latin(text) else self.tokenizer.normalizer.normalize_str(text)
        return self.split(text)

    def segments(self, text: str):
        if self.special_re is None or not any(s in text for s in self.special):
            yield self.words(text), None
            return
        for part in self.special_re.split(text):
            if part in self.special:
                yield [], self.special[part]
            elif part:
                yield self.words(part), None


@lru_cache
def word_splitter(path: str) -> WordSplitter:
    return WordSplitter(path)
