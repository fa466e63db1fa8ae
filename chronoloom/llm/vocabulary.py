"""A public byte-pair vocabulary file (tokenizers JSON): its path, its library
tokenizer, and the text normalisation and pre-tokenisation that it states."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def default_path() -> str:
    """The file of the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


@lru_cache(maxsize=2)
def stated(path: str) -> dict:
    """What the file says besides the model: that one has a hundred thousand strings, and stays in the library alone."""
    return {key: x for key, x in load(path).items() if key != "model"}


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizers library's own tokenizer, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def specials(path: str) -> list[str]:
    """Added tokens, which the library cuts out of a text before all else."""
    return [x["content"] for x in stated(path)["added_tokens"]]


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


#: Code points below this one are known here; others are left to the library.
_PLANES = 0x20000


def _same(c: str) -> bool:
    """True for characters that all Unicode versions since 3.2 treat alike, and for those without
    letter case, decomposition or order that are neither letter, number nor space (emoji, say):
    a version that doesn't know them takes them for the same."""
    old = unicodedata.ucd_3_2_0
    if unicodedata.category(c)[0] in "SP" and not unicodedata.decomposition(c) and not unicodedata.combining(c) and c.lower() == c:
        return old.category(c)[0] in "SPC"
    return old.category(c) != "Cn" and all(getattr(old, f)(c) == getattr(unicodedata, f)(c) for f in ("category", "combining", "decomposition"))


@lru_cache(maxsize=1)
def _changed() -> re.Pattern:
    """Finds characters that a library of another Unicode version may treat otherwise."""
    ranges, start = [], None
    for k in range(_PLANES):
        good = not 0xD800 <= k < 0xE000 and _same(chr(k))
        if good and start is None:
            start = k
        if not good and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{k - 1:08x}")
            start = None
    if start is not None:
        ranges.append(f"\\U{start:08x}-\\U{k:08x}")
    return re.compile("[^" + "".join(ranges) + "]")


def pre_tokens(text: str, path: str) -> list[str]:
    """Normalised pre-tokens of a text without special strings: NFC, lower case of each
    character by itself, then the stated pattern (which drops white space). Texts with
    characters that Unicode versions treat differently are split by the library."""
    if text.isascii():
        return splitter(path, True).findall(text.lower())
    if not _changed().search(text):
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # str.lower() alone knows a final sigma
        return splitter(path, False).findall(text.lower())
    own = library(path)
    back = _letter_bytes()
    return [bytes([back[c] for c in piece]).decode() for piece, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))]


@lru_cache(maxsize=1)
def _letter_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_letters())}


@lru_cache(maxsize=4)
def splitter(path: str, ascii_only: bool):
    """The pattern of the vocabulary's pre-tokeniser; for lower-case ASCII texts without Unicode
    classes, which the standard library's engine runs faster."""
    steps = stated(path)["pre_tokenizer"]["pretokenizers"]
    pattern = next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split")
    if not ascii_only:
        return regex.compile(pattern)
    for kind, own in ((r"\p{L}", "a-z"), (r"\p{N}", "0-9"), (r"\s", r"\t-\r ")):
        pattern = pattern.replace(f"[{kind}]", f"[{own}]").replace(kind, own)
    return re.compile(pattern)
