"""Byte-level BPE shared by the token counter and the encoder: vocabulary files and the split before the merges.

Vocabulary files are read from a path that the caller gives, once per Python worker, and are never copied.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import unicodedata
from itertools import pairwise

import regex

#: Code points with the White_Space property, which the split pattern's ``\s`` stands for.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A boundary always lies between a character that is no white space and white space, so these pieces can be split apart.
FRAGMENT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: Characters of two units in UTF-16.
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def split_pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


@functools.cache
def late_letters() -> frozenset[str]:
    """Letters and numbers that ``regex`` knows and the tokenizer libraries, of an older Unicode, do not: to them they are other characters.

    What the libraries know is asked of one of them, which passes over what its pattern does not match.
    """
    import tiktoken

    rest = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")
    here = "".join(regex.findall(r"[\p{L}\p{N}]", rest))
    known = tiktoken.Encoding("known", pat_str=r"[\p{L}\p{N}]", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return frozenset(here) - frozenset(known.decode_bytes(known.encode_ordinary(here)).decode())


def split(text: str) -> list[str]:
    """The pieces that are merged separately."""
    if text.isascii() or late_letters().isdisjoint(text):
        return split_pattern().findall(text)
    late = late_letters()
    masked = "".join("\ue000" if c in late else c for c in text)  # a character that is neither letter, number nor white space
    return [text[m.start() : m.end()] for m in split_pattern().finditer(masked)]


@functools.cache
def plain_split_pattern() -> re.Pattern | None:
    """The split pattern for ``re``, which is faster than ``regex``, over the letters and numbers that the libraries know, for texts without ``ASTRAL`` characters.

    None if the given pattern is another one than is written out here.
    """
    import public_tokenizers

    if public_tokenizers.PATTERN != r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+":
        return None
    shared = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c) not in late_letters())
    runs = lambda kind: "".join(f"{re.escape(x[0])}-{re.escape(x[-1])}" for x in regex.findall(kind, shared) for x in ranges(x))
    letters, numbers, space = runs(r"\p{L}+"), runs(r"\p{N}+"), WHITE_SPACE
    return re.compile(f" [{letters}]+|[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def ranges(sorted_characters: str) -> list[str]:
    """Stretches of characters whose code points follow each other."""
    cuts = [0, *(i for i in range(1, len(sorted_characters)) if ord(sorted_characters[i]) != ord(sorted_characters[i - 1]) + 1), len(sorted_characters)]
    return [sorted_characters[a:b] for a, b in pairwise(cuts)]


def plain_split(text: str) -> list[str]:
    """What :func:`split` gives, faster."""
    return split(text) if ASTRAL.search(text) or (plain := plain_split_pattern()) is None else plain.findall(text)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the vocabulary file to byte values: printable bytes stand for themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def json_ranks(path: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int], tuple[str, ...]]:
    """Of a byte-level ``.json`` vocabulary: ids of byte strings, ranks of merges, special strings."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    table = byte_alphabet()
    raw = lambda s: bytes(table[c] for c in s)
    special = tuple(x["content"] for x in data.get("added_tokens", ()))
    vocab = {raw(k): v for k, v in data["model"]["vocab"].items() if k not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    return vocab, {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}, special


@functools.cache
def tiktoken_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
