"""Budgets in tokens of a byte-level BPE: chunks, packing that counts joins anew, and spans that split no character.

A vocabulary is a rank file (``.tiktoken``) at a path that every executor has; it is read once a worker. Strings of special tokens
are ordinary text. The texts of a context are in one row, so packing is a function of the row and nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the usual split of a byte-level BPE before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count(path: str) -> Callable[[Column], Column]:
    """A column function that counts a text's tokens; a null text has none."""

    @F.pandas_udf("int")
    def tokens(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0)

    return tokens


def trimmed(offsets: list[int], raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of tokens without the tokens at their edges that split a character; what is empty then goes."""
    splits = lambda k: offsets[k] < len(raw) and raw[offsets[k]] & 0xC0 == 0x80
    out = []
    for start, end in spans:
        while start < end and splits(start):
            start += 1
        while end > start and splits(end):
            end -= 1
        if end > start:
            out.append((start, end))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        elif end > start:
            out.append((start, end))
    return out


class Source:
    """A text, its tokens and where they begin in its bytes."""

    def __init__(self, text: str, path: str):
        self.coder, self.raw = encoding(path), text.encode()
        self.ids = self.coder.encode_ordinary(text)
        self.offsets = [0]
        for token in self.coder.decode_tokens_bytes(self.ids):
            self.offsets.append(self.offsets[-1] + len(token))

    def count(self, text: str) -> int:
        return len(self.coder.encode_ordinary(text))

    def render(self, spans: list[tuple[int, int]]) -> str:
        return "\n".join(self.raw[self.offsets[a] : self.offsets[b]].decode() for a, b in spans)

    def grid(self, size: int, overlap: int) -> list[tuple[int, int]]:
        last = max(0, -(-(len(self.ids) - size) // (size - overlap)))
        return [(k * (size - overlap), min(k * (size - overlap) + size, len(self.ids))) for k in range(last + 1)] if self.ids else []

    def union(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return trimmed(self.offsets, self.raw, merged(spans))

    def pack(self, ranked: list[tuple[int, int]], budget: int) -> tuple[int, list[tuple[int, int]], str]:
        """How many of the ranked spans fit as a strict prefix, their union, and its text, which is counted anew.

        A candidate fits if its tokens and a joiner between spans do, or else if its text does; joins may merge or split
        tokens, so what was taken is given back from the end until the text fits.
        """
        kept: list[tuple[int, int]] = []
        for span in ranked:
            spans = self.union([*kept, span])
            if sum(b - a for a, b in spans) + max(0, len(spans) - 1) > budget and self.count(self.render(spans)) > budget:
                break
            kept.append(span)
        while kept and self.count(self.render(self.union(kept))) > budget:
            kept.pop()
        spans = self.union(kept)
        return len(kept), spans, self.render(spans)


def pack_by_tokens(rows: DataFrame, path: str, budget: int, size: int = 64, overlap: int = 16, id_col: str = "doc_id", text_col: str = "text", words_col: str = "query") -> DataFrame:
    """``doc_id, n_chunks, kept_chunks, selected_tokens, spans, filtered_text``: chunks of each text's tokens, ranked by the words of
    its question that they hold (ties by order), packed under a budget of tokens."""

    def run(batches):
        for pdf in batches:
            out = []
            for key, text, query in zip(pdf[id_col], pdf[text_col], pdf[words_col], strict=True):
                source = Source(text or "", path)
                wanted, grid = set((query or "").lower().split()), source.grid(size, overlap)
                held = [len(wanted & set(source.raw[source.offsets[a] : source.offsets[b]].decode("utf-8", "ignore").lower().split())) for a, b in grid]
                ranked = [grid[k] for k in sorted(range(len(grid)), key=lambda k: (-held[k], k))]
                kept, spans, packed = source.pack(ranked, budget)
                out.append((key, len(grid), kept, source.count(packed), [{"s": a, "e": b} for a, b in spans], packed))
            yield pd.DataFrame(out, columns=[id_col, "n_chunks", "kept_chunks", "selected_tokens", "spans", "filtered_text"])

    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_chunks int, kept_chunks int, selected_tokens int, spans array<struct<s:int,e:int>>, filtered_text string"
    return rows.select(id_col, text_col, words_col).mapInPandas(run, schema)


def clip(path: str, budget: int) -> Callable[[Column], Column]:
    """A column function: a text's first ``budget`` tokens, cut further while decoding and encoding again gives more of them."""

    @F.pandas_udf("string")
    def clipped(texts: pd.Series) -> pd.Series:
        coder = encoding(path)

        def one(text: str) -> str:
            ids = coder.encode_ordinary(text)
            n = budget
            while len(ids) > budget:
                out = coder.decode(ids[:n], errors="ignore")
                if (over := len(coder.encode_ordinary(out)) - budget) <= 0:
                    return out
                n -= over
            return text

        return texts.map(lambda t: one(t) if t else t)

    return clipped
