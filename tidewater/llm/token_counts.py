"""Token counts by a finite-state tokenizer.

The tokenizer is compiled into deterministic transducers whose transitions carry the number of tokens they emit:

* The byte transducer reads one pre-token, byte by byte. Its state holds the places from which a longer token could still reach
  the next byte: for each the bytes since, the token before it, and how many tokens fewer or more were emitted there. Of the
  tokens that end at the next byte exactly one is compatible with the token before it, so a step is deterministic and emits
  a fixed count, which can be 0 or less where a longer token takes the place of shorter ones. States and transitions are
  compiled into a table when first met, within a bound, and serve a worker from task to task.
* The text transducer's symbols are runs between synchronising positions, where a split is certain whatever came
  before: after a character that is no white space, before white space. Its transitions are compiled when first needed
  and kept in two generations, within a bound, from task to task until the worker runs another operator.

Every text is cut into chunks. A chunk's state map says what the chunk does from any entry state: the head up to its
first synchronising position depends on the entry state and is kept, the rest is a constant count and a tail. State
maps compose associatively, and a prefix scan over the chunks gives the count before each chunk and in all.

Defined cases: a null text counts as empty and has 0 tokens; rows are independent, so repeated rows repeat; every input
column but the two that are named is ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.bpe import FRAGMENT, WHITE_SPACE, json_ranks, split
from tidewater.llm.shared import give_back, materialise, sliced

CHUNK_CHARS = 1 << 12
#: Transitions of the text transducer kept by a worker, of symbols up to KEEP_CHARS, in each of two generations.
KEEP_TRANSITIONS, KEEP_CHARS = 400_000, 64
#: States of the byte transducer's table, before it is begun anew, and pairs of tokens that are kept. With the transitions above a worker
#: keeps an estimated 450 MB at most (551,000 transitions, 269,000 states and 292,000 pairs took 371 MB).
KEEP_STATES, KEEP_PAIRS = 300_000, 300_000
#: Characters in which the last synchronising position of a chunk is looked for before the whole chunk is.
NEAR_END = 64

SYNC = re.compile(f"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]")


#: A rank that no merge has.
NEVER = 1 << 60
#: A place of a state: the bytes since, the token before them, and the count there less the count now.
Place = tuple[bytes, bytes, int]


class ByteTransducer:
    """Counts the tokens of one pre-token by a table of states and transitions, which grows as bytes call for it."""

    def __init__(self, vocab: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]):
        self.vocab, self.merges = vocab, merges
        self.open = {since: since for token in vocab for k in range(1, len(token)) if (since := token[:k])}  # what a longer token begins with
        self.compatible: dict[tuple[bytes, bytes], bool] = {}
        self.states: list[tuple[Place, ...]] = []
        self.number: dict[tuple[Place, ...], int] = {}
        self.places: dict[Place, Place] = {}  # states share them
        self.table: list[dict[int, tuple[int, int]]] = []  # of each state, by byte: the next state and the emitted count
        self.reset()

    def reset(self) -> None:
        for kept in (self.states, self.number, self.places, self.table):
            kept.clear()
        self.add(((b"", b"", 0),))

    def add(self, state: tuple[Place, ...]) -> int:
        """The number of a new state."""
        state = tuple([self.places.setdefault(place, place) for place in state])
        number = self.number[state] = len(self.states)
        self.states.append(state)
        self.table.append({})
        return number

    def merge(self, word: bytes) -> list[bytes]:
        """The tokens of a short string: the lowest-ranked neighbours merge first."""
        parts, rank = [word[i : i + 1] for i in range(len(word))], self.merges.get
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NEVER)
        return parts

    def pair(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a, b may stand side by side: encoding a+b gives just them."""
        if (found := self.compatible.get((a, b))) is None:
            if len(self.compatible) >= KEEP_PAIRS:
                self.compatible.clear()
            found = self.compatible[a, b] = self.merge(a + b) == [a, b]
        return found

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state by a byte, put into the table."""
        last = bytes((byte,))
        grown = [(since + last, before, count) for since, before, count in self.states[state]]
        for token, before, count in grown:  # the longest first
            if token in self.vocab and (not before or self.pair(before, token)):
                break
        else:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        emitted = count + 1
        after = (*((self.open[since], before, count - emitted) for since, before, count in grown if since in self.open), (b"", token, 0))
        if (number := self.number.get(after)) is None:
            if len(self.states) >= KEEP_STATES:  # the table is begun anew, within a long word too; the state that was left is gone
                self.reset()
                return self.add(after), emitted
            number = self.add(after)
        self.table[state][byte] = (number, emitted)
        return number, emitted

    def count(self, word: bytes) -> int:
        table, state, total = self.table, 0, 0
        for byte in word:
            state, emitted = table[state].get(byte) or self.compile(state, byte)
            total += emitted
        return total


class Transitions(dict):
    """Symbol to emitted count; compiled when first needed. A full generation becomes the older one, from which what is met again comes back."""

    def __init__(self, compile_symbol: Callable[[str], int]):
        super().__init__()
        self.compile_symbol = compile_symbol
        self.older: dict[str, int] = {}

    def __missing__(self, symbol: str) -> int:
        return self.find(symbol, self.compile_symbol)

    def find(self, symbol: str, compile_symbol: Callable[[str], int]) -> int:
        """The count of a symbol that this generation lacks."""
        if (n := self.older.get(symbol)) is None:
            n = compile_symbol(symbol)
        if len(symbol) <= KEEP_CHARS:
            if len(self) >= KEEP_TRANSITIONS:
                self.older = self.copy()
                self.clear()
            self[symbol] = n
        return n


@dataclass(frozen=True)
class StateMap:
    """What a chunk does from any entry state. Without a synchronising position all of it is head and tail is None."""

    head: str
    tokens: int = 0
    tail: str | None = None


class CountingTokenizer:
    def __init__(self, path: str):
        vocab, merges, special = json_ranks(path)
        self.bytes = ByteTransducer(vocab, merges)
        self.runs = Transitions(self._run)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _run(self, text: str) -> int:
        """Of text between synchronising positions; special strings are a token each, as the library has it by default."""
        if self.special and (parts := self.special.split(text))[1:]:
            return len(parts) // 2 + sum(map(self._run, filter(None, parts[::2])))
        pieces = split(text)
        return sum(map(self._piece, pieces)) if len(pieces) > 1 else self._word(text)

    def _piece(self, text: str) -> int:
        """A piece by itself splits into just itself, so pieces and runs are kept together."""
        return self.runs.find(text, self._word) if (n := self.runs.get(text)) is None else n

    def _word(self, text: str) -> int:
        return self.bytes.count(text.encode())

    def emit(self, text: str) -> int:
        return sum(map(self.runs.__getitem__, FRAGMENT.findall(text)))

    def state_map(self, chunk: str) -> StateMap:
        if (found := SYNC.search(chunk)) is None:
            return StateMap(chunk)
        first = found.start()
        for start in (max(first, len(chunk) - NEAR_END), first):
            if (last := max((m.start() for m in SYNC.finditer(chunk, start)), default=-1)) >= 0:
                break
        return StateMap(chunk[:first], self.emit(chunk[first:last]), chunk[last:])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of a's chunk followed by b's. A boundary at the seam itself is found when the joined text is emitted."""
        if a.tail is None:
            return StateMap(a.head + b.head, b.tokens, b.tail)
        if b.tail is None:
            return StateMap(a.head, a.tokens, a.tail + b.head)
        return StateMap(a.head, a.tokens + self.emit(a.tail + b.head) + b.tokens, b.tail)

    def total(self, m: StateMap) -> int:
        return self.emit(m.head) + m.tokens + (self.emit(m.tail) if m.tail is not None else 0)

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        if len(text) <= chunk_chars:
            return self.emit(text)
        return self.total(prefix_scan([self.state_map(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)], self.compose)[-1])


def prefix_scan(maps: list[StateMap], compose: Callable[[StateMap, StateMap], StateMap]) -> list[StateMap]:
    """Inclusive prefixes of an associative composition by recursive pairing: work linear, depth logarithmic."""
    if len(maps) < 2:
        return list(maps)
    pairs = prefix_scan([compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)], compose)
    return [maps[0] if i == 0 else pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], maps[i]) for i in range(len(maps))]


@functools.cache
def tokenizer(path: str) -> CountingTokenizer:
    return CountingTokenizer(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row, for a byte-level BPE vocabulary file (.json) that every executor has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokenizer(vocabulary)
        for batch in sliced(batches, "t"):
            counts = [counter.count(x) if x else 0 for x in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        give_back("counts", tokenizer.cache_clear)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return materialise(rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit), "counts")
