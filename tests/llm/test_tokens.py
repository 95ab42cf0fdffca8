import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm.bpe import late_letters, plain_split, split, tiktoken_ranks
from tidewater.llm.bpe_codec import Codec, decode_documents, encode_documents
from tidewater.llm.token_counts import CountingTokenizer, StateMap, count_tokens, prefix_scan

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LIBRARY, COUNTER, CODEC = Tokenizer.from_file(JSON), CountingTokenizer(JSON), Codec(RANKS)
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tiktoken_ranks(RANKS), special_tokens={})
HARD = ["", "\U0003d000'm x\U000323b5y 1\u088f2", "\u1c89'm \ua7cb", " ", "  ", "a  b", "it's   we'll 'S 're", "x\n\n  y\t\tz ", "<|endoftext|>", "a <|endoftext|>  <|endoftext|> b<|endof", "naïve 東京 😀👍🏽 Ⅷ ²x 12345", "\x1c\x1d a\x1cb", "a b　c d", "\x00\x01", "a" * 500, "ab" * 300 + " " * 50, "!?!?!?!?" * 40, "A\r\n\r\nB", "́e"]
text = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'stremdlv019.,ab"))), max_size=80)


@pytest.mark.parametrize("x", HARD)
def test_hard_texts(x):
    assert COUNTER.count(x) == len(LIBRARY.encode(x, add_special_tokens=False).ids)
    assert CODEC.encode(x).tolist() == OWN.encode_ordinary(x)


@settings(max_examples=300, deadline=None)
@given(text, st.integers(1, 40))
def test_chunked_counts_and_round_trip(x, chunk):
    want = len(LIBRARY.encode(x, add_special_tokens=False).ids)
    assert COUNTER.count(x) == COUNTER.count(x, chunk) == want
    ids = CODEC.encode(x)
    assert ids.tolist() == OWN.encode_ordinary(x)
    assert CODEC.decode(ids.tolist()) == x.encode()


def test_the_table_counts_as_merges_do():
    """Transitions emit counts; a longer token that takes the place of shorter ones emits less than one."""
    counter = COUNTER.bytes
    rng = random.Random(3)
    for _ in range(3000):
        word = bytes(rng.choice(b"\xf0\xbd\x80\xe2\x99'!aetionrs. ") for _ in range(rng.randint(1, 12)))
        assert counter.count(word) == len(counter.merge(word))
    assert len(counter.states) > 100 and min(n for row in counter.table for _, n in row.values()) < 1
    small = CountingTokenizer(JSON).bytes
    assert small.count(b"international") == small.count(b"international") and len(small.states) <= 14


def test_ordinary_texts_go_through_chunk_maps_and_the_tree(monkeypatch):
    calls = {"compose": 0, "join": 0}

    def counted(cls, name):
        real = getattr(cls, name)

        def call(self, *args):
            calls[name] += 1
            return real(self, *args)

        monkeypatch.setattr(cls, name, call)

    counted(CountingTokenizer, "compose")
    counted(Codec, "join")
    x = " ".join("".join(random.Random(k).choices("aeinrst", k=7)) for k in range(700))
    assert CountingTokenizer(JSON).count(x) == len(LIBRARY.encode(x, add_special_tokens=False).ids) and calls["compose"]
    assert Codec(RANKS).encode(x).tolist() == OWN.encode_ordinary(x) and calls["join"] > 700


def test_generations_of_kept_fragments_change_nothing(monkeypatch):
    from tidewater.llm import bpe_codec

    monkeypatch.setattr(bpe_codec, "KEEP_FRAGMENTS", 5)
    monkeypatch.setattr(bpe_codec, "KEEP_WINDOWS", 3)
    coder, rng = Codec(RANKS), random.Random(4)
    words = [" quixotic", " zymurgy", "aardwolf", "\n  x", "it's", " don't,", " 東京", " b" * 3, "!'s", " " * 4, "syzygy" * 20]
    for _ in range(200):
        x = "".join(rng.choices(words, k=12))
        assert coder.encode(x).tolist() == OWN.encode_ordinary(x)
        assert len(coder.kept) <= 5 and len(coder.older) <= 5


def test_joins_of_new_words_merge_hardly_any_bytes(monkeypatch):
    """op7_bpe_codec: a window wider than two tokens was merged from its bytes, nearly once for each new word."""
    from tidewater.llm import bpe_codec

    merged, real = [], bpe_codec.merge
    monkeypatch.setattr(bpe_codec, "merge", lambda data, *tables: merged.append(data) or real(data, *tables))
    coder, rng = Codec(RANKS), random.Random(8)
    words = ["".join(rng.choices(("tion", "ing", "whe", "ou", "ché", "ble", "sta", "re"), k=5)) for _ in range(3000)]
    for word in words:
        assert coder.encode(" " + word).tolist() == OWN.encode_ordinary(" " + word)
        if word is words[1999]:
            merged.clear()
    assert len(merged) < 300  # before: 676


@pytest.mark.parametrize("steps", [0, 1, 2])
def test_joins_that_take_too_many_steps_change_nothing(monkeypatch, steps):
    from tidewater.llm import bpe_codec

    monkeypatch.setattr(bpe_codec, "STEPS", steps)
    coder, rng = Codec(RANKS), random.Random(9)
    parts = [t for t in (r.decode(errors="replace") for r in tiktoken_ranks(RANKS)) if t.isalpha()]
    for _ in range(400):
        x = rng.choice(("".join(rng.choices(parts, k=9)), "".join(rng.choices("etaoin", k=60)), rng.choice(parts) * 20))
        assert coder.encode(x).tolist() == OWN.encode_ordinary(x)
    assert coder.windows


@pytest.mark.parametrize("around", ["{}", " {}", "a{}b", " a{}'s", "1{}2", "!{}?", "\n{}\n ", "  {}  "])
def test_the_plain_split_is_the_split(around):
    characters = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    late = late_letters()
    for k in range(0, len(characters), 256):  # one late letter sends a whole text another way
        x = "\n".join(around.format(c) for c in characters[k : k + 256])
        assert plain_split(x) == split(x)
    assert late and all(plain_split(around.format(c)) == split(around.format(c)) for c in late)


@settings(max_examples=300, deadline=None)
@given(text)
def test_the_plain_split_of_any_text(x):
    assert plain_split(x) == split(x)


def test_a_full_table_of_counts_keeps_what_is_met_again(monkeypatch):
    """a full table was cleared, so words met before went through the byte transducer again."""
    from tidewater.llm import token_counts

    monkeypatch.setattr(token_counts, "KEEP_TRANSITIONS", 8)
    counter, words, seen = CountingTokenizer(JSON), [" quixotic", " zymurgy", " aardwolf", "\n  x", " it's", " don't,", " 東京", "!'s"], []
    real = counter.bytes.count
    monkeypatch.setattr(counter.bytes, "count", lambda w: seen.append(w) or real(w))
    rng = random.Random(5)
    for k in range(40):
        x = f" quixotic zymurgy new{'x' * k}"
        assert counter.count(x) == len(LIBRARY.encode(x, add_special_tokens=False).ids)
    assert seen.count(b" quixotic") == seen.count(b" zymurgy") == 1
    for _ in range(200):
        x = "".join(rng.choices([*words, " b" * 3, "<|endoftext|>", " " * 4, "syzygy" * 20], k=12))
        assert counter.count(x) == counter.count(x, 7) == len(LIBRARY.encode(x, add_special_tokens=False).ids)
        assert len(counter.runs) <= 8 and len(counter.runs.older) <= 8


def test_a_full_table_of_states_begins_anew(monkeypatch):
    from tidewater.llm import token_counts

    monkeypatch.setattr(token_counts, "KEEP_STATES", 20)
    monkeypatch.setattr(token_counts, "KEEP_PAIRS", 5)
    counter, rng = CountingTokenizer(JSON).bytes, random.Random(6)
    for _ in range(500):
        word = bytes(rng.choice(b"aetionrs. \xc3\xa9") for _ in range(rng.choice((1, 2, 5, 9, 400))))
        assert counter.count(word) == len(counter.merge(word))
        assert len(counter.states) == len(counter.table) <= 20 and {p for state in counter.states for p in state} == set(counter.places)


def test_the_last_split_of_a_chunk():
    for chunk in ("ab cd", "a" * 300 + " " + "b" * 200, "a b" + "c" * 63, "a b" + "c" * 64, " a", "a ", "ab", "", "a  b \n c" + " " * 90, "é\u3000東"):
        splits = [i for i in range(1, len(chunk)) if chunk[i].isspace() and not chunk[i - 1].isspace()]
        got = COUNTER.state_map(chunk)
        assert (got.head, got.tail) == ((chunk[: splits[0]], chunk[splits[-1] :]) if splits else (chunk, None))


def test_workers_keep_their_tables_from_task_to_task(spark):
    """every task of a worker began with empty tables."""
    docs = spark.createDataFrame([(k, f"uncommon words number {k}") for k in range(64)], "doc_id long, text string").repartition(8)

    def states():
        def probe(batches):
            from tidewater.llm.token_counts import tokenizer

            for batch in batches:
                most = len(tokenizer(JSON).bytes.states) if tokenizer.cache_info().currsize else 0
                yield pa.RecordBatch.from_arrays([pa.array([most] * batch.num_rows, pa.int64())], names=["n"])

        return max(r.n for r in spark.range(64).repartition(8).mapInArrow(probe, "n long").collect())

    count_tokens(docs, JSON).collect()
    assert states() > 1


def test_another_operator_lets_go_of_the_counter(monkeypatch):
    from tidewater.llm import shared
    from tidewater.llm.token_counts import tokenizer

    monkeypatch.setattr(shared, "KEPT", {})
    kept = tokenizer(JSON)
    shared.give_back("counts", tokenizer.cache_clear)
    assert tokenizer(JSON) is kept
    shared.give_back()
    assert tokenizer.cache_info().currsize == 0


def test_long_pieces():
    rng = random.Random(1)
    for x in ("".join(rng.choices("abcdeéß", k=5000)), "z" * 20_000, "".join(rng.choices("etaoin", k=3000))):
        assert CODEC.encode(x).tolist() == OWN.encode_ordinary(x)
    assert COUNTER.count("tion" * 2000) == len(LIBRARY.encode("tion" * 2000, add_special_tokens=False).ids)


def test_scan_is_the_fold():
    maps = [COUNTER.state_map(x) for x in ("ab c", "d", " e f", "gh", "", "i j k")]
    folded, want = StateMap(""), []
    for m in maps:
        folded = COUNTER.compose(folded, m)
        want.append(COUNTER.total(folded))
    assert [COUNTER.total(m) for m in prefix_scan(maps, COUNTER.compose)] == want


def test_queries_over_nulls_and_repeats(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "hello  world", 3), (3, "hello  world", 4), (3, "hello  world", 4), (4, "word " * 30_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, count_tokens(docs, JSON).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(LIBRARY.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    coded = decode_documents(encode_documents(docs, RANKS), RANKS).collect()
    assert sorted(encode_documents(docs, RANKS, decode=True).collect(), key=str) == sorted(coded, key=str)
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in coded) == sorted((i or 0, (t or "").encode()) for i, t, _ in rows)
    assert all(list(r.ids) == OWN.encode_ordinary(bytes(r.decoded).decode()) for r in coded)
    assert count_tokens(docs.limit(0), JSON).count() == decode_documents(encode_documents(docs.limit(0), RANKS), RANKS).count() == 0


def test_registered_queries_match_the_libraries(spark):
    from tidewater.llm.queries import op2_token_counts, op7_bpe_codec, table

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in op2_token_counts(spark, sf).collect():
        assert r.n_tokens == len(LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids)
    for r in op7_bpe_codec(spark, sf).collect():
        ids = OWN.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
