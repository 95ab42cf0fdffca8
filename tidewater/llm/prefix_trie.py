"""The trie of all conversation prefixes, merged family by family.

Conversations of a family share the first turns of its base conversation. A family's rows come together (base first), each as
a digest and a word count and not as a text. One pass rebuilds its conversations and builds the family's small trie, with
counts, leaves and savings of each subtree. Only these combined nodes are shuffled for the global trie: a node's key is a
128-bit digest of its path, so equal prefixes of different families meet by key.

A node that only one family has keeps the family's values, as all below it is that family's too. Nodes of several families form the
top of the trie; what is below each is summed by doubling: round k adds the sums of nodes 2^k below, whose keys the family
pass has put beside each node. So a chain of d shared nodes takes log d rounds and no list of pairs, and a node with very many
children is a partial sum in each task.

No task holds a family: beyond ``most`` nodes the trie of a family is given out and another begun, and the nodes on the way to
the turn it stopped at count as shared. A path in memory takes 16 bytes a turn. Ids that end at a node of several families are
sorted over all tasks and packed before a node's packs are hashed in order.

Defined cases: turns are ordered by number (null first), then role, then a digest of the text; null role or text is empty. Rows
without a conversation id are left out, as they can't be rebuilt. A base without rows lends no turns, and a conversation all of
whose turns are replaced by none ends at the root. Repeated rows are turns of their own. An empty table gives no rows. Further columns are
not read, whatever their names. Texts of any length are digested in the scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import give_back, materialise, sized

#: Ids of a family, the most turns that a base lends and one more, and the nodes of a family's trie that a task holds.
FAMILY, HEADS, MOST_NODES = 20, 4, 200_000

#: Words of a text, and ids in a pack.
WORD, PACK_IDS = r"[^\x20\x09-\x0D]+", 50_000

KEY_BYTES = 16
ROOT = bytes(KEY_BYTES)

NODES = "key binary, parent binary, depth long, words long, up array<binary>, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends array<long>, open boolean"
NODE_SCHEMA = pa.schema(
    [("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("up", pa.list_(pa.binary()))]
    + [(n, pa.int64()) for n in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")]
    + [("ends", pa.list_(pa.int64())), ("open", pa.bool_())]
)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``base, conv_id, heads, turn, role, digest, words``: a narrow row per turn, whatever its text."""
    role, text, c = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("conv_id")
    rows = conversations.where(c.isNotNull()).select(c.cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"))
    told = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    digest = F.substring(F.unhex(F.sha2(told.cast("binary"), 256)), 1, KEY_BYTES)
    heads = (F.crc32(c.cast("string").cast("binary")) % HEADS).cast("int")
    return rows.select((c - c % FAMILY).alias("base"), "conv_id", heads.alias("heads"), "turn", "role", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


class Trie:
    """The nodes of one family, or of a stretch of it."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows: list[list] = []  # key, parent, depth, words, up, least id, index of the parent, members, children, ends, open

    def visit(self, key: bytes, path: Path, words: int, conv: int) -> None:
        """A member passes the node at the end of ``path``."""
        if (i := self.at.get(key)) is None:
            i = self.at[key] = len(self.rows)
            parent = path.key(path.depth - 1) if path.depth else None
            up, j = [], 1
            while j <= path.depth:
                up.append(path.key(path.depth - j))
                j *= 2
            above = self.at.get(parent, -1) if parent is not None else -1
            self.rows.append([key, parent, path.depth, words, up, conv, above, 0, 0, None, False])
            if above >= 0:
                self.rows[above][8] += 1
        row = self.rows[i]
        row[5] = min(row[5], conv)
        row[7] += 1

    def end(self, key: bytes, conv: int) -> None:
        row = self.rows[self.at[key]]
        row[9] = [*(row[9] or ()), conv]

    def keep_open(self, path: Path) -> None:
        """The conversation goes on in another trie, so the nodes on its way are not this one's alone."""
        for d in range(path.depth, -1, -1):
            if (i := self.at.get(path.key(d))) is None or self.rows[i][10]:
                break
            self.rows[i][10] = True

    def batch(self) -> pa.RecordBatch:
        leaves, saved = [0] * len(self.rows), [0] * len(self.rows)
        for i in range(len(self.rows) - 1, -1, -1):  # children come after their parent
            row = self.rows[i]
            leaves[i] += not row[8]
            saved[i] += (row[7] - 1) * row[3]
            if row[6] >= 0:
                leaves[row[6]] += leaves[i]
                saved[row[6]] += saved[i]
        out = [
            (r[0], r[1], r[2], r[3], r[4], r[5], self.rows[r[6]][5] if r[6] >= 0 else None, r[7], r[8], leaves[i], saved[i], sorted(r[9]) if r[9] else None, r[10])
            for i, r in enumerate(self.rows)
        ]
        columns = zip(*out, strict=True) if out else [()] * len(NODE_SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE_SCHEMA, strict=True)], schema=NODE_SCHEMA)


class Path:
    """The keys of the prefixes of the conversation at hand."""

    def __init__(self) -> None:
        self.keys = bytearray(ROOT)
        self.depth = 0

    def key(self, depth: int) -> bytes:
        return bytes(self.keys[depth * KEY_BYTES : (depth + 1) * KEY_BYTES])

    def step(self, digest: bytes) -> bytes:
        key = hashlib.blake2b(self.key(self.depth) + digest, digest_size=KEY_BYTES).digest()
        self.keys += key
        self.depth += 1
        return key


def family_tries(turns: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """The nodes of each family's trie, from the rows of :func:`turn_rows`. A family's rows come to one task as a sorted stream."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ready, held = Trie(), [], 0
        family = conv = lent = path = None
        skip = 0

        def close() -> None:
            if conv is not None:
                trie.end(path.key(path.depth), conv)

        def flush() -> None:
            nonlocal held
            if trie.rows:
                ready.append(trie.batch())
                held += len(trie.rows)
                trie.clear()

        def extend(digest: bytes, words: int) -> None:
            if len(trie.rows) >= most:
                trie.keep_open(path)
                flush()
            key = path.step(digest)
            trie.visit(key, path, words, conv)

        for batch in batches:
            for base, c, heads, digest, words in zip(*(batch.column(n).to_pylist() for n in ("base", "conv_id", "heads", "digest", "words")), strict=True):
                if (base, c) != (family, conv):
                    close()
                    if base != family:
                        flush()
                        family, lent = base, []
                    conv, path = c, Path()
                    trie.visit(ROOT, path, 0, c)
                    skip = heads if c != base else 0
                    for turn in lent[:skip]:  # the base itself comes first
                        extend(*turn)
                if c == base and len(lent) < HEADS - 1:
                    lent.append((digest, words))
                if skip:
                    skip -= 1
                else:
                    extend(digest, words)
            if held + len(trie.rows) > MOST_NODES // 4:
                yield from ready
                ready.clear()
                held = 0
        close()
        flush()
        yield from ready
        give_back()

    order = ("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    return turns.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "heads", "digest", "words").mapInArrow(run, NODES)


def merge_families(families: DataFrame) -> DataFrame:
    """One row per node of the global trie; ``tries`` is the number of family tries that have it, ``shared`` whether it isn't one's alone."""
    first = [F.first(c).alias(c) for c in ("parent", "depth", "words", "up", "parent_conv_id", "n_children", "n_leaves", "saved")]
    ends = [F.count("ends").alias("n_ends"), F.first("ends", ignorenulls=True).alias("ends")]
    merged = families.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *first, *ends, (F.count(F.lit(1)) > 1).alias("several"), F.max("open").alias("open"))
    return merged.withColumn("shared", F.col("several") | F.col("open")).drop("several", "open")


def subtree_sums(shared: DataFrame) -> DataFrame:
    """``key, n_leaves, saved`` of every node and all nodes below it, by doubling over ``key, depth, up, n_leaves, saved``."""
    deepest = shared.agg(F.max("depth")).head()[0] or 0
    sums, k = shared.select("key", "depth", "up", "n_leaves", "saved"), 0
    while 2**k <= deepest:
        below = sums.where(F.col("depth") >= 2**k).groupBy(F.col("up")[k].alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        more = [(F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c) for c, d in (("n_leaves", "l"), ("saved", "s"))]
        sums = materialise(sums.join(below, "key", "left").select("key", "depth", "up", *more), "sums")
        k += 1
    return sums.select("key", "n_leaves", "saved")


def end_digests(ends: DataFrame, pack_ids: int = PACK_IDS) -> DataFrame:
    """``key, ends_sha256`` of ids (key, conv_id), numerically ascending and joined by commas.

    Ids are sorted over all tasks, so a node's ids may lie in many; each gives packs of ids, and a node's packs are hashed in order.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [key], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))

        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= pack_ids):
                    yield row()
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield row()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]}, pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))

        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        yield row()
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
        if key is not None:
            yield row()

    packs = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pack, "key binary, first long, ids string")
    return packs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


def joined_ids(ids: Column) -> Column:
    return F.sha2(F.array_join(F.coalesce(ids, F.array().cast("array<long>")).cast("array<string>"), ",").cast("binary"), 256)


def prefix_trie(conversations: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node, with its ``key`` and its parent's."""
    families = materialise(family_tries(turn_rows(conversations), most), "families")
    merged = materialise(merge_families(families), "merged")
    shared = merged.where("shared")
    top = materialise(shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("top_conv_id")), "top")
    # children of shared nodes: shared ones count alone, others with all that is below them
    below = materialise(merged.join(sized(top), "parent"), "below")
    own = F.when(F.col("shared"), 0)
    sums = below.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.sum(own.otherwise(F.col("n_leaves"))).alias("l"), F.sum(own.otherwise(F.col("saved"))).alias("s"))
    saved = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("s", F.lit(0))
    start = shared.drop("n_children", "n_leaves", "saved").join(sums.withColumnRenamed("parent", "key"), "key", "left")
    start = start.select("key", "depth", "up", F.coalesce("n", F.lit(0)).alias("n_children"), F.coalesce("l", F.lit(1)).alias("n_leaves"), saved.alias("saved"))
    start = materialise(start, "start")
    totals = subtree_sums(start).join(start.select("key", "n_children"), "key")
    repeated = materialise(merged.where("n_ends > 1").select("key"), "repeated")
    ids = families.where("ends IS NOT NULL").select("key", F.col("ends")).join(sized(repeated), "key", "left_semi").select("key", F.explode("ends").alias("conv_id"))
    digests = materialise(end_digests(ids), "ends")

    named = ["key", "parent", "conv_id", "depth", "n_convs"]
    once = F.when(F.col("n_ends") < 2, joined_ids(F.col("ends"))).alias("once")
    private = merged.where("NOT shared").join(sized(top), "parent", "left")
    private = private.select(*named, F.coalesce("top_conv_id", "parent_conv_id").alias("parent_conv_id"), "n_children", "n_leaves", "saved", once)
    over = below.where("shared").select("key", F.col("top_conv_id").alias("parent_conv_id"))
    tops = shared.select(*named, once).join(over, "key", "left").join(totals, "key")
    nodes = private.unionByName(tops).join(sized(digests), "key", "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", "once").alias("ends_sha256"), "key", "parent"
    )
