"""Jaccard self-join of word-shingle sets by PartEnum signatures, and the components of its links.

``part_enum`` signs a set so that two similar ones share a signature at least; ``needed`` says how many a set shares with any
similar one. Equal sets are one node, named by a 64-bit digest of the set, so that copies fall together wherever
signatures meet. Signatures of many texts go through the shuffle as packed arrays, dealt by ranges of signatures; a signature that
repeats within such an array is sent once, with its smallest node, and the other nodes of that run are passed on beside it. So a
signature that a third of all texts have costs a row an array, and no task gathers its members.

A node that shares fewer signatures than needed has no partner and is left out. Candidate pairs are then (a node, the smallest
node of a run) and, once what these link is known, all pairs of unlike components in runs of up to ``SHORT``. Pairs are rejected by
parity sketches, whose distance is never more than that of the sets, and verified on the shingles.
What is left are nodes whose shared signatures in longer runs with other components are still as many as needed. From these,
nodes are struck off, round by round, that share less than the needed part of their shingles with other components
among them; the rest is compared within its families (nodes connected by their rarest shingles), block against block.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer than ``n`` words has its word sequence as
one shingle; null texts and texts without words have the empty set and no partner; a null id gives a row of its own that links
with nothing; rows that repeat an id are taken as copies if their sets are equal; an empty table gives an empty result; other
columns are ignored. Shingles are equal if their 64-bit hashes are. Sets whose digests collide are told apart by a second one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.part_enum import SIMILAR, bands_of, signatures
from tidewater.llm.shared import MAX_BROADCAST_ROWS, give_back, materialise, sized, sliced
from tidewater.llm.shingle_sets import mixed, shingle_sets, sums

#: Words of a shingle; members of a short run; rounds of striking off; shingles in a block of the last comparison.
WORDS, SHORT, ROUNDS, BLOCK_SHINGLES = 5, 12, 4, 400_000
#: Signatures, and texts, of one packed array in a task; signatures of a range.
PACK_SIGNATURES, PACK_TEXTS, RANGE_SIGNATURES = 400_000, 60_000, 1_000_000
#: Digests that may be known to collide (of n sets about n * n / 2 ** 65 do).
MAX_COLLISIONS = 100_000


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))


def digests(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    a, b = (mixed(sums(mixed(flat, salt), offsets) + np.diff(offsets).astype(np.uint64), salt) for salt in (11, 13))
    return a.astype(np.int64), b.astype(np.int64)


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, n_shingles, a, b``: size and digests of each row's set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t"):
            flat, offsets = shingle_sets(batch.column("t").to_pylist(), n)
            a, b = digests(flat, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(a), pa.array(b)], names=["doc_id", "n_shingles", "a", "b"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, a long, b long")


def node_of(collided: list[int]) -> Column:
    return F.when(F.col("a").isin(collided), F.col("b")).otherwise(F.col("a")) if collided else F.col("a")


def nodes_of(flat: np.ndarray, offsets: np.ndarray, collided: list[int]) -> np.ndarray:
    a, b = digests(flat, offsets)
    return np.where(np.isin(a, collided), b, a) if collided else a


def pack(sigs: np.ndarray, at: np.ndarray, nodes: np.ndarray, ranges: int) -> Iterator[tuple]:
    """Rows (range, kind, signatures, nodes, places) of the signatures ``sigs`` that the texts ``at`` of ``nodes`` have.

    Kind 0 holds the low halves of the signatures of a range and the smallest node of each, as places in a list of nodes where that
    is shorter. Kind 1 holds the runs within these texts, whole signatures and nodes, for any task.
    """
    key = (sigs >> np.uint64(32)) % np.uint64(ranges) << np.uint64(32) | sigs & np.uint64(0xFFFFFFFF)
    order = np.argsort(key)
    key, at = key[order], at[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    starts = np.flatnonzero(new)
    counts = np.diff(np.concatenate((starts, [len(key)])))
    rank = np.empty(len(nodes), np.int64)  # place in the order of nodes; equal nodes have one place
    distinct, rank = np.unique(nodes, return_inverse=True)
    at = rank[at]
    least = np.minimum.reduceat(at, starts)
    most = np.maximum.reduceat(at, starts)
    run = np.repeat(least < most, counts)
    if run.any():
        yield int(key[0] % np.uint64(ranges)), 1, key[run].tobytes(), distinct[at[run]].tobytes(), b""
    key = key[starts]
    cuts = np.flatnonzero(np.diff(key >> np.uint64(32))) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
        low, own = key[lo:hi].astype(np.uint32).tobytes(), least[lo:hi]
        seen = np.zeros(len(distinct), bool)
        seen[own] = True
        listed = np.flatnonzero(seen)
        if len(listed) <= 1 << 16 and 8 * len(listed) < 6 * len(own):
            yield int(key[lo] >> np.uint64(32)), 0, low, distinct[listed].tobytes(), (np.cumsum(seen) - 1)[own].astype(np.uint16).tobytes()
        else:
            yield int(key[lo] >> np.uint64(32)), 0, low, distinct[own].tobytes(), b""


def packed_signatures(docs: DataFrame, n: int, ranges: int, collided: list[int]) -> DataFrame:
    """The signatures of all rows as packed rows (see ``pack``); rows of kind 2 hold nodes and their ``needed``."""
    names = ["range", "kind", "sigs", "nodes", "places"]
    schema = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("sigs", pa.binary()), ("nodes", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        signed = texts = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            sigs, at, nodes, needed = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = list(pack(sigs, at, nodes, ranges)) if len(sigs) else []
            rows.append((int(nodes[0] % ranges) if len(nodes) else 0, 2, b"", nodes.tobytes(), needed.astype(np.int32).tobytes()))
            for k in range(0, len(rows), 32):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + 32]], schema)

        for batch in sliced(batches, "t"):
            flat, offsets = shingle_sets(batch.column("t").to_pylist(), n)
            sigs, whose, needed = signatures(flat, offsets)
            real = np.flatnonzero(needed < np.iinfo(np.int64).max)
            place = np.zeros(len(needed), np.int64)
            place[real] = np.arange(len(real)) + texts
            held.append((sigs, place[whose], nodes_of(flat, offsets, collided)[real], needed[real]))
            signed, texts = signed + len(sigs), texts + len(real)
            if signed >= PACK_SIGNATURES or texts >= PACK_TEXTS:
                yield from flushed()
                held, signed, texts = [], 0, 0
        if held:
            yield from flushed()
            held = []
        give_back()

    return docs.mapInArrow(run, "range int, kind int, sigs binary, nodes binary, places binary")


def shared_signatures(packed: DataFrame) -> DataFrame:
    """``sig, node`` of the signatures that two or more nodes have (a row can repeat), and ``node, needed`` of every node."""

    def table(sig, node, needed) -> pa.RecordBatch:
        nothing = pa.nulls(len(node), pa.int64() if sig is None else pa.int32())
        columns = [nothing, pa.array(node), pa.array(needed)] if sig is None else [pa.array(sig), pa.array(node), nothing]
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("needed", pa.int32())]))

    def repeated(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), bool)
        out[1:] = values[1:] == values[:-1]
        out[:-1] |= values[1:] == values[:-1]
        return out

    def shared(which: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        low, node = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(low)
        low, node = low[order], node[order]
        keep = repeated(low)
        low, node = low[keep], node[keep]
        order = np.lexsort((node, low))
        low, node = low[order], node[order]
        once = np.ones(len(low), bool)
        once[1:] = (low[1:] != low[:-1]) | (node[1:] != node[:-1])
        low, node = low[once], node[once]
        keep = repeated(low)
        return table((np.int64(which) << np.int64(32)) + low[keep].astype(np.int64), node[keep], None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, held = None, []
        for batch in batches:
            for here, kind, sigs, nodes, places in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                node = np.frombuffer(nodes, np.int64)
                if kind == 2:
                    yield table(None, node, np.frombuffer(places, np.int32))
                elif kind == 1:
                    yield table(np.frombuffer(sigs, np.int64), node, None)
                else:
                    if here != which and held:
                        yield shared(which, held)
                        held = []
                    which = here
                    held.append((np.frombuffer(sigs, np.uint32), node[np.frombuffer(places, np.uint16)] if places else node))
        if held:
            yield shared(which, held)

    return packed.repartition("range").sortWithinPartitions("range").mapInArrow(run, "sig long, node long, needed int")


def full_sets(docs: DataFrame, n: int, collided: list[int]) -> DataFrame:
    """``node, s, sketch`` of rows (node, t) whose text is that node's: the set as bytes, and the parity of its members by hash.

    A sketch has two to four bits a shingle, a power of two; the longer of two is folded before they are compared.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t"):
            flat, offsets = shingle_sets(batch.column("t").to_pylist(), n)
            wanted = batch.column("node").to_numpy()
            keep = nodes_of(flat, offsets, collided) == wanted
            sets, sketches = [], []
            for k in np.flatnonzero(keep).tolist():
                s = flat[offsets[k] : offsets[k + 1]]
                bits = 64 << max(0, int(bands_of(np.array([len(s)]))[0]) - 5)
                sets.append(s.tobytes())
                sketches.append(np.packbits(np.bincount((mixed(s, 0x51) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(wanted[keep]), pa.array(sets, pa.binary()), pa.array(sketches, pa.binary())], names=["node", "s", "sketch"])

    return docs.mapInArrow(run, "node long, s binary, sketch binary")


def most_apart(total: int) -> int:
    """Members in which two similar sets, of so many members together, differ at most."""
    return total * (SIMILAR[1] - SIMILAR[0]) // (SIMILAR[1] + SIMILAR[0])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``a, b``, the pairs whose sets are similar."""
    num, den = SIMILAR

    def alike(test) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "xa"):
                each = zip(*(batch.column(c).to_pylist() for c in ("xa", "xb", "na", "nb")), strict=True)
                keep = pa.array([den * min(m, n) >= num * max(m, n) and test(x, y, m + n) for x, y, m, n in each], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

        return run

    def near(x: bytes, y: bytes, total: int) -> bool:
        x, y = sorted((np.frombuffer(v, np.uint64) for v in (x, y)), key=len)
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        return int(np.bitwise_count(x ^ y).sum()) <= most_apart(total)

    def similar(x: bytes, y: bytes, total: int) -> bool:
        both = np.sort(np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))), kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return den * common >= num * (total - common)

    def joined(pairs: DataFrame, column: str) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(x), F.col(column).alias(f"x{x}"), (F.octet_length("s") / 8).cast("int").alias(f"n{x}")), x)
        return pairs.select("a", "b", "xa", "xb", "na", "nb")

    close = materialise(joined(pairs, "sketch").mapInArrow(alike(near), "a long, b long"), "close")
    return joined(close, "s").mapInArrow(alike(similar), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, c`` for the nodes of ``links`` (a, b): the smallest node of each component, by least labels and pointer jumping."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))
    both = materialise(links.select(F.inline(ends)).distinct(), "edges")  # each node its own neighbour, so that labels only fall and an equal sum is a fixed point
    label = materialise(both.groupBy("a").agg(F.min("b").alias("c")), "labels")
    total = None
    while True:
        now = label.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        if now == total or now is None:
            return label.select(F.col("a").alias("node"), "c")
        total = now
        near = both.join(sized(label.select(F.col("a").alias("b"), "c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        near = materialise(near, "near")
        label = near.join(sized(label.select(F.col("a").alias("c"), F.col("c").alias("up"))), "c").select("a", F.least("c", "up").alias("c"))
        label = materialise(label, "labels")


def labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(sized(comp), "node", "left").withColumn("c", F.coalesce("c", "node"))


def open_runs(rows: DataFrame) -> DataFrame:
    """Of rows (sig, node, c), those of signatures with more than one component, with the run's size ``n`` and smallest node."""
    runs = rows.groupBy("sig").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.min("c").alias("low"), F.max("c").alias("high"))
    runs = materialise(runs.where("low < high").select("sig", "n", "first"), "runs")
    return materialise(rows.join(sized(runs), "sig").select("sig", "node", "c", "n", "first"), "open")


def members(active: DataFrame, sets: DataFrame) -> DataFrame:
    """``h, node, c`` of every shingle of ``active`` (node, c)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "s"):
            each = [np.frombuffer(s, np.int64) for s in batch.column("s").to_pylist()]
            sizes = [len(s) for s in each]
            if each:
                columns = [np.concatenate(each), *(np.repeat(batch.column(k).to_numpy(), sizes) for k in ("node", "c"))]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["h", "node", "c"])

    return active.join(sets.select("node", "s"), "node").mapInArrow(run, "h long, node long, c long")


def strike(active: DataFrame, sets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Of ``active`` (node, c), without nodes that share too few shingles with nodes of other components among ``active``."""
    num, den = SIMILAR
    for _ in range(rounds):
        before = active.count()
        rows = materialise(members(active, sets), "members")
        foreign = rows.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("h")
        sizes = sets.select("node", (F.octet_length("s") / 8).cast("int").alias("size"))
        counts = rows.join(foreign, "h").groupBy("node", "c").count().join(sizes, "node").where(F.col("count") * den >= F.col("size") * num)
        active = materialise(counts.select("node", "c").distinct(), "active")
        if active.count() > 0.9 * before:
            break
    return active


def prefixes(active: DataFrame, sets: DataFrame) -> DataFrame:
    """``h, node`` of ``active`` (node, c): the rarest shingles of each node, two similar ones of which have one in common.

    Shingles are in one order: first those that one component alone has, then by rising count. Of two similar sets the first that they
    share stands among the first quarter, and one more, of each. Shingles whose nodes are of one component are left out.
    """
    num, den = SIMILAR
    rows = materialise(members(active, sets), "members")
    held = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("h", "n")
    size = sets.join(sized(active.select("node")), "node", "left_semi").select("node", (F.octet_length("s") / 8).cast("int").alias("size"))
    each = rows.join(held, "h").groupBy("node", "c").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("hs")).join(size, "node")
    most = F.size("hs") + 1 - F.ceil(F.col("size") * num / den).cast("int")  # of the whole prefix, what is not a component's own
    first = each.where(most > 0).select("node", "c", F.explode(F.slice("hs", 1, most)).alias("x")).select("x.h", "node", "c")
    first = materialise(first, "prefixes")
    several = first.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("h")
    return first.join(several, "h", "left_semi").select("h", "node")


def family_pairs(active: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between unlike components among ``active`` (node, c), within families, block against block.

    A family is connected by shingles of ``prefixes``. Of the links that two blocks find, as many are given as join their components: fewer
    than there are nodes, whatever the number of similar pairs.
    """
    num, den = SIMILAR
    rare = materialise(prefixes(active, sets), "rare")
    firsts = rare.groupBy("h").agg(F.min("node").alias("a"))
    edges = rare.join(firsts, "h").where("a < node").select("a", F.col("node").alias("b")).distinct()
    family = components(edges).select("node", F.col("c").alias("family"))
    rows = materialise(active.join(family, "node").join(sets.select("node", "s"), "node"), "family", "uncompressed")
    blocks = rows.groupBy("family").agg(F.ceil(F.sum(F.octet_length("s")) / (8 * BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(blocks) if active.count() <= MAX_BROADCAST_ROWS else blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    keys = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("lo"), F.greatest(k, F.col("block")).alias("hi")))
    rows = rows.select("family", "node", "c", "s", "block", F.explode(keys).alias("key")).select("family", "key.lo", "key.hi", "block", "node", "c", "s")

    def run(table: pa.Table) -> pa.Table:
        x, y = (table.filter(pc.equal(table["block"], table[k])) for k in ("lo", "hi"))
        out: list[tuple[int, int]] = []
        if x.num_rows and y.num_rows:
            lists = [np.frombuffer(s, np.uint64) for s in y["s"].to_pylist()]
            sizes, nodes, comps = np.array([len(s) for s in lists]), y["node"].to_numpy(), y["c"].to_numpy()
            member, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
            order = np.argsort(member, kind="stable")
            member, owner = member[order], owner[order]
            place = np.unique(np.concatenate((x["c"].to_numpy(), comps)), return_inverse=True)[1]
            joined = np.arange(len(place))  # of each component, the one that it is joined to
            of_x, of_y = place[: x.num_rows], place[x.num_rows :]
            for s, node, c in zip(x["s"].to_pylist(), x["node"].to_pylist(), of_x.tolist(), strict=True):
                s = np.frombuffer(s, np.uint64)
                low, high = np.searchsorted(member, s, "left"), np.searchsorted(member, s, "right")
                reach = high - low
                found = np.repeat(low - np.concatenate(([0], np.cumsum(reach)[:-1])), reach) + np.arange(reach.sum())
                both = np.bincount(owner[found], minlength=len(lists))
                hit = np.flatnonzero((den * both >= num * (len(s) + sizes - both)) & (joined[of_y] != joined[c]))
                other, at = np.unique(joined[of_y[hit]], return_index=True)
                for g, j in zip(other.tolist(), hit[at].tolist(), strict=True):
                    out.append((node, int(nodes[j])))
                    joined[joined == g] = joined[c]
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return rows.groupBy("family", "lo", "hi").applyInArrow(run, "a long, b long")


def collisions(sets: DataFrame) -> list[int]:
    """Digests that unlike sets share."""
    differ = (F.min("b") < F.max("b")) | (F.min("n_shingles") < F.max("n_shingles"))
    found = [r.a for r in sets.groupBy("a").agg(differ.alias("differ")).where("differ").select("a").limit(MAX_COLLISIONS + 1).collect()]
    if len(found) > MAX_COLLISIONS:
        raise ValueError(f"more than {MAX_COLLISIONS} digests of sets collide")
    return found


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: its set's size and the smallest id that its links reach, itself included."""
    spark = docs.sparkSession
    texts = text_rows(docs, id_col, text_col)
    sets = materialise(set_table(texts, n), "sets")
    collided = collisions(sets)
    sets = sets.withColumn("node", node_of(collided))
    real = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")

    total = real.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_SIGNATURES + 1)
    texts = texts.where("doc_id IS NOT NULL")
    found = materialise(shared_signatures(packed_signatures(texts, n, ranges, collided)), "shared")
    comp = link(found, texts, real, n, collided, max_broadcast)

    rows = sets.join(sized(comp, max_broadcast), "node", "left") if comp is not None else sets.withColumn("c", F.lit(None).cast("long"))
    rows = materialise(rows.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("c", "node")).alias("label")), "labelled")
    groups = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("label", "least")
    groups = materialise(groups, "groups")
    return rows.join(sized(groups, max_broadcast), "label", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def link(found: DataFrame, texts: DataFrame, real: DataFrame, n: int, collided: list[int], max_broadcast: int) -> DataFrame | None:
    """``node, c`` of the nodes that have a similar one; None if there is none."""
    shared = found.where("sig IS NOT NULL").select("sig", "node")
    needed = found.where("sig IS NULL").groupBy("node").agg(F.min("needed").alias("needed"))
    loose = materialise(needed.where("needed = 0").select("node"), "loose")
    enough = shared.groupBy("node").agg(F.count("*").alias("k")).join(needed, "node").where("k >= needed")
    viable = materialise(enough.select("node", "needed"), "viable")
    rows = materialise(open_runs(shared.join(sized(viable, max_broadcast), "node", "left_semi").withColumn("c", F.col("node"))).drop("c"), "rows")

    wanted = rows.select("node").distinct().unionByName(loose).distinct()
    wanted = materialise(real.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "wanted")
    if wanted.isEmpty():
        return None
    sets = materialise(full_sets(texts.join(sized(wanted, max_broadcast), "doc_id").select("node", "t"), n, collided), "candidates", "uncompressed")
    if sets.count() > wanted.count():  # rows that repeat an id
        sets = materialise(sets.dropDuplicates(["node"]), "candidates", "uncompressed")

    links = materialise(verify(materialise(rows.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs"), sets), "links")
    comp = components(links)
    rest = open_runs(labelled(rows.select("sig", "node"), comp))
    short = rest.where(f"n <= {SHORT}").select("sig", "node", "c")
    other = short.select("sig", F.col("node").alias("b"), F.col("c").alias("d"))
    pairs = materialise(short.join(other, "sig").where("node < b AND c <> d").select(F.col("node").alias("a"), "b").distinct(), "pairs")
    new = materialise(verify(pairs, sets), "links")
    if not new.isEmpty():
        links = links.unionByName(new)
        comp = components(links)

    long = rest.where(f"n > {SHORT}").select("sig", "node")
    long = open_runs(labelled(long, comp))
    hidden = long.groupBy("node").agg(F.count("*").alias("k")).join(sized(viable, max_broadcast), "node").where("k >= needed").select("node")
    active = materialise(labelled(hidden.unionByName(loose).distinct(), comp), "active")
    active = strike(active, sets) if not active.isEmpty() else active
    if not active.isEmpty():
        new = materialise(family_pairs(active, sets), "links")
        comp = comp if new.isEmpty() else components(links.unionByName(new))
    return comp
