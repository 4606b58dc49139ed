"""SimHash near-duplicates linked through BK-trees.

A document's fingerprint has a bit for each of 64 places: set if more than half of the hashes of its word shingles
have it. Documents link where fingerprints differ in at most ``RADIUS`` bits.

Texts are read once; afterwards only ids and fingerprints move. Distinct fingerprints are dealt to shards so that
any two within the radius meet in at least one: the 64 bits are cut into ``BLOCKS`` blocks, and a shard is a
choice of ``BLOCKS - RADIUS`` of them together with their values. Two fingerprints with at most ``RADIUS``
differing bits have so many blocks in common. Each shard is a BK-tree: children are keyed by their integer Hamming
distance to the parent, and a search of radius r below a node at distance d follows only the edges from d - r to
d + r. All trees of a partition are built and searched together, level by level, in arrays. A subtree whose
nodes are already known to be in the searching fingerprint's own component is not entered: it could add no new
connection. Hence a shard of n fingerprints yields fewer than n links.

A shard with more than ``SHARD`` fingerprints, found by a count beforehand, is cut into parts by hash, and every
pair of parts becomes a tree of its own, so that no task holds more than two parts of one shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.components import components
from fieldledger.llm.registry import doc_query, table
from fieldledger.llm.rows import map_rows, shared_table, ship_package, text_column
from fieldledger.operators.joins import is_small

WORDS, BITS, RADIUS, BLOCKS, SEED = 4, 64, 4, 6, 42
SHARD = 8192
#: Shingles whose bits are added up at a time, fingerprints treated at a time, pairs compared at a time.
SHINGLE_BLOCK, FOREST, FRONTIER = 1 << 15, 1 << 17, 1 << 20


def shingles(text: str, words: int = WORDS) -> list[bytes]:
    """Shingles of the white-space-separated words, ASCII capitals made small, repeats included."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return [b" ".join(p) for p in zip(*(w[i:] for i in range(words)), strict=False)]


def fingerprint(text: str, words: int = WORDS) -> int:
    found = shingles(text, words)
    sums = np.zeros(BITS, np.int64)
    for at in range(0, len(found), SHINGLE_BLOCK):
        part = found[at : at + SHINGLE_BLOCK]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in part], np.uint64)
        sums += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > len(found)).tobytes(), "big") if found else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit integer; zero for a text without words."""

    def make():
        def run(ids, texts):
            for i, t in zip(ids, texts, strict=True):
                f = fingerprint(t, words)
                yield i, f - (f >> 63 << 64)

        return run

    return map_rows(docs, [F.col(doc_id).cast("long"), text_column(text)], "doc_id bigint, fp bigint", make)


def block_masks(blocks: int = BLOCKS) -> list[int]:
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def shard_keys(radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """Keys of all shards of a fingerprint: number of the choice and the bits it keeps, as (choice, bits)."""
    masks = block_masks(blocks)
    chosen = [sum(c) for c in combinations(masks, blocks - radius)]
    signed = [m - (m >> 63 << 64) for m in chosen]
    return F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """BK-trees of several groups of distinct fingerprints; rows of a group stand together."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.root = first[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
        self.levels = [first]
        rest = np.flatnonzero(self.root != np.arange(n))
        at = self.root[rest]
        while len(rest):
            # all that wait at a node go to its child of their distance; the first to come becomes that child
            d = distance(fp[rest], fp[at]).astype(np.int64)
            key = at * (BITS + 1) + d
            order = np.argsort(key, kind="stable")
            key, rest, at, d = key[order], rest[order], at[order], d[order]
            new = np.r_[True, key[1:] != key[:-1]]
            child = rest[new][np.cumsum(new) - 1]
            made = rest[new]
            self.parent[made], self.edge[made] = at[new], d[new]
            self.levels.append(made)
            rest, at = rest[~new], child[~new]
        # children of a node side by side
        self.by_parent = np.flatnonzero(self.parent >= 0)
        self.by_parent = self.by_parent[np.argsort(self.parent[self.by_parent], kind="stable")]
        sorted_parents = self.parent[self.by_parent]
        self.begin = np.searchsorted(sorted_parents, np.arange(n), "left")
        self.end = np.searchsorted(sorted_parents, np.arange(n), "right")

    def spans(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest label in the subtree of each node."""
        low, high = label.copy(), label.copy()
        for made in reversed(self.levels[1:]):
            np.minimum.at(low, self.parent[made], low[made])
            np.maximum.at(high, self.parent[made], high[made])
        return low, high

    def links(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect what the pairs within the radius connect."""
        near = np.flatnonzero((self.parent >= 0) & (self.edge <= radius))
        label = joined(np.arange(len(self.fp)), near, self.parent[near])
        low, high = self.spans(label)
        many = np.flatnonzero(low[self.root] != high[self.root])
        for at in range(0, len(many), FRONTIER >> 6):
            q = many[at : at + (FRONTIER >> 6)]
            label = joined(label, *self.search(q, radius, label, low, high))
        node = np.flatnonzero(label != np.arange(len(label)))
        return node, label[node]

    def search(self, query: np.ndarray, radius: int, label, low, high) -> tuple[np.ndarray, np.ndarray]:
        found_q, found_n = [], []
        stack = [(query, self.root[query])]
        while stack:
            q, n = stack.pop()
            if len(q) > FRONTIER:  # a wide front is followed half by half
                half = len(q) // 2
                stack += [(q[:half], n[:half]), (q[half:], n[half:])]
                continue
            # nothing new can be below a node whose subtree is all of the query's component
            open_ = (low[n] != label[q]) | (high[n] != label[q])
            q, n = q[open_], n[open_]
            if not len(q):
                continue
            d = distance(self.fp[q], self.fp[n]).astype(np.int64)
            hit = (d <= radius) & (label[q] != label[n])
            found_q.append(q[hit])
            found_n.append(n[hit])
            count = self.end[n] - self.begin[n]
            child = self.by_parent[np.repeat(self.begin[n], count) + ranges(count)]
            q, d = np.repeat(q, count), np.repeat(d, count)
            follow = np.abs(self.edge[child] - d) <= radius
            if follow.any():
                stack.append((q[follow], child[follow]))
        if not found_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_n)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for every c, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the given links: each node's is the least position in its component."""
    label = label.copy()
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:  # follow labels to their own labels
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def forest_links(radius: int):
    """Links of partitions sorted by shard; shards are taken whole, so many at a time as fit ``FOREST`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def solve(cols):
            group, fp, node = cols
            a, b = Forest(group, fp.view(np.uint64)).links(radius)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        def take(last: bool):
            nonlocal waiting, rows
            cols = tuple(np.concatenate(c) for c in zip(*waiting, strict=True))
            group = cols[0]
            cut = len(group) if last else int(np.searchsorted(group, group[-1], "left"))
            waiting = [tuple(c[cut:] for c in cols)]
            rows = len(group) - cut
            return tuple(c[:cut] for c in cols)

        count = 0
        previous = None
        for batch in batches:
            shard = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-2]]
            change = np.zeros(batch.num_rows, bool)
            for i, c in enumerate(shard):
                change[1:] |= c[1:] != c[:-1]
                change[0] |= previous is None or c[0] != previous[i]
            previous = [c[-1] for c in shard]
            group = count + np.cumsum(change)
            count = int(group[-1])
            waiting.append((group, batch.column("fp").to_numpy(), batch.column("node").to_numpy()))
            rows += batch.num_rows
            if rows >= FOREST:
                cols = take(False)
                if len(cols[0]):
                    yield solve(cols)
        if rows:
            yield solve(take(True))

    return run


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """Links ``a, b`` between the nodes of distinct fingerprints (``node, fp``) that connect all pairs within the radius."""
    ship_package(nodes.sparkSession)
    keyed = nodes.select("node", "fp", F.explode(shard_keys(radius, blocks)).alias("k")).select("node", "fp", "k.choice", "k.bits")
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard)
    # only shards of more than ``shard`` rows, which are few: their rows are counted in units of that many
    large = sizes.select("choice", "bits", F.ceil(F.col("n") / shard).cast("int").alias("parts"))
    dealt = keyed.join(large, ["choice", "bits"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pair = lambda i: F.struct(F.least(own, i).alias("p"), F.greatest(own, i).alias("q"))
    parts = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair)
    )
    dealt = dealt.withColumn("pq", F.explode(parts)).select("choice", "bits", "pq.p", "pq.q", "fp", "node")
    shard_columns = ["choice", "bits", "p", "q"]
    sorted_ = dealt.repartition(*shard_columns).sortWithinPartitions(*shard_columns, "fp")
    return sorted_.mapInArrow(forest_links(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; the component is the smallest id reachable over links.

    A null or empty text has fingerprint zero and is linked like any other. Rows that share an id are one
    document with several fingerprints' rows, all kept. A row with a null id has a null component and links
    nothing. An empty table gives an empty result.
    """
    known = shared_table(fingerprints(docs, doc_id, text, words))
    # a fingerprint is named by the smallest id that has it; equal fingerprints need no link
    nodes = known.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    same_id = known.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("f"), F.max("fp").alias("g")).filter("f != g")
    nodes = shared_table(nodes)
    links = fingerprint_links(nodes, radius, blocks)
    # an id with several texts holds their fingerprints together
    shared = known.join(same_id.select("doc_id"), "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    roots = components(links.unionByName(shared))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    rest = known.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    return known.filter("doc_id is not null").join(named, "fp").select("doc_id", "fp", "component_id").unionByName(rest)


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row, with all its columns, of each group of rows whose fingerprints are connected by links.

    The row with the smallest id stays; rows without an id come after all others. Of rows that agree in id and text the one
    with the smallest hash of all columns stays. Rows that share an id but not a group are different documents, and stay.
    Null and empty texts have fingerprint zero and form a group.

    Only ids, hashes and fingerprints are shuffled. Texts move only in the last join, and not there either as long as
    the rows that go are few enough for a broadcast.
    """

    def make():
        def run(ids, texts, hashes):
            for i, t, h in zip(ids, texts, hashes, strict=True):
                f = fingerprint(t, words)
                yield i, f - (f >> 63 << 64), h

        return run

    mark = F.xxhash64(text_column(text))
    named_id = F.col(doc_id).cast("long")
    known = shared_table(map_rows(docs, [named_id, text_column(text), mark], "id bigint, fp bigint, mark bigint", make))
    nodes = shared_table(known.select("fp").distinct().withColumn("node", F.col("fp")))
    roots = components(fingerprint_links(nodes, radius, blocks))
    groups = shared_table(nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root")))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")).alias("first")
    winners = known.join(groups, "fp").groupBy("root").agg(first).select("first.id", "first.mark")
    winners = shared_table(winners)
    classes = shared_table(known.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")))
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))
    later = shared_table(classes.alias("c").join(winners.alias("w"), same("c", "w"), "left_anti").select("id", "mark"))
    repeated = classes.filter("n > 1").alias("c").join(winners.alias("w"), same("c", "w"), "left_semi").select("id", "mark")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), named_id.alias("id"), mark.alias("mark"))
    kept = rows.alias("r").join(small_side(later).alias("l"), same("r", "l"), "left_anti")
    if not repeated.isEmpty():
        # at most one row of each class and task leaves the task
        repeated = small_side(shared_table(repeated))
        single = kept.alias("k").join(repeated.alias("s"), same("k", "s"), "left_anti").select("row")
        one = F.min_by("row", F.xxhash64("row")).alias("row")
        of_many = kept.alias("k").join(repeated.alias("s"), same("k", "s"), "left_semi").groupBy("id", "mark").agg(one).select("row")
        kept = single.unionByName(of_many)
    return kept.select("row.*")


def small_side(df: DataFrame) -> DataFrame:
    """Marked for a broadcast if its summed size allows."""
    return F.broadcast(df) if is_small(df) else df


@doc_query("op10_simhash_bktree")
def op10(spark, directory):
    found = near_duplicates(table(spark, directory, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
