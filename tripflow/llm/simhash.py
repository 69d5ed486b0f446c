"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are sorted by their rank in the binary-reflected Gray code, where neighbours differ in few bits,
and cut into nodes of consecutive ranks.  A node keeps the bits on which all its fingerprints agree (a mask and
a pattern); nodes are grouped again and again, each upper node keeping the pattern its children share.  A search
walks downwards, adds up the differences from the patterns met so far and leaves a whole group as soon as the
sum passes the radius, so that no link is lost.

Two tiers.  The upper tier has at most ``NODES`` bottom nodes whatever the input (a bounded table of masks and
patterns, the only thing that the driver sees); each distinct fingerprint goes to the nodes that it can't rule
out.  The lower tier is built where a node's fingerprints meet, and searched by the stream of those sent there.
Equal fingerprints are one entry, so large groups of exact copies cost nothing; within a node, linked
fingerprints are merged before links leave the task, so dense groups send one link each instead of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import as_docs, connected_components, shuffle_partitions, text_bytes

NODES = 1024        # most bottom nodes of the upper tier
NODE_LEAST = 64     # fewer fingerprints than this aren't worth a node
FAN = 8             # children of an upper node
LEAF = 16           # fingerprints of a leaf of the lower tier
SEED = 42


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 of every run of ``size`` words (fewer words: the whole sequence; none: nothing)."""
    words = text_bytes(text).lower().split()  # bytes.lower() touches A-Z only
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return [h(line[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    if not hashes:
        return 0
    h = np.array(hashes, np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(h[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def simhashes(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every row as a signed long."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_hashes(t, size)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())],
                                             names=["doc_id", "fp"])
    return as_docs(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Rank of a fingerprint in the Gray code, as a long whose signed order is the rank's unsigned order."""
    r = fp
    for s in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, s))
    return r.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _ranks(fp: np.ndarray) -> np.ndarray:
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class Tree:
    """Upper nodes over consecutive bottom nodes, given the AND and the OR of each bottom node's fingerprints."""

    def __init__(self, all_and: np.ndarray, all_or: np.ndarray):
        levels = [(all_and, all_or)]
        while len(levels[-1][0]) > FAN:
            a, o = levels[-1]
            cuts = np.arange(0, len(a), FAN)
            levels.append((np.bitwise_and.reduceat(a, cuts), np.bitwise_or.reduceat(o, cuts)))
        # from the top: mask of the bits first settled at this level, and the pattern
        self.levels, above = [], None
        for a, o in reversed(levels):
            mask = ~(a ^ o)
            self.levels.append((mask if above is None else mask & ~np.repeat(above, FAN)[:len(mask)], a))
            above = mask

    def search(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into q, bottom node) of all nodes that can hold a fingerprint within the radius."""
        mask, pattern = self.levels[0]
        qi = np.repeat(np.arange(len(q)), len(mask))
        node = np.tile(np.arange(len(mask)), len(q))
        spent = np.zeros(len(qi), np.int16)
        for k, (mask, pattern) in enumerate(self.levels):
            if k:
                width = np.minimum(FAN, len(mask) - node * FAN)
                qi, spent, base = np.repeat(qi, width), np.repeat(spent, width), np.repeat(node * FAN, width)
                node = base + np.arange(len(base)) - np.repeat(np.cumsum(width) - width, width)
            spent = spent + np.bitwise_count((q[qi] ^ pattern[node]) & mask[node])
            near = spent <= radius
            qi, node, spent = qi[near], node[near], spent[near]
        return qi, node


class Node:
    """The lower tier of one node: its fingerprints in Gray order, in leaves under a tree of their own."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(_ranks(fps), kind="stable")]
        cuts = np.arange(0, len(self.fps), LEAF)
        self.tree = Tree(np.bitwise_and.reduceat(self.fps, cuts), np.bitwise_or.reduceat(self.fps, cuts))
        self.root = np.arange(len(self.fps))

    def pairs(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into q, place of a fingerprint) of all links."""
        qi, leaf = self.tree.search(q, radius)
        width = np.minimum(LEAF, len(self.fps) - leaf * LEAF)
        qi, base = np.repeat(qi, width), np.repeat(leaf * LEAF, width)
        at = base + np.arange(len(base)) - np.repeat(np.cumsum(width) - width, width)
        near = np.bitwise_count(q[qi] ^ self.fps[at]) <= radius
        return qi[near], at[near]

    def merge(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge the node's own links; returns one link from each merged fingerprint to its group's root."""
        root = self.root.tolist()

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x
        for at in range(0, len(self.fps), 2048):
            a, b = self.pairs(self.fps[at:at + 2048], radius)
            a = a + at
            for x, y in zip(a[a < b].tolist(), b[a < b].tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        self.root = np.array([find(x) for x in range(len(root))])
        moved = np.flatnonzero(self.root != np.arange(len(root)))
        return self.fps[moved], self.fps[self.root[moved]]

    def links(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """One link from each fingerprint of q to each merged group that it is linked to."""
        qi, at = self.pairs(q, radius)
        if not len(qi):
            return q[:0], q[:0]
        both = np.unique(np.stack([qi, self.root[at]]), axis=1)
        return q[both[0]], self.fps[both[1]]


def _edges(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (src, dst)], names=["src", "dst"])


def links_within(fps: DataFrame, radius: int) -> DataFrame:
    """(src, dst): links that join exactly the groups of distinct fingerprints ``fp`` within ``radius`` bits."""
    spark = fps.sparkSession
    n, cuts = fps.select(gray_rank(F.col("fp")).alias("r")).agg(
        F.count("*"), F.percentile_approx("r", [i / NODES for i in range(1, NODES)], 20_000)).first()
    nodes = 1 << max(0, min(NODES, n // NODE_LEAST).bit_length() - 1)
    cuts = np.unique(np.array((cuts or [])[NODES // nodes - 1::NODES // nodes], np.int64))

    def number(fp: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, (_ranks(fp) ^ np.uint64(1 << 63)).view(np.int64), side="right")

    def numbered(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(number(fp).astype(np.int32)), b.column(0)], names=["node", "fp"])

    # At most NODES rows of masks and patterns, whatever the number of fingerprints.
    upper = (fps.select("fp").mapInArrow(numbered, "node int, fp long").groupBy("node")
             .agg(F.bit_and("fp").alias("a"), F.bit_or("fp").alias("o")).orderBy("node").collect())
    ids = np.array([r["node"] for r in upper], np.int32)
    all_and, all_or = (np.array([r[c] for r in upper], np.int64).view(np.uint64) for c in ("a", "o"))

    def routed(batches):
        tree = Tree(all_and, all_or)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                fp = b.column(0).slice(at, 1000).to_numpy().view(np.uint64)
                own = number(fp).astype(np.int32)
                qi, node = tree.search(fp, radius)
                node = ids[node]
                later = node > own[qi]  # the links to earlier nodes are found from there
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[own, node[later]]), pa.array(np.r_[np.zeros(len(own), np.int8), np.ones(later.sum(), np.int8)]),
                     pa.array(np.r_[fp, fp[qi[later]]].view(np.int64))], names=["node", "kind", "fp"])

    def searched(batches):
        current, members, node = None, [], None
        for b in batches:
            ids_, kind, fp = (b.column(c).to_numpy() for c in range(3))
            change = np.flatnonzero((ids_[1:] != ids_[:-1]) | (kind[1:] != kind[:-1])) + 1
            for part in np.split(np.arange(len(ids_)), change):
                if not len(part):
                    continue
                own, is_query, values = ids_[part[0]], kind[part[0]], fp[part].view(np.uint64)
                if own != current:
                    if members:
                        yield _edges(*Node(np.concatenate(members)).merge(radius))
                    current, members, node = own, [], None
                if not is_query:
                    members.append(values)
                    continue
                if node is None:
                    node = Node(np.concatenate(members))
                    members = []
                    yield _edges(*node.merge(radius))
                for at in range(0, len(values), 2048):
                    src, dst = node.links(values[at:at + 2048], radius)
                    if len(src):
                        yield _edges(src, dst)
        if members:
            yield _edges(*Node(np.concatenate(members)).merge(radius))

    return (fps.select("fp").mapInArrow(routed, "node int, kind byte, fp long")
            .repartition(shuffle_partitions(spark), "node").sortWithinPartitions("node", "kind", "fp")
            .mapInArrow(searched, "src long, dst long"))


def groups(fps: DataFrame, radius: int, least: Column) -> DataFrame:
    """(fp, root, low): each distinct fingerprint's group, and ``least`` of the fingerprint's rows."""
    distinct = fps.groupBy("fp").agg(least.alias("low")).checkpoint()
    roots = connected_components(links_within(distinct, radius))
    return (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("root", "fp").alias("root"), "low"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Texts link if their fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id that
    links lead to, the row's own included.  Texts without words have fingerprint zero and link like any others;
    a null text has no words; a null id stays null and never names a component unless all its ids are null (then
    component_id is null); repeated rows link to each other; an empty table gives an empty result; other columns
    are not read.
    """
    fps = simhashes(docs, size, id_col, text_col).checkpoint()
    rooted = groups(fps, radius, F.min("doc_id"))
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the least (doc_id, text hash), a null id first.

    Of rows equal in both, any one stays; rows and columns are otherwise as they were.
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                      F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("k1"),
                      F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("k2"),
                      F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_hashes(t, size)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())],
                                             names=["k1", "k2", "fp"])

    fps = own.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, fp long").checkpoint()
    first = F.min(F.struct("k1", "k2"))
    chosen = (groups(fps, radius, first).groupBy("root").agg(F.min("low").alias("low")).select("low.k1", "low.k2"))
    return (own.select("row", "k1", "k2").join(chosen, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*"))
