"""Benchmark decontamination: SimHash windows of an item's size, multi-index Hamming blocks, exact verification.

A document is read once for every part of the benchmark (one, unless the benchmark is large).  A window of as many words as an item can only be similar to the item if they share a
shingle, so windows are laid wherever the document has a shingle of some item of that size.  Each window gets a
64-bit SimHash over its shingles (differences of running bit counts, so a window costs 64 additions whatever its
length).  The items' fingerprints are indexed by their size and ``BLOCKS`` blocks of 8 bits: two fingerprints within
``RADIUS`` bits agree in some block up to RADIUS // BLOCKS bits, so looking every block up in a table of the window's size
that already holds these neighbours finds all items of the size within the radius.  Candidates are verified by the weighted Jaccard similarity of
the shingles, their weights being their multiplicities.

The benchmark is broadcast in parts whose text is at most about ``ITEM_BYTES``; the documents are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import WordHash, as_docs, batches_to, gram_hashes

WORD = re.compile(r"[^\W_]+")
SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, RADIUS = 8, 23          # some block of two fingerprints within 23 bits differs in at most 2
ITEM_BYTES = 4 << 20            # benchmark text of a part; as an index it takes some forty times as much
RUN_WORDS = 1 << 16             # words of a text whose bits are summed at a time
FILTER_BITS = 22


def words_of(text: str | None) -> list[str]:
    """Words without case and punctuation."""
    return WORD.findall(text.lower()) if text else []


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE words; of fewer words the whole sequence is one shingle."""
    return gram_hashes(h, min(SHINGLE, len(h))) if len(h) else h


def bit_sums(g: np.ndarray) -> np.ndarray:
    """Running sums, from 0, of the bits of the hashes."""
    bits = np.unpackbits(g.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def simhash_windows(sums: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows of n shingles from each start."""
    ones = sums[start + n] - sums[start]
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


@dataclass
class Items:
    """A part of the benchmark: sizes, shingle multisets, fingerprints and the block tables of each size."""

    ids: list[int | None]
    words: list[int]
    shingles: list[Counter]

    def __post_init__(self):
        n = len(self.ids)
        self.size = np.array(self.words, np.int64)
        self.fp = np.zeros(n, np.uint64)
        owners: dict[int, list[int]] = {}
        for i, s in enumerate(self.shingles):
            g = np.array(list(s.elements()), np.uint64)
            self.fp[i] = simhash_windows(bit_sums(g), np.zeros(1, np.int64), np.array([len(g)]))[0]
            for x in s:
                owners.setdefault(x, []).append(i)
        self.known = np.array(sorted(owners), np.uint64)
        # sizes of the items that hold each known shingle
        self.sizes = [sorted({self.words[i] for i in owners[int(x)]}) for x in self.known]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.known >> np.uint64(64 - FILTER_BITS)] = True
        near = [[y for y in range(256) if (x ^ y).bit_count() <= RADIUS // BLOCKS] for x in range(256)]
        held: dict[tuple[int, int, int], list[int]] = {}
        for i, (fp, m) in enumerate(zip(self.fp.tolist(), self.words)):
            for b in range(BLOCKS):
                for x in near[fp >> 8 * b & 255]:
                    held.setdefault((m, b, x), []).append(i)
        self.table = {k: np.array(v, np.int32) for k, v in held.items()}
        # items shorter than a shingle, by size and hash
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, (s, m) in enumerate(zip(self.shingles, self.words)):
            if m < SHINGLE:
                self.short.setdefault(m, {}).setdefault(next(iter(s)), []).append(i)

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Items:
        table, kept = WordHash(), []
        for i, text in rows:
            if words := words_of(text):
                h = table.array([w.encode() for w in words])
                kept.append((i, len(words), Counter(shingles(h).tolist())))
        return cls(*map(list, zip(*kept))) if kept else cls([], [], [])

    def candidates(self, fp: int, size: int) -> np.ndarray:
        """All items of the size within RADIUS bits."""
        met = [t for b in range(BLOCKS) if (t := self.table.get((size, b, fp >> 8 * b & 255))) is not None]
        found = np.unique(np.concatenate(met)) if met else np.empty(0, np.int32)
        return found[np.bitwise_count(self.fp[found] ^ np.uint64(fp)) <= RADIUS]


def short_hits(h: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item, start, words) of runs that equal an item shorter than a shingle."""
    for m, whole in items.short.items():
        if m < len(h):  # of a text that is no longer, the whole is one shingle
            g = gram_hashes(h, m)
            at = np.flatnonzero(np.isin(g, np.fromiter(whole, np.uint64, len(whole))))
            for p, x in zip(at.tolist(), g[at].tolist()):
                yield from ((i, p, m) for i in whole[x])


def leaks(text: str | None, items: Items, table: WordHash) -> list[tuple[int, int, int, float]]:
    """(item, first word, words, similarity) of the best window of each item that the text holds."""
    words = words_of(text)
    if not words or not items.ids:
        return []
    h = table.array([w.encode() for w in words])
    g = shingles(h)
    at = np.flatnonzero(items.filter[g >> np.uint64(64 - FILTER_BITS)])
    if len(at):
        place = np.minimum(np.searchsorted(items.known, g[at]), len(items.known) - 1)
        ok = items.known[place] == g[at]
        at, place = at[ok], place[ok]
    # (start, words, size of the items): as many words as the item has, or the whole text if that is shorter
    windows: set[tuple[int, int, int]] = set()
    for p, k in zip(at.tolist(), place.tolist() if len(at) else ()):
        for size in items.sizes[k]:
            m = min(size, len(words))
            low, high = max(0, p - max(0, m - SHINGLE)), min(p, len(words) - m)
            windows.update((s, m, size) for s in range(low, high + 1))
    found: dict[int, tuple] = {}
    order = sorted(windows)
    first = 0
    while first < len(order):
        base, last = order[first][0], first
        while last < len(order) and order[last][0] < base + RUN_WORDS:
            last += 1
        _verify(found, g, order[first:last], items)
        first = last
    for i, s, m in short_hits(h, items):
        _keep(found, i, s, m, 1.0)
    return [(items.ids[i], *v) for i, v in sorted(found.items())]


def _verify(found: dict, g: np.ndarray, windows: list[tuple[int, int, int]], items: Items) -> None:
    """Keep what windows (in order of their starts) prove; g: the text's shingles."""
    start = np.array([w[0] for w in windows])
    n = np.array([max(1, m - SHINGLE + 1) for _, m, _ in windows])
    base = int(start[0])
    sums = bit_sums(g[base:int((start + n).max())])
    for (s, m, size), k, fp in zip(windows, n.tolist(), simhash_windows(sums, start - base, n).tolist()):
        near = items.candidates(fp, size)
        if len(near):
            own = Counter(g[s:s + k].tolist())
            for i in near.tolist():
                _keep(found, i, s, m, similarity(own, items.shingles[i]))


def _keep(found: dict, i: int, start: int, words: int, sim: float) -> None:
    if sim >= SIMILARITY and (i not in found or sim > found[i][2]):
        found[i] = start, words, sim


def benchmark_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> Iterator[Items]:
    """The benchmark in parts of about ``item_bytes`` of text, dealt by a hash of the text; at least one, maybe empty."""
    rows = as_docs(benchmark, id_col, text_col).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // item_bytes) or 1
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).distinct().collect()
        yield Items.of(sorted(((r["doc_id"], r["text"]) for r in part), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): for each row, the benchmark items that it holds.

    A row holds an item if a window of as many words as the item has (the whole text if that is shorter) has a
    weighted Jaccard similarity of at least SIMILARITY to it, over shingles of SHINGLE words without case and
    punctuation; the best, then first, window is given.  What other items there are doesn't matter.  Items of fewer words
    than a shingle must be met whole.  Null and empty texts hold nothing, as do items with a null or empty text; a null id of
    a row or an item stays null; repeated rows give repeated results, equal items of one id count once; an empty table on
    either side gives an empty result; other columns are not read.  Very long texts are checked RUN_WORDS words at a time.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()),
                        ("similarity", pa.float64())])

    def against(items):
        def run(batches):
            def rows():
                table = WordHash()
                for b in batches:
                    for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        for found in leaks(text, items.value, table):
                            yield dict(zip(schema.names, (i, *found)))
            return batches_to(rows(), schema)
        return run

    context, told = docs.sparkSession.sparkContext, as_docs(docs, id_col, text_col)
    return reduce(DataFrame.unionByName, [
        told.mapInArrow(against(context.broadcast(part)), "doc_id long, item_id long, first_word long, n_words long, similarity double")
        for part in benchmark_parts(benchmark, item_bytes=item_bytes)])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs without the rows that hold a benchmark item; rows and columns are otherwise as they were.

    Rows with a null or empty text stay, as does every row if the benchmark is empty; of repeated rows all stay or none; an
    empty table stays empty."""
    at = docs.columns.index(text_col)

    def without(items):
        def run(batches):
            table = WordHash()
            for b in batches:
                yield b.filter(pa.array([not leaks(t, items.value, table) for t in b.column(at).to_pylist()], pa.bool_()))
        return run

    for part in benchmark_parts(benchmark, item_bytes=item_bytes):
        docs = docs.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(part)), docs.schema)
    return docs
