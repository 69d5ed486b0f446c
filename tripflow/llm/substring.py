"""Substring de-duplication by seed and extend.

Seeds: each document's winnowed anchors (the least hash among the ``size - k + 1`` runs of k words in a
window of ``size`` words), so equal windows always choose equal anchors at equal places.  Anchors of several
documents are found by a join on their hash; every other anchor is done with, and with it all windows that
chose it.  Extension: each repeated anchor is extended both ways to all windows around it that chose it; a
window repeats if its words stand in a document with a smaller id.  Windows that overlap or touch grow together
to maximal repeats, none shorter than ``size`` words, and their words are removed.

How the join stays even when a passage stands in a third of all documents: a map task takes its documents in
blocks and settles everything that it can within a block.  An anchor or window goes to the join once for a
block, as part of a binary list for (block, bucket of the hash), and never as pairs of documents; the answers
return as lists of places.  A hot passage thus sends one entry a block.  The texts are shuffled once: both
joins of texts with answers use the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import WordHash, as_docs, batches_to, gram_hashes, pack_ints, shuffle_partitions, text_bytes, unpack_ints, with_keys

BLOCK = 1 << 20      # entries that a task gathers for a block
MANY = -1            # in place of a document's number: several documents of the block
LOWEST = -(1 << 63)
# kind 0: entries for a bucket; 1: places settled within the block; 2: the block's documents
SWAP = pa.schema([("kind", pa.int32()), ("dest", pa.int64()), ("block", pa.int64()), ("h", pa.binary()), ("h2", pa.binary()),
                  ("doc", pa.binary()), ("no", pa.binary()), ("at", pa.binary())])
SWAP_SQL = "kind int, dest long, block long, h binary, h2 binary, doc binary, no binary, at binary"
PLACES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("places", pa.binary())])
PLACES_SQL = "k1 long, k2 long, places binary"


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and the controls 9 to 13."""
    return text_bytes(text).split()


def anchors(h: np.ndarray, size: int, k: int) -> np.ndarray:
    """For every window of ``size`` words the place of the run of k words it chooses (the first of equals)."""
    g = gram_hashes(h, k)
    w = size - k + 1
    return np.lib.stride_tricks.sliding_window_view(g, w).argmin(axis=1) + np.arange(len(g) - w + 1)


class Block:
    """Entries (hash, second hash, document, place) of some documents of a task."""

    def __init__(self, seq: int):
        self.id = (TaskContext.get().partitionId() << 24) + seq
        self.k1: list[int] = []
        self.k2: list[int] = []
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, k1: int, k2: int, h: np.ndarray, h2: np.ndarray, at: np.ndarray) -> None:
        self.parts.append((h, h2, np.full(len(h), len(self.k1), np.uint32), at.astype(np.uint32)))
        self.k1.append(k1)
        self.k2.append(k2)
        self.size += len(h)

    def rows(self, buckets: int, by_least: bool) -> Iterator[dict]:
        """by_least: entries of documents above the block's least one for that hash are settled as repeats;
        otherwise all entries of a hash in several documents are."""
        if not self.parts:
            return
        h, h2, no, at = (np.concatenate(x) for x in zip(*self.parts))
        k1 = np.array(self.k1, np.int64)
        order = np.lexsort((at, k1[no], h2, h))
        h, h2, no, at = h[order], h2[order], no[order], at[order]
        doc = k1[no]
        new = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        if by_least:
            settled = doc > doc[first][group]
            sent, tag = ~settled, no
        else:
            settled = np.logical_or.reduceat(no != no[first][group], first)[group]
            sent, tag = new | ~settled, np.where(settled, MANY, no.astype(np.int64))
        empty = {"h": None, "h2": None, "doc": None, "no": None, "at": None}
        if settled.any():
            yield empty | {"kind": 1, "dest": self.id, "block": self.id, "no": pack_ints(no[settled]),
                           "at": pack_ints(at[settled])}
        h, h2, no, at, doc = (x[sent] for x in (h, h2, tag, at, doc))
        bucket = (h >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        for b in range(buckets):
            i = order[cuts[b]:cuts[b + 1]]
            if len(i):
                yield {"kind": 0, "dest": b, "block": self.id, "h": h[i].tobytes(),
                       "h2": h2[i].tobytes() if by_least else None, "doc": pack_ints(doc[i]) if by_least else None,
                       "no": pack_ints(no[i]), "at": pack_ints(at[i])}
        yield empty | {"kind": 2, "dest": self.id, "block": self.id, "h": k1.tobytes(),
                       "h2": np.array(self.k2, np.int64).tobytes()}


def blocks(batches, entries, buckets: int, by_least: bool) -> Iterator[pa.RecordBatch]:
    """entries: row -> (hashes, second hashes, places) or None."""
    def rows():
        seq, block = 0, Block(0)
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", *entries.columns))):
                if (found := entries(*row[2:])) is not None:
                    block.add(row[0], row[1], *found)
                    if block.size >= BLOCK:
                        yield from block.rows(buckets, by_least)
                        seq += 1
                        block = Block(seq)
        yield from block.rows(buckets, by_least)
    return batches_to(rows(), SWAP, 500)


class AnchorEntries:
    """The distinct anchors of a text, each with all its places."""

    columns = ("text",)

    def __init__(self, size: int, k: int):
        self.size, self.k, self.table = size, k, WordHash()

    def __call__(self, text):
        h = self.table.array(words_of(text))
        if len(h) < self.size:
            return None
        at = anchors(h, self.size, self.k)
        at = at[np.r_[True, at[1:] != at[:-1]]]
        g = gram_hashes(h, self.k)[at]
        return g, np.zeros(len(g), np.uint32), at


class WindowEntries:
    """The windows of a text that chose one of its repeated anchors."""

    columns = ("text", "places")

    def __init__(self, size: int, k: int):
        self.size, self.k, self.table = size, k, WordHash()

    def __call__(self, text, places):
        h = self.table.array(words_of(text))
        if len(h) < self.size:
            return None
        repeated = np.zeros(len(h), bool)
        repeated[unpack_ints(places)] = True
        at = np.flatnonzero(repeated[anchors(h, self.size, self.k)])
        second = gram_hashes(h, self.size, 0xD6E8FEB86659FD93)[at] >> np.uint64(32)
        return gram_hashes(h, self.size)[at], second.astype(np.uint32), at


def answer(batches, by_least: bool) -> Iterator[pa.RecordBatch]:
    """A bucket's partition: which entries repeat in (for by_least: smaller documents of) other blocks."""
    def rows():
        held, block_of = [], []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"]:
                    yield r | {"dest": r["block"]}
                else:
                    no = unpack_ints(r["no"])
                    h2 = np.frombuffer(r["h2"], np.uint32) if by_least else np.zeros(len(no), np.uint32)
                    doc = unpack_ints(r["doc"]) if by_least else np.zeros(len(no), np.int64)
                    held.append((np.frombuffer(r["h"], np.uint64), h2, doc, no, unpack_ints(r["at"])))
                    block_of.append(np.full(len(no), r["block"], np.int64))
        if not held:
            return
        h, h2, doc, no, at = (np.concatenate(x) for x in zip(*held))
        block = np.concatenate(block_of)
        del held, block_of
        order = np.lexsort((doc if by_least else block, h2, h))
        h, h2, doc, no, at, block = (x[order] for x in (h, h2, doc, no, at, block))
        new = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        if by_least:
            yes = doc > doc[first][group]
        else:
            several = np.logical_or.reduceat((no == MANY) | (block != block[first][group]), first)
            yes = several[group] & (no != MANY)
        no, at, block = no[yes], at[yes], block[yes]
        order = np.argsort(block, kind="stable")
        ids, cuts = np.unique(block[order], return_index=True)
        for i, own in zip(ids.tolist(), np.split(order, cuts[1:])):
            yield {"kind": 1, "dest": i, "block": i, "h": None, "h2": None, "doc": None,
                   "no": pack_ints(no[own]), "at": pack_ints(at[own])}
    return batches_to(rows(), SWAP, 500)


def gathered(batches) -> Iterator[pa.RecordBatch]:
    """A partition of blocks: the sorted places of each document that has any."""
    def rows():
        docs, told = {}, {}
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 2:
                    docs[r["block"]] = np.frombuffer(r["h"], np.int64), np.frombuffer(r["h2"], np.int64)
                else:
                    told.setdefault(r["block"], []).append((unpack_ints(r["no"]), unpack_ints(r["at"])))
        for block, parts in told.items():
            no, at = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((at, no))
            no, at = no[order], at[order]
            ids, cuts = np.unique(no, return_index=True)
            k1, k2 = docs[block]
            for i, own in zip(ids.tolist(), np.split(at, cuts[1:])):
                yield {"k1": int(k1[i]), "k2": int(k2[i]), "places": pack_ints(own)}
    return batches_to(rows(), PLACES)


def repeated_places(rows: DataFrame, entries, by_least: bool) -> DataFrame:
    """(k1, k2, places): for each row of ``rows`` the places of its entries that repeat."""
    n = shuffle_partitions(rows.sparkSession)
    sent = rows.mapInArrow(lambda it: blocks(it, entries, n, by_least), SWAP_SQL)
    told = sent.repartition(n, "dest").mapInArrow(lambda it: answer(it, by_least), SWAP_SQL)
    # Rows equal in both keys have equal places; one of them is enough.
    return (told.repartition(n, "block").mapInArrow(gathered, PLACES_SQL)
            .groupBy("k1", "k2").agg(F.first("places").alias("places")))


def removed_words(n: int, places: np.ndarray, size: int) -> np.ndarray:
    """True for each of n words that a window starting at one of the places covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, places, 1)
    np.add.at(step, places + size, -1)
    return np.cumsum(step[:n]) > 0


def dedup_substrings(docs: DataFrame, size: int = 13, k: int = 4, id_col: str = "doc_id", text_col: str = "text",
                     keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, n_repeats, kept_sha256[, kept_text]) of every row.

    A word goes if a window of ``size`` words covers it whose words also start a window of a row with a smaller
    id; windows are judged on the input.  n_repeats counts the maximal removed runs; kept words are joined by
    one space.  docs should be read from files or a checkpoint, so that a repeated task meets its rows in the
    same order.  Words are compared by 96-bit hashes of windows.  A null text has no words; a null id counts as
    the smallest and stays null; rows with equal ids never remove from each other; texts shorter than ``size``
    words stay whole; an empty table gives an empty result; other columns are not read.
    """
    keyed = with_keys(as_docs(docs, id_col, text_col))
    seeds = repeated_places(keyed.select("k1", "k2", "text"), AnchorEntries(size, k), False)
    hit = (keyed.hint("merge").join(seeds, ["k1", "k2"])
           .select("doc_id", "k1", "k2", "text", "places"))
    repeats = repeated_places(hit, WindowEntries(size, k), True)
    joined = (keyed.hint("merge").join(repeats, ["k1", "k2"], "left")
              .select("doc_id", "k1", "k2", "text", "places"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_repeats", pa.int64()),
                        ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * keep_text)

    def cut(batches):
        def rows():
            for b in batches:
                for i, text, places in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "places"))):
                    words, gone, runs = words_of(text), 0, 0
                    n = len(words)
                    if places:
                        away = removed_words(n, unpack_ints(places), size)
                        gone, runs = int(away.sum()), int((away & ~np.r_[False, away[:-1]]).sum())
                        words = [w for w, x in zip(words, away.tolist()) if not x]
                    kept = b" ".join(words)
                    yield {"doc_id": i, "n_words": n, "n_removed": gone, "n_repeats": runs,
                           "kept_sha256": hashlib.sha256(kept).hexdigest()} | (
                               {"kept_text": kept.decode("utf-8", "replace")} if keep_text else {})
        return batches_to(rows(), schema)

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, n_repeats long, kept_sha256 string"
                             + ", kept_text string" * keep_text)
