"""Packing of token ids into rows of fixed length by best-fit decreasing.

Documents become token ids; a document longer than a row is cut into full rows' worth of pieces and a rest, in order,
so nothing is lost.  Pieces of a block are placed by falling length, each in the open row with the least room that
still holds it.  A segment tree over room sizes (0 to ``length``) counts the open rows with each room and finds the
least sufficient one in log(length) steps, whatever the number of rows.

A block is what a task reads until ``block_tokens`` ids are held: packing needs no shuffle, a task's memory is a
constant, and with hundreds of rows in a block nearly all of them fill up.  A row's documents thus come from one
block; which documents share a block follows from the input's files, and a repeated task gives the same rows.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm import bpe
from tripflow.llm.common import as_docs

# Fixed value: the pattern by which byte-level vocabularies of this kind split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 1 << 21


class RoomTree:
    """Open rows by the room they have left, with the least sufficient room found by descent."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(row, room) of an open row with the least room of at least ``size``."""
        at = size + self.leaves
        while not self.count[at]:
            while at & 1:          # a right child: nothing larger under this parent
                at >>= 1
                if at == 0:
                    return None
            at = at + 1 if at else 0
            if not at or at & (at - 1) == 0:  # walked off the right end of a level
                return None
        while at < self.leaves:
            at = 2 * at + (not self.count[2 * at])
        room = at - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Indices of pieces (each 1 to length tokens) in each row; ties go by index."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            rows.append([])
            found = len(rows) - 1, length
        row, room = found
        rows[row].append(i)
        if room > sizes[i]:
            tree.put(row, room - sizes[i])
    return rows


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def load_encoding(path: str) -> tiktoken.Encoding:
    ranks = load_ranks(path)
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODINGS: dict[str, tiktoken.Encoding] = {}
_RANK_TABLES: dict[str, bpe.PieceTable] = {}
# The library's pattern gives up on runs of blanks of some hundred thousand; texts with such ones are streamed.
LONG_BLANK = re.compile(r"\s{50000}")


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge list of a rank vocabulary: a token's two parts are what lower ranks merge its bytes into."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda e: e[1]):
        parts = [token[k:k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks.get(parts[k] + parts[k + 1], rank), k) for k in range(len(parts) - 1)))
            if best[0] >= rank:
                raise ValueError(f"token {token!r} can't be merged from lower ranks")
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def _rank_table(path: str) -> bpe.PieceTable:
    """The same vocabulary for the streaming encoder, built when a task first meets such a text."""
    if path not in _RANK_TABLES:
        ranks = load_ranks(path)
        _RANK_TABLES[path] = bpe.PieceTable(bpe.MergeTable(ranks, merges_of(ranks)))
    return _RANK_TABLES[path]

PACKED = pa.schema([("block", pa.int64()), ("row_no", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
                    ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
                    ("doc_ids", pa.list_(pa.int64())), ("first_tokens", pa.list_(pa.int64()))])


def pack_tokens(docs: DataFrame, rank_path: str, length: int = 2048, pad_id: int = 50256, id_col: str = "doc_id",
                text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each packed sequence: (block, row_no, n_tokens, ids, cu_seqlens, position_resets, doc_ids, first_tokens).

    ids: the row of the id matrix, ``length`` little-endian unsigned 32-bit integers, filled up with pad_id after
    n_tokens.  cu_seqlens: cumulative lengths of the row's segments, from 0 to n_tokens.  position_resets: the places
    where position ids start again at zero (each segment's start, and the padding's if there is any).  doc_ids and
    first_tokens: each segment's document and its first token's place there; the segments of a document, put together
    in that order, are its tokens.  Special tokens' strings are ordinary text.  A null or empty text has no tokens and
    no segment; a null id is kept as null; repeated rows are packed as often as they stand; an empty table gives no
    rows; other columns are not read.  A text with a run of 50,000 blanks or more goes through the streaming encoder, with the
    same ids.
    """
    if not 1 <= length <= 1 << 24:
        raise ValueError("length must be 1 to 2**24")

    def rows_of(block: int, held: list[tuple]) -> pa.RecordBatch:
        """held: (doc_id, first token, ids) of each piece."""
        rows = best_fit([len(x[2]) for x in held], length)
        matrix = np.full((len(rows), length), pad_id, "<u4")
        out = {c: [] for c in PACKED.names}
        for no, pieces in enumerate(rows):
            cuts = np.cumsum([0, *(len(held[i][2]) for i in pieces)])
            for i, a in zip(pieces, cuts.tolist()):
                matrix[no, a:a + len(held[i][2])] = held[i][2]
            n = int(cuts[-1])
            out["block"].append(block)
            out["row_no"].append(no)
            out["n_tokens"].append(n)
            out["ids"].append(matrix[no].tobytes())
            out["cu_seqlens"].append(cuts)
            out["position_resets"].append(cuts[:-1] if n == length else cuts)
            out["doc_ids"].append([held[i][0] for i in pieces])
            out["first_tokens"].append([held[i][1] for i in pieces])
        return pa.RecordBatch.from_pydict(out, schema=PACKED)

    def run(batches):
        if rank_path not in _ENCODINGS:
            _ENCODINGS[rank_path] = load_encoding(rank_path)
        library = _ENCODINGS[rank_path].encode_to_numpy

        def encode(text, **options):
            if not LONG_BLANK.search(text):
                return library(text, **options)
            return np.frombuffer(bpe.encode(_rank_table(rank_path), text), "<u4")
        block, held, n = TaskContext.get().partitionId() << 24, [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                ids = encode(text, disallowed_special=())
                for at in range(0, len(ids), length):
                    held.append((i, at, ids[at:at + length]))
                    n += len(held[-1][2])
                    if n >= block_tokens:
                        yield rows_of(block, held)
                        block, held, n = block + 1, [], 0
        if held:
            yield rows_of(block, held)

    return as_docs(docs, id_col, text_col).mapInArrow(
        run, "block long, row_no int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
        "doc_ids array<long>, first_tokens array<long>")


def positions(row_cu_seqlens: list[int], length: int) -> np.ndarray:
    """Position ids of a row of the matrix: 0, 1, ... from each reset."""
    cuts = np.unique(np.r_[row_cu_seqlens, length])
    return np.concatenate([np.arange(n) for n in np.diff(cuts)]) if len(cuts) > 1 else np.arange(length)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the packed rows as Parquet."""
    packed.write.mode("errorifexists").parquet(path)


def packing_rate(packed: DataFrame, length: int) -> DataFrame:
    """(n_rows, n_tokens, filled): the share of the matrix that holds tokens."""
    return packed.agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"),
                      (F.sum("n_tokens") / (F.count("*") * F.lit(length))).alias("filled"))
