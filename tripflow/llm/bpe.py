"""BPE encoding and decoding as bounded-memory transducers.

Encoding.  A merge list decides every token from a bounded number of bytes after the token's start: its
*sufficient lookahead* (``MergeTable.lookahead``).  ``PieceStream`` takes the bytes of one pre-token in
any portions, merges a window, and emits those tokens of it that no later byte can change, so its memory
is a constant whatever the length of the piece.  ``TextStream`` cuts text into pre-tokens and special
tokens in the same manner, portion by portion.  Pieces seen lately are looked up in a bounded table.

Decoding.  ``ByteDecoder`` turns ids into bytes and bytes into text with an incremental UTF-8 machine, so
that characters split over tokens (or portions) come out whole.

Both run inside Arrow map tasks: no shuffle, no state beyond a portion of one text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import as_docs, batches_to

# Fixed value: the pattern by which byte-level vocabularies of this kind split text.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
# The classes a pre-token of any length can consist of (after an optional space).
RUNS = {"letters": regex.compile(r"\p{L}+"), "numbers": regex.compile(r"\p{N}+"),
        "other": regex.compile(r"[^\s\p{L}\p{N}]+"), "space": regex.compile(r"\s+")}
PORTION = 1 << 16        # characters taken from a text at once
TABLE_LIMIT = 300_000    # pieces remembered by a worker
REMEMBERED = 48          # longest piece (characters) that is remembered


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if chr(b) not in out)
    return out | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Vocabulary and merge ranks over bytes."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]],
                 specials: dict[str, int] | None = None):
        self.bytes_of = {i: t for t, i in tokens.items()}
        self.byte_id = [tokens.get(bytes([b]), -1) for b in range(256)]
        self.specials = dict(specials or {})
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for k, (a, b) in enumerate(merges):
            self.rank[tokens[a], tokens[b]] = k
            self.made.append(tokens[a + b])
        self.split_special = (regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))
                                            + ")") if self.specials else None)
        self.lookahead = self._lookahead(tokens, merges)

    @classmethod
    def load(cls, path: str) -> MergeTable:
        """From a tokenizer file of the byte-level BPE kind (JSON)."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        raw = lambda t: bytes(alphabet[c] for c in t)
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {raw(t): i for t, i in model["vocab"].items() if t not in specials}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        return cls(tokens, [(raw(a), raw(b)) for a, b in merges], specials)

    def _lookahead(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> int:
        """Bytes from a token's start within which every input decides whether the token stands there.

        A merge (u, v) of rank r stands or falls with u and v, formed by merges of lower ranks, and with
        merges of lower ranks that take v's end away.  Going through the ranks upwards, ``inner[t]`` is
        what forming t's parts needs, and ``thieves[t]`` lists (rank, bytes after t's end) of the merges
        that take t as their left part, with running maxima; both rest on lower ranks only.
        """
        inner: dict[int, int] = {}
        ranks_of: dict[int, list[int]] = {}
        most: dict[int, list[int]] = {}

        def need(token: int, size: int, below: int) -> int:
            out = max(size, inner.get(token, size))
            if ranks := ranks_of.get(token):
                k = bisect_left(ranks, below)
                if k:
                    out = max(out, size + most[token][k - 1])
            return out

        for r, (a, b) in enumerate(merges):
            ia, ib, made = tokens[a], tokens[b], tokens[a + b]
            of_b = need(ib, len(b), r)
            inner[made] = max(inner.get(made, 0), need(ia, len(a), r), len(a) + of_b)
            ranks_of.setdefault(ia, []).append(r)
            tops = most.setdefault(ia, [])
            tops.append(max(of_b, tops[-1] if tops else 0))
        return max((need(i, len(t), len(merges)) for t, i in tokens.items()), default=1)

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a byte string: the pair of least rank first, the leftmost of equals first."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 96:
            return self._merge_long(ids)
        get, made, none = self.rank.get, self.made, len(self.made)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            ids[i:i + 2] = [made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list: n log n for long windows."""
        n, get = len(ids), self.rank.get
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = self.made[r], -2, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                if (q := get((ids[i], ids[nxt[j]]))) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[nxt[j]]))
            if prv[i] >= 0 and (q := get((ids[prv[i]], ids[i]))) is not None:
                heapq.heappush(heap, (q, prv[i], ids[prv[i]], ids[i]))
        return [x for x in ids if x != -2]


class PieceStream:
    """Transducer for the bytes of one pre-token, fed in portions."""

    def __init__(self, merges: MergeTable):
        self.merges, self.held = merges, b""
        self.window = max(256, 4 * merges.lookahead)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        self.held += data
        while len(self.held) >= self.window:
            part = self.held[:self.window]
            start = 0
            for t in self.merges.merge(part):
                if start + self.merges.lookahead > len(part):
                    break
                out.append(t)
                start += len(self.merges.bytes_of[t])
            self.held = self.held[start:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class PieceTable(dict):
    """Piece -> its ids as little-endian bytes; the misses go through the transducer."""

    def __init__(self, merges: MergeTable, limit: int = TABLE_LIMIT):
        super().__init__()
        self.merges, self.limit = merges, limit

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) < self.merges.lookahead:  # nothing can come out before the piece ends
            out = pack(self.merges.merge(data))
        else:
            stream = PieceStream(self.merges)
            out = pack(stream.feed(data) + stream.finish())
        if len(piece) <= REMEMBERED:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = out
        return out


def pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class TextStream:
    """Transducer for text without special tokens, fed in portions: packed ids come out once they are stable."""

    def __init__(self, table: PieceTable):
        self.table, self.held, self.open = table, "", None

    def feed(self, text: str, last: bool = False) -> list[bytes]:
        out: list[bytes] = []
        self.held += text
        if self.open:
            self._go_on(out, last)
        if self.open:
            return out
        if last:
            out += map(self.table.__getitem__, PIECES.findall(self.held))
            self.held = ""
            return out
        spans = [m.span() for m in PIECES.finditer(self.held)]
        # Only the last two pieces can still change: the last may grow, and a quote may join what follows it.
        out += (self.table[self.held[a:b]] for a, b in spans[:-2])
        self.held = self.held[spans[-2][0]:] if len(spans) > 1 else self.held
        if len(self.held) > PORTION:
            self._open(out)
        return out

    def _open(self, out: list[bytes]) -> None:
        """The held text ends in a piece longer than a portion: go on inside that piece."""
        spans = [m.span() for m in PIECES.finditer(self.held)]
        out += (self.table[self.held[a:b]] for a, b in spans[:-1])
        self.held = self.held[spans[-1][0]:]
        kind = next(k for k, p in RUNS.items() if p.match(self.held[-1]))
        self.open = (kind, PieceStream(self.table.merges))
        self._go_on(out, False, int(kind != "space" and self.held[0] == " "))

    def _go_on(self, out: list[bytes], last: bool, skip: int = 0) -> None:
        """Feed what the held text has of the open piece; skip: its leading space."""
        kind, stream = self.open
        run = RUNS[kind].match(self.held, skip)
        end = run.end() if run else skip
        if end == len(self.held) and not last:
            keep = 1 if kind == "space" else 0  # the last space goes to the next piece if there is one
            out.append(pack(stream.feed(self.held[:end - keep].encode())))
            self.held = self.held[end - keep:]
            return
        if kind == "space" and end < len(self.held):
            end -= 1
        out += (pack(stream.feed(self.held[:end].encode())), pack(stream.finish()))
        self.held, self.open = self.held[end:], None


def encode(table: PieceTable, text: str) -> bytes:
    """Packed ids of a whole text, special tokens included, taken portion by portion."""
    split = table.merges.split_special
    if len(text) <= PORTION and (split is None or not split.search(text)):
        return b"".join(map(table.__getitem__, PIECES.findall(text)))
    out: list[bytes] = []
    for k, part in enumerate(split.split(text) if split else [text]):
        if k % 2:
            out.append(pack([table.merges.specials[part]]))
        elif part:
            stream = TextStream(table)
            for at in range(0, len(part), PORTION):
                out += stream.feed(part[at:at + PORTION], at + PORTION >= len(part))
    return b"".join(out)


class ByteDecoder:
    """Ids -> text, portion by portion; bytes that are no UTF-8 come out as U+FFFD."""

    def __init__(self, merges: MergeTable):
        self.bytes_of = merges.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


def decode(merges: MergeTable, packed: bytes) -> Iterator[str]:
    ids, machine = np.frombuffer(packed, "<u4"), ByteDecoder(merges)
    for at in range(0, len(ids), PORTION):
        yield machine.feed(ids[at:at + PORTION].tolist(), at + PORTION >= len(ids))


_TABLES: dict[str, PieceTable] = {}


def worker_table(path: str) -> PieceTable:
    """The worker's table for a tokenizer file, loaded once."""
    if path not in _TABLES:
        _TABLES[path] = PieceTable(MergeTable.load(path))
    return _TABLES[path]


def bpe_roundtrip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row.

    tokenizer_path: a byte-level BPE tokenizer file that every executor can open.  ids_sha256 is over the ids
    as little-endian unsigned 32-bit integers; decoded_sha256 over the UTF-8 of the text decoded from them.
    keep_ids adds the ids as array<int>.  A null text counts as empty (no ids); a null id stays null; repeated
    rows give repeated results; an empty table gives an empty result; other columns are not read.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()),
              pa.field("decoded_sha256", pa.string())] + [pa.field("ids", pa.list_(pa.int32()))] * keep_ids
    schema = pa.schema(fields)

    def run(batches):
        def rows():
            table = worker_table(tokenizer_path)
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    packed = encode(table, t or "")
                    sha = hashlib.sha256()
                    for part in decode(table.merges, packed):
                        sha.update(part.encode())
                    yield {"doc_id": i, "n_tokens": len(packed) // 4, "ids_sha256": hashlib.sha256(packed).hexdigest(),
                           "decoded_sha256": sha.hexdigest()} | (
                               {"ids": np.frombuffer(packed, "<u4").astype(np.int32)} if keep_ids else {})
        return batches_to(rows(), schema, 200 if keep_ids else 2000)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return as_docs(docs, id_col, text_col).mapInArrow(run, out)


def encodable(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without rows whose text is null or empty: they have no token."""
    return docs.where(F.length(F.col(f"`{text_col}`")) > 0)
