"""Homomorphic multiset fingerprints of documents.

A document is a multiset of paragraphs (lines that aren't empty).  Each paragraph is hashed to a wide vector, and a
document's fingerprint is the sum of its paragraphs' vectors: adding a paragraph's vector inserts it, subtracting
it deletes it, and the order never matters.  The vector has two parts:

* ``EXACT`` lanes modulo 2**64, filled from the paragraph's 128-bit hash: equal multisets have equal sums, others don't;
* ``LIKE`` lanes modulo 2**32: the paragraph's runs of ``WIDTH`` characters, each adding +1 or -1 to one lane.  The
  sum of squared lanes of a difference of fingerprints then estimates how many runs two documents don't share, so
  likeness comes from fingerprints alone.

The edited text of a row needs the next row's head.  Rows are dealt into id ranges whose first row is also sent to
the range before, so one range shuffle of the texts brings all neighbours together; a task streams its sorted
range and holds two rows at a time.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import as_docs, batches_to, shuffle_partitions

EXACT, LIKE, WIDTH = 32, 512, 16
GOLD = np.uint64(0x9E3779B97F4A7C15)
LOWEST = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LANES = _mix(np.arange(1, EXACT + 1, dtype=np.uint64) * GOLD)


class Fingerprint:
    """A multiset of paragraphs as a sum of vectors; + and - insert and delete."""

    __slots__ = ("exact", "like")

    def __init__(self, exact: np.ndarray | None = None, like: np.ndarray | None = None):
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact
        self.like = np.zeros(LIKE, np.uint32) if like is None else like

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        if not text:
            return cls()
        return cls(_exact(text), _like(text))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.like + other.like)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.like - other.like)

    def __eq__(self, other) -> bool:
        return bool((self.exact == other.exact).all() and (self.like == other.like).all())

    def __hash__(self) -> int:
        return int(self.exact[0])

    def text(self) -> str:
        return base64.b64encode(self.exact.astype("<u8").tobytes() + self.like.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[:EXACT * 8], "<u8").copy(), np.frombuffer(raw[EXACT * 8:], "<u4").copy())

    def size(self) -> float:
        return float((self.like.view(np.int32).astype(np.float64) ** 2).sum())

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets; else an estimate of the share of runs in common, 0 to 1."""
        if self == other:
            return 1.0
        both = self.size() + other.size()
        return max(0.0, min(1.0, 1.0 - (self - other).size() / both)) if both else 0.0


def _exact(text: str) -> np.ndarray:
    keys = [xxhash.xxh3_128_intdigest(p.encode("utf-8", "surrogatepass")) for p in text.split("\n") if p]
    low = np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)
    high = np.array([k >> 64 for k in keys], np.uint64)
    out = np.zeros(EXACT, np.uint64)
    for at in range(0, len(low), 4096):
        out += _mix(low[at:at + 4096, None] * (LANES | np.uint64(1)) + _mix(high[at:at + 4096, None] ^ LANES)).sum(axis=0, dtype=np.uint64)
    return out


def _like(text: str) -> np.ndarray:
    """Signed counts of the runs of WIDTH characters (shorter ones at a paragraph's end), in one pass by doubling."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.r_[c != 10, False]
    h = np.where(inside, _mix(np.r_[c, np.uint32(0)].astype(np.uint64) + GOLD), np.uint64(0))
    full = inside.copy()  # the run of the present width ends within the paragraph
    width = 1
    while width < WIDTH:
        later = np.zeros_like(h)
        later[:-width] = h[width:]
        h = h + np.where(full, later * (GOLD + np.uint64(2 * width)), np.uint64(0))
        more = np.zeros_like(full)
        more[:-width] = full[width:]
        full &= more
        width *= 2
    h = _mix(h[inside])
    sign = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64) * 2 - 1
    return np.bincount((h % np.uint64(LIKE)).astype(np.int64), weights=sign, minlength=LIKE).astype(np.int64).astype(np.uint32)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def range_of(rows: DataFrame, starts: list[int]) -> DataFrame:
    """rows with the number r of the range that holds k: the last of the falling starts that is k or above.

    Two steps of about sqrt(len(starts)) comparisons against two constant arrays, so that the plan has the same size
    for any number of ranges."""
    width = max(1, int(len(starts) ** 0.5))
    ends = [starts[min(at + width, len(starts)) - 1] for at in range(0, len(starts), width)]
    table = F.lit(np.array(starts, np.int64))
    above = lambda s: F.col("k") <= s
    passed = rows.withColumn("passed", F.size(F.filter(F.lit(np.array(ends, np.int64)), above)) * width)
    inner = F.size(F.filter(F.slice(table, F.col("passed") + 1, F.lit(width)), above))
    return passed.withColumn("r", F.least(F.col("passed") + inner, F.lit(len(starts))) - 1).drop("passed")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next row is that of the next smaller doc_id (after the last: the first); rows of equal ids follow each other
    by their text.  A null text counts as empty; a null id stays null and comes last; a single row is its own next;
    two empty texts are alike (1.0), an empty and another one aren't (0.0); an empty table gives an empty result;
    other columns are not read.
    """
    rows = as_docs(docs, id_col, text_col).select(
        "doc_id", F.coalesce("doc_id", F.lit(LOWEST).cast("long")).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    top, cuts = rows.agg(F.max("k"), F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10_000)).first()
    # Range r holds the ids up to starts[r] and above starts[r + 1]; starts are ids of the table.
    starts = sorted({*(cuts or []), top} - {None}, reverse=True) or [0]
    # A row also goes to the range before if its id is the first of its own; the first row of all also to the last range.
    last = len(starts) - 1
    before = F.when(F.col("k") == F.lit(starts[0]), F.lit(last)).otherwise(F.col("r") - 1)
    is_first = F.col("k") == F.get(F.lit(np.array(starts, np.int64)), F.col("r"))
    dealt = (range_of(rows, starts)
             .withColumn("to", F.when(is_first, F.array(F.struct(F.col("r").alias("r"), F.lit(0).alias("extra")),
                                                        F.struct(before.alias("r"), F.lit(1).alias("extra"))))
                         .otherwise(F.array(F.struct(F.col("r").alias("r"), F.lit(0).alias("extra")))))
             .select("doc_id", "k", "text", F.explode("to").alias("to")).select("doc_id", "k", "text", "to.r", "to.extra"))
    ordered = dealt.repartitionById(n, "r").sortWithinPartitions("r", "extra", F.desc("k"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def result(row, following):
        (i, text, own), (_, next_text, next_own) = row, following
        new = edited(text, next_text)
        new_own = own if new == text else Fingerprint.of(new)
        return {"doc_id": i, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                "fingerprint": own.text(), "edited_fingerprint": new_own.text(), "near_edited": own.likeness(new_own),
                "near_next": own.likeness(next_own)}

    def run(batches):
        def rows_out():
            held, at, done = None, None, False
            for b in batches:
                for i, text, r, extra in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "r", "extra"))):
                    if r != at:
                        held, at, done = None, r, False
                    if done:  # further rows of the id that begins the next range
                        continue
                    row = (i, text, Fingerprint.of(text))
                    if held is not None:
                        yield result(held, row)
                    held, done = row, bool(extra)
        return batches_to(rows_out(), schema, 500)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                              "edited_fingerprint string, near_edited double, near_next double")
