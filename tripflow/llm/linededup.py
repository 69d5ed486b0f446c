"""Line de-duplication by a deletion-neighbourhood join.

Two lines are one edit apart exactly if deleting the same place in both leaves equal texts (a substitution), or
deleting a place in the longer leaves the shorter (an insertion).  So every line emits its variants, the line
without one character each, as hashed keys, and equal keys meet:

* (variant, place) with (variant, place): all lines that share such a key are one edit apart from each other, so
  the earliest of them, a grouped minimum, is partner enough for all the rest;
* variant with whole line: the shorter line and all longer lines that lead to it, again as minima both ways.

No step makes pairs within a key, so a key shared by a third of all lines costs a partial aggregate.  Variants are
emitted only for lines that can have a partner: cut in two, two lines one edit apart agree in one half, so lines
that share neither half with another line are settled by a count of halves.  Partners are verified by their edit
distance.  Equal lines are one entry throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import as_docs, batches_to, with_keys

MIN_CHARS = 20      # shorter lines are copies only if they are equal
LOWEST = -(1 << 63)
HOT_SHARE, SALTS = 1000, 64   # a line with more than a thousandth of all rows is dealt out in so many parts
BASE = np.uint64(0x9E3779B97F4A7C15)
WORDS = 1 << 19     # 64-bit words of the bitmap that lets most lines pass without a join (4 MB, whatever the input)


def lines_of(text: str | None) -> list[str]:
    return [] if not text else text.split("\n")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hash(line: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")))


def half_keys(line: str) -> list[int]:
    """Hashes of both halves for the line's length and for one less: what lines one edit apart have in common."""
    n, h = len(line), xxhash.xxh3_64_intdigest
    return [_signed(h(part.encode("utf-8", "surrogatepass"), 2 * m + side)) for m in (n, n - 1)
            for side, part in enumerate((line[:m // 2], line[n - (m - m // 2):]))]


def _powers(n: int, known=[np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(known[0]) < n:
        with np.errstate(over="ignore"):
            known[0] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 4096), BASE)], dtype=np.uint64)
    return known[0][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def variant_hashes(line: str) -> tuple[int, np.ndarray]:
    """Hash of the line, and of the line without the character at each place, in one pass over the line."""
    c = _mix(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(11))
    n = len(c)
    p = _powers(n)
    head = np.cumsum(c * p, dtype=np.uint64)                       # characters up to each place
    moved = np.cumsum((c[1:] * p[:-1])[::-1], dtype=np.uint64)[::-1]  # characters after it, one place lower
    without = np.r_[np.uint64(0), head[:-1]] + np.r_[moved, np.uint64(0)]
    whole = _mix(head[-1:] + np.uint64(n))[0]
    return int(whole.view(np.int64)), _mix(without + np.uint64(n - 1)).view(np.int64)


def within_one(a: str, b: str) -> bool:
    """Edit distance at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


class Seen(set):
    """What a task has told already, so that a hot line costs one row a task; forgotten when it grows large."""

    def first_time(self, x: int) -> bool:
        if x in self:
            return False
        if len(self) >= 500_000:
            self.clear()
        self.add(x)
        return True


def all_lines(keyed: DataFrame) -> DataFrame:
    """(k1, line_no, k2, h): every line that isn't blank."""
    def run(batches):
        for b in batches:
            rows = ([], [], [], [])
            for k1, k2, text in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text"))):
                for no, line in enumerate(lines_of(text)):
                    if line and not line.isspace():
                        for column, value in zip(rows, (k1, no, k2, line_hash(line))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()),
                                              pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())],
                                             names=["k1", "line_no", "k2", "h"])
    return keyed.select("k1", "k2", "text").mapInArrow(run, "k1 long, line_no int, k2 long, h long")


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the bit of each ``key`` set."""
    rows = (keys.select(F.pmod(F.shiftrightunsigned("key", 6), F.lit(WORDS)).alias("w"),
                        F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
            .groupBy("w").agg(F.bit_or("bit").alias("bits"))).toArrow()
    out = np.zeros(WORDS, np.uint64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.view(np.uint64)
    return (bits[(k >> np.uint64(6)) % np.uint64(WORDS)] >> (k & np.uint64(63))) & np.uint64(1) > 0


def candidates(keyed: DataFrame, min_chars: int) -> DataFrame:
    """(h, line): the distinct lines that share a half with another line."""
    def halves(batches):
        seen = Seen()
        for b in batches:
            keys, own = [], []
            for text in b.column(0).to_pylist():
                for line in lines_of(text):
                    if len(line) >= min_chars and not line.isspace() and seen.first_time(h := line_hash(line)):
                        keys += half_keys(line)
                        own += (h, h, h, h)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own, pa.int64())], names=["key", "h"])

    shared = (keyed.select("text").mapInArrow(halves, "key long, h long").groupBy("key")
              .agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key").checkpoint())
    bits = shared.sparkSession.sparkContext.broadcast(bitmap(shared))

    def likely(batches):
        seen = Seen()
        schema = pa.schema([("h", pa.int64()), ("line", pa.string()), ("keys", pa.list_(pa.int64()))])

        def rows():
            for b in batches:
                for text in b.column(0).to_pylist():
                    lines = [x for x in lines_of(text) if len(x) >= min_chars and not x.isspace()]
                    if not lines:
                        continue
                    keys = np.array([half_keys(x) for x in lines], np.int64)
                    for i in np.flatnonzero(marked(bits.value, keys).any(axis=1)).tolist():
                        if seen.first_time(h := line_hash(lines[i])):
                            yield {"h": h, "line": lines[i], "keys": keys[i]}
        return batches_to(rows(), schema)

    # The bitmap may let lines through that share no half; this join settles it.
    rows = keyed.select("text").mapInArrow(likely, "h long, line string, keys array<long>")
    sure = (rows.select("h", "line", F.explode("keys").alias("key")).join(shared, "key", "left_semi"))
    return sure.groupBy("h").agg(F.min("line").alias("line"))


def near_earlier(lines: DataFrame) -> DataFrame:
    """(h): of the distinct lines (h, line, at), those that an earlier one by ``at`` is within one edit of."""
    # Numbers in the order of first places, settled by the checkpoint.
    numbered = (lines.orderBy("at", "h").withColumn("o", F.monotonically_increasing_id())
                .select("o", "h", "line").checkpoint())

    def wholes(batches):
        for b in batches:
            keys = [variant_hashes(x)[0] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64())], names=["o", "key"])

    whole = numbered.select("o", "line").mapInArrow(wholes, "o long, key long").checkpoint()
    bits = whole.sparkSession.sparkContext.broadcast(bitmap(whole))

    def variants(batches):
        for b in batches:
            for o, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys = variant_hashes(line)[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), o)), pa.array(keys), pa.array(np.arange(len(keys), dtype=np.int32)),
                     pa.array(marked(bits.value, keys))], names=["o", "key", "place", "short"])

    less = numbered.select("o", "line").mapInArrow(variants, "o long, key long, place int, short boolean")
    # Lines with the same variant and place differ in the character there only: as many lines as characters at most.
    w = Window.partitionBy("key", "place")
    substituted = less.select("o", "key", "place").withColumn("o2", F.min("o").over(w)).where("o2 < o").select("o", "o2")
    longer = less.where("short").select(F.col("o").alias("long_o"), "key").distinct().checkpoint()
    least_short = whole.groupBy("key").agg(F.min("o").alias("o2"))
    least_long = longer.groupBy("key").agg(F.min("long_o").alias("o2"))
    by_short = longer.join(least_short, "key").where("o2 < long_o").select(F.col("long_o").alias("o"), "o2")
    by_long = whole.join(least_long, "key").where("o2 < o").select("o", "o2")
    found = substituted.union(by_short).union(by_long).distinct()

    def verify(batches):
        for b in batches:
            ok = [within_one(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_())).select(["h"])

    other = numbered.select(F.col("o").alias("o2"), F.col("line").alias("line2"))
    return (found.join(numbered, "o").join(other, "o2").select("h", "line", "line2")
            .mapInArrow(verify, "h long").distinct())


def dropped_lines(keyed: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, lines): the numbers of the lines of each row that repeat an earlier line."""
    lines = all_lines(keyed)
    # Where each distinct line stands first; equal lines collapse on the map side.
    first = lines.groupBy("h").agg(F.min(F.struct("k1", "line_no", "k2")).alias("at"), F.count("*").alias("n")).checkpoint()
    gone = (near_earlier(candidates(keyed, min_chars).join(first.select("h", "at"), "h"))
            .withColumn("gone", F.lit(True)))
    # At most HOT_SHARE lines have more rows than this; each of them meets its first place in SALTS parts.
    most = (first.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = F.broadcast(first.where(F.col("n") > most).select("h", F.lit(True).alias("hot")))
    salts = F.when(F.col("n") > most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    settled = (first.join(gone, "h", "left").where((F.col("n") > 1) | F.col("gone"))
               .select("h", "at", "gone", F.explode(salts).alias("salt")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("k1", "k2", "line_no"), F.lit(SALTS))).otherwise(0).cast("int")
    repeated = (lines.join(hot, "h", "left").withColumn("salt", salt).drop("hot").join(settled, ["h", "salt"])
                .where(F.col("gone").isNotNull() | ~(F.struct("k1", "line_no", "k2") == F.col("at"))))
    return repeated.groupBy("k1", "k2").agg(F.collect_set("line_no").alias("lines"))


def _cut(text: Column, parts: Column, away: Column) -> Column:
    """A text of the lines ``parts`` without those whose numbers are in ``away``, in time proportional to both.

    parts is a column of its own, so that the text is split once."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), away)
    kept = F.transform(stay, lambda i: F.get(parts, i))
    return F.when(F.size(away) > 0, F.array_join(kept, "\n")).otherwise(text)


def _with_lines(df: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(row, text, parts, lines): each row as it was, its text and lines, and the numbers of its lines that go."""
    keyed = with_keys(as_docs(df, id_col, text_col))
    both = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
                     F.struct(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
                     .alias("own"))
    both = both.select("row", "own.doc_id", "own.text")
    return (both.withColumn("k1", F.coalesce("doc_id", F.lit(LOWEST).cast("long")))
            .withColumn("k2", F.xxhash64(F.coalesce("text", F.lit(""))))
            .hint("merge").join(dropped_lines(keyed, min_chars), ["k1", "k2"], "left")
            .select("row", "text", F.split("text", "\n").alias("parts"), F.coalesce("lines", F.array().cast("array<int>")).alias("lines")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row.

    A line goes if an equal line, or for lines of ``min_chars`` characters and more one within one edit, stands
    earlier: in a row with a smaller doc_id, higher up in the row, or at the same height in a row with the same id and
    a smaller hash of its text.  Lines are judged on the input.  Blank lines stay and are never partners.  A null text
    has no lines and stays null; an empty one has none and stays empty; a null id counts as the smallest; a repeated
    row (equal id and text) is one document and keeps the same lines in each copy; an empty table gives an empty
    result; other columns are not read.
    """
    rows = _with_lines(as_docs(docs, id_col, text_col), min_chars, "doc_id", "text")
    n = F.when(F.length("text") > 0, F.size("parts")).otherwise(0)
    return rows.select("row.doc_id", n.cast("int").alias("n_lines"), F.size("lines").alias("n_dropped"),
                       _cut(F.col("text"), F.col("parts"), F.col("lines")).alias("kept_text"))


def strip_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that ``dedup_lines`` drops cut from the text; rows and columns are otherwise as they were."""
    rows = _with_lines(docs, min_chars, id_col, text_col)
    return rows.select(F.col("row").withField(f"`{text_col}`", _cut(F.col("text"), F.col("parts"), F.col("lines"))).alias("row")).select("row.*")


def digest(result: DataFrame) -> DataFrame:
    """dedup_lines' result with the SHA-256 of the kept text in its place."""
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
