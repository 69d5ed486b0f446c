"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.session import ensure_checkpoint_dir

# Rows and bytes per Arrow batch: a batch of very long texts must stay small in a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches, let workers find this package where the driver found it, and make sure that a
    reliable checkpoint folder is set."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ensure_checkpoint_dir(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_docs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that no other column can clash with its own names."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.col(f"`{text_col}`").cast("string").alias("text"))


def with_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text): k1 and k2 name a row and are never null; a null doc_id sorts first.

    Rows equal in doc_id and text share their keys, and all results of the operators are equal for them.
    """
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("k1"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"), "text")


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class WordHash(dict):
    """64-bit hashes of words, kept for the words seen lately (at most ``limit`` of them)."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int, mult: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    m, out = np.uint64(mult), np.zeros(n, np.uint64)
    for j in range(k):
        out ^= h[j:j + n]
        out *= m
        out ^= out >> np.uint64(29)
    return out


def pack_ints(a: np.ndarray) -> bytes:
    """Integers as bytes: their width, the least of them, and their distances from it in that width."""
    base = int(a.min()) if len(a) else 0
    span = int(a.max()) - base if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if span < 1 << (8 * w))
    off = (a.astype(np.int64).view(np.uint64) - np.int64(base).view(np.uint64)).astype(f"<u{width}")
    return bytes([width]) + np.int64(base).tobytes() + off.tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    base = np.frombuffer(data, np.uint64, 1, 1)[0]
    return (np.frombuffer(data, f"<u{data[0]}", -1, 9).astype(np.uint64) + base).view(np.int64)


def batches_to(rows: Iterator[dict], schema: pa.Schema, size: int = 2000, max_bytes: int = 8 << 20
               ) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows and about ``max_bytes`` of text and binary cells."""
    part, held = [], 0
    for r in rows:
        part.append(r)
        held += sum(len(v) for v in r.values() if isinstance(v, (bytes, str)))
        if len(part) >= size or held >= max_bytes:
            yield pa.RecordBatch.from_pylist(part, schema=schema)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=schema)


def crc_mod(id_col: Column, mod: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (null ids: as the text '')."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes that have an edge.

    edges: (src, dst) longs.  Alternates the large-star and small-star steps on checkpointed edge tables
    until no edge changes; each step is a grouped minimum with map-side combine and a join, so that no
    component is ever gathered in one place.  An input that hasn't settled after ``max_rounds`` rounds
    (their number grows with the logarithm of the longest path) raises.
    """
    cur = (edges.where("src <> dst")
           .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
           .distinct().checkpoint())
    mark = _edge_mark(cur)
    for _ in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        cur = (small.select("u", F.col("m").alias("v"))
               .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
               .distinct().checkpoint())
        new = _edge_mark(cur)
        if new == mark:
            roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        mark = new
    raise RuntimeError(f"components unsettled after {max_rounds} rounds")


def _edge_mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
