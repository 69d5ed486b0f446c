"""Ranked lexical search: Block-Max MaxScore over compressed posting blocks in document shards.

One pass over the documents writes an inverted index in shards: for each query term the postings (document's place in
the shard, occurrences) in blocks of 128, each block compressed by itself.  Beside it stand, uncompressed, the block's
last place and its competitive pairs (occurrences, document length) - those that no other pair of the block beats in
both - from which the block's largest score follows exactly once the corpus's totals are known.

A query runs over a shard so: a list's bound is the largest of its blocks' maxima.  Lists are sorted by bound; those at
the low end whose bounds together don't reach the tenth best score so far are non-essential.  Candidates come from the
essential lists alone, a window of places at a time.  For the non-essential lists, best first, a candidate's score so far
plus the maximum of the one block that could hold it plus the bounds of the lists left decides whether it can still
reach the heap; only blocks with candidates that can are decompressed.  The heaps of all tasks are merged in the end.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripflow.llm.common import as_docs, pack_ints, text_bytes, unpack_ints

# Separators (all ASCII but letters and digits) become blanks, A-Z become a-z, other bytes stay.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
BLOCK = 128
# A shard closes at so many documents or query-term postings.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
# Places that a query looks at before it takes stock of its heap again.
WINDOW = 2048
# Bytes of a text that are split into terms at a time, and bytes of queries that are broadcast at a time.
PIECE_BYTES, QUERY_BYTES = 1 << 20, 16 << 20


def pieces(data: bytes):
    """Parts of about PIECE_BYTES, cut at separators."""
    at = 0
    while len(data) - at > PIECE_BYTES:
        cut = data.rfind(b" ", at + 1, at + PIECE_BYTES)
        cut = data.find(b" ", at + PIECE_BYTES) if cut < 0 else cut
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def terms_of(text: str | None):
    """Lists of a text's terms, one for each piece: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    for part in pieces(text_bytes(text).translate(TERM_BYTES)):
        yield part.split()


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, terms with repeats, and the documents that hold each query term."""
    docs: int
    terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([floor(1000 * log((2 * self.docs + 2) / (2 * d + 1))) for d in self.df.tolist()], np.int64)

    def impact(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A term's share of the score before its weight; grows with tf and falls with the length."""
        m = 10 + (90 * length * self.docs) // max(self.terms, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# --- index

INDEX = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.binary()), ("no_id", pa.binary()),
                   ("lengths", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("blocks", pa.binary()),
                   ("last", pa.binary()), ("best", pa.binary()), ("best_tf", pa.binary()), ("best_n", pa.binary()),
                   ("starts", pa.binary()), ("postings", pa.binary())])
INDEX_TYPES = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in INDEX)


def competitive(block_of: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the pairs that no other pair of their block beats or equals in both tf (more) and n (less)."""
    order = np.lexsort((n, -tf, block_of))
    b, length = block_of[order], n[order]
    # By falling tf, a pair stays if its length is below all before it in the block.
    base = b * (int(n.max(initial=0)) + 2)
    before = np.minimum.accumulate(np.r_[np.iinfo(np.int64).max, length - base])[:-1]
    return order[length - base < before]


def write_shard(ids: list, lengths: list[int], keys: list[np.ndarray], counts: list[np.ndarray], block: int) -> dict:
    """One index row with blocks of ``block`` postings: keys are term << 32 | place, a document's in one array."""
    key = np.concatenate(keys) if keys else np.empty(0, np.int64)
    tf = np.concatenate(counts) if counts else np.empty(0, np.int64)
    order = np.argsort(key, kind="stable")
    key, tf = key[order], tf[order]
    term, place = key >> 32, key & 0xFFFFFFFF
    size = np.array(lengths, np.int64)
    terms, first, held = np.unique(term, return_index=True, return_counts=True)
    blocks = -(-held // block)
    starts = np.repeat(first, blocks) + block * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    ends = np.r_[starts[1:], len(key)]
    block_of = np.repeat(np.arange(len(starts)), ends - starts)
    best = competitive(block_of, tf, size[place])
    data, offsets = bytearray(), []
    for a, z in zip(starts.tolist(), ends.tolist()):
        offsets.append(len(data))
        gaps = pack_ints(np.diff(place[a:z], prepend=0))
        data += len(gaps).to_bytes(4, "little") + gaps + pack_ints(tf[a:z])
    offsets.append(len(data))
    return {"n_docs": len(ids), "n_terms": int(size.sum()), "ids": pack_ints(np.array([i or 0 for i in ids], np.int64)),
            "no_id": np.packbits([i is None for i in ids]).tobytes(), "lengths": pack_ints(size), "terms": pack_ints(terms),
            "counts": pack_ints(held), "blocks": pack_ints(blocks),
            "last": pack_ints(place[ends - 1]) if len(ends) and len(key) else pack_ints(place[:0]),
            "best": pack_ints(np.bincount(block_of[best], minlength=len(starts))), "best_tf": pack_ints(tf[best]),
            "best_n": pack_ints(size[place[best]]), "starts": pack_ints(np.array(offsets)), "postings": bytes(data)}


def build_index(docs: DataFrame, terms: list[bytes], shard_docs: int = SHARD_DOCS, block: int = BLOCK) -> DataFrame:
    """Index rows (one a shard) of all documents with a term, for the given query terms (numbered as they stand)."""
    number = {t: k for k, t in enumerate(terms)}

    def run(batches):
        ids, lengths, keys, counts, held = [], [], [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, found = 0, Counter()
                for words in terms_of(text):
                    n += len(words)
                    found.update([k for k in map(number.get, words) if k is not None])
                if not n:
                    continue
                own = np.fromiter(found, np.int64, len(found))
                keys.append((own << 32) | len(ids))
                counts.append(np.fromiter(found.values(), np.int64, len(found)))
                ids.append(i)
                lengths.append(n)
                held += len(own)
                if len(ids) >= shard_docs or held >= SHARD_POSTINGS:
                    yield pa.RecordBatch.from_pylist([write_shard(ids, lengths, keys, counts, block)], schema=INDEX)
                    ids, lengths, keys, counts, held = [], [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([write_shard(ids, lengths, keys, counts, block)], schema=INDEX)

    return docs.mapInArrow(run, INDEX_TYPES)


def corpus_of(index: DataFrame, n_terms: int) -> Corpus:
    """Totals over all shards; the driver gets one row for each query term."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches):
        df, docs, terms = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            for row in b.to_pylist():
                df[unpack_ints(row["terms"])] += unpack_ints(row["counts"])
                docs, terms = docs + row["n_docs"], terms + row["n_terms"]
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, seen]), pa.array(np.r_[docs, terms, df[seen]])], schema=schema)

    narrow = index.select("n_docs", "n_terms", "terms", "counts")
    found = dict(map(tuple, narrow.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
    return Corpus(found.get(-1, 0), found.get(-2, 0), np.array([found.get(k, 0) for k in range(n_terms)], np.int64))


# --- search

class Shard:
    """An index row, ready for queries; decompressed blocks are kept while it is in use."""

    def __init__(self, row: dict, corpus: Corpus, weights: np.ndarray):
        get = lambda c: unpack_ints(row[c])
        self.corpus, self.weights, self.n = corpus, weights, row["n_docs"]
        ids = get("ids")
        self.no_id = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=self.n).astype(bool)
        self.lengths = get("lengths")
        # Ids as they sort: a null id comes first.
        self.ids = [(1, i) if not x else (0, 0) for i, x in zip(ids.tolist(), self.no_id.tolist())]
        self.list_of = {t: k for k, t in enumerate(get("terms").tolist())}
        blocks = get("blocks")
        self.first = np.r_[0, np.cumsum(blocks)]
        self.last, self.starts, self.data = get("last"), get("starts"), row["postings"]
        best = get("best")
        if len(best):
            peak = np.maximum.reduceat(corpus.impact(get("best_tf"), get("best_n")), np.r_[0, np.cumsum(best)[:-1]])
            self.peak = peak * np.repeat(weights[get("terms")], blocks)
            self.bound = np.maximum.reduceat(self.peak, self.first[:-1])
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, block: int, term: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of a block, decompressed."""
        if block not in self.opened:
            data = self.data[self.starts[block]:self.starts[block + 1]]
            cut = 4 + int.from_bytes(data[:4], "little")
            place, tf = np.cumsum(unpack_ints(data[4:cut])), unpack_ints(data[cut:])
            self.opened[block] = place, self.corpus.impact(tf, self.lengths[place]) * self.weights[term]
        return self.opened[block]

    def blocks_of(self, at: int) -> slice:
        return slice(self.first[at], self.first[at + 1])

    def search(self, terms: list[int], heap: list, most: int, window: int = WINDOW) -> None:
        """Put the best documents for the terms into the heap of (score, id turned round, id)."""
        lists = sorted((int(self.bound[k]), k, t) for t in terms if (k := self.list_of.get(t)) is not None)
        if not lists:
            return
        below = np.cumsum([b for b, _, _ in lists])  # below[i]: bounds of lists 0 to i together
        score = np.zeros(window, np.int64)
        for start in range(0, self.n, window):
            stop = min(start + window, self.n)
            floor_ = heap[0][0] if len(heap) == most else 1
            essential = int(np.searchsorted(below, floor_))  # the first list that takes the sum to floor_ or above
            if essential == len(lists):
                return
            score[:] = 0
            for _, k, t in lists[essential:]:
                self._add(score, k, t, start, stop)
            alive = np.flatnonzero(score)
            for i in range(essential - 1, -1, -1):
                rest = int(below[i - 1]) if i else 0
                alive = alive[score[alive] + int(below[i]) >= floor_]
                if not len(alive):
                    break
                self._refine(score, alive, *lists[i][1:], start, rest, floor_)
            alive = alive[score[alive] >= floor_]
            if len(alive) > most:
                alive = alive[score[alive] >= np.partition(score[alive], -most)[-most]]
            for p in alive.tolist():
                self._offer(heap, int(score[p]), self.ids[start + p], most)

    def _add(self, score: np.ndarray, k: int, term: int, start: int, stop: int) -> None:
        """Scores of an essential list's postings in the window."""
        s = self.blocks_of(k)
        a = s.start + int(np.searchsorted(self.last[s], start))
        while a < s.stop:
            place, points = self.postings(a, term)
            lo, hi = np.searchsorted(place, (start, stop))
            score[place[lo:hi] - start] += points[lo:hi]
            if self.last[a] >= stop - 1:
                break
            a += 1

    def _refine(self, score: np.ndarray, alive: np.ndarray, k: int, term: int, start: int, rest: int, floor_: int) -> None:
        """Add a non-essential list's points to the candidates that its block maxima leave a chance."""
        s = self.blocks_of(k)
        block = s.start + np.searchsorted(self.last[s], alive + start)
        inside = block < s.stop
        there, block = alive[inside], block[inside]
        chance = score[there] + self.peak[block] + rest >= floor_
        there, block = there[chance], block[chance]
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        for a, z in zip(cuts.tolist(), [*cuts.tolist()[1:], len(block)]):
            place, points = self.postings(int(block[a]), term)
            want = there[a:z] + start
            at = np.searchsorted(place, want)
            hit = place[at] == want
            score[there[a:z][hit]] += points[at[hit]]

    @staticmethod
    def _offer(heap: list, points: int, doc: tuple[int, int], most: int) -> None:
        entry = (points, -doc[0], -doc[1], doc)
        if len(heap) < most:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


HITS = "item long, doc_id long, score long"


def search_index(index: DataFrame, queries: list[list[int]], corpus: Corpus, most: int, window: int = WINDOW) -> DataFrame:
    """(item, doc_id, score): of each task, the best documents for each query (a list of term numbers)."""
    weights = corpus.weights()
    schema = pa.schema([(c.split()[0], pa.int64()) for c in HITS.split(", ")])

    def run(batches):
        heaps: list[list] = [[] for _ in queries]
        for b in batches:
            for k in range(b.num_rows):
                shard = Shard(b.slice(k, 1).to_pylist()[0], corpus, weights)
                for terms, heap in zip(queries, heaps):
                    shard.search(terms, heap, most, window)
        rows = [(i, d[1] if d[0] else None, points) for i, heap in enumerate(heaps) for points, _, _, d in heap]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at:at + 10_000])], schema=schema)

    return index.mapInArrow(run, HITS)


def ranked(docs: DataFrame, items: DataFrame, most: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", query_bytes: int = QUERY_BYTES,
           shard_docs: int = SHARD_DOCS, block: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """For each item row the ``most`` documents with the highest scores above 0: (item_id, rank, doc_id, score).

    Terms, weights and scores are those of the contract (integer BM25 over N, L, n, df and tf of all documents); equal
    scores go by ascending doc_id, a null id first.  Null and empty texts have no term, count for nothing and are never
    found; an item without a known term gives no rows; repeated document rows are documents each, repeated item rows
    are ranked each; empty tables give no rows; other columns are not read.  A very long text is split into terms piece
    by piece, only counts of query terms are kept.

    Items are taken in parts of about ``query_bytes`` of text: a part's terms are what is broadcast, and its index is built
    and searched by itself.  An index row is bounded by ``shard_docs`` and SHARD_POSTINGS; no list of postings is shuffled.
    """
    spark = docs.sparkSession
    told = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"),
                        F.col(f"`{item_text_col}`").cast("string").alias("text"))
    size = told.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = -(-size // query_bytes) or 1
    dealt = told.withColumn("part", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(parts)))
    found = [_ranked_part(spark, as_docs(docs, id_col, text_col), dealt.where(F.col("part") == k), most,
                          shard_docs, block, window) for k in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _ranked_part(spark: SparkSession, docs: DataFrame, part: DataFrame, most: int, shard_docs: int, block: int,
                 window: int) -> DataFrame:
    # Items of one text have one ranking, so each text is searched once.
    texts = [r["text"] for r in part.select("text").distinct().orderBy("text").collect()]
    number: dict[bytes, int] = {}
    queries = [sorted({number.setdefault(w, len(number)) for words in terms_of(t) for w in words}) for t in texts]
    index = build_index(docs, list(number), shard_docs, block).checkpoint()
    hits = search_index(index, queries, corpus_of(index, len(number)), most, window)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    names = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item long, text string")
    keyed = part.join(names, part["text"].eqNullSafe(names["text"])).select("item_id", "item")
    return keyed.join(best, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def oracle(most: int = 10) -> str:
    """The same in DuckDB's SQL, every document scored."""
    def words(table, key):
        low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"SELECT {key}, unnest(regexp_extract_all({low}, '{TERM_PATTERN}')) AS term FROM {table}"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
items AS (SELECT row_number() OVER () AS qid, item_id, text FROM benchmark),
words AS ({words('docs', 'rid')}),
sizes AS (SELECT rid, count(*) AS n FROM words GROUP BY rid),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
asked AS (SELECT DISTINCT * FROM ({words('items', 'qid')})),
postings AS (SELECT term, rid, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY term, rid),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM postings, corpus GROUP BY term, docs),
points AS (SELECT term, rid, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS points
           FROM postings JOIN weights USING (term) JOIN sizes USING (rid), corpus),
scores AS (SELECT qid, rid, CAST(sum(points) AS BIGINT) AS score FROM asked JOIN points USING (term) GROUP BY qid, rid),
places AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS FIRST) AS rank
           FROM scores JOIN docs USING (rid) JOIN items USING (qid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM places WHERE rank <= {most}"""
