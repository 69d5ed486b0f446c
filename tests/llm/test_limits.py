"""Operators at their limits: many partitions, very long texts, nested benchmark items, a large lexicon."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from cases import frame, prose, tuples
from tripflow.llm import bpe, common, decontaminate, fingerprint, linededup, packing, toxicity
from tripflow.llm.queries import JSON_VOCABULARY, RANK_VOCABULARY


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    common.prepare(spark)


# --- fingerprints


@pytest.mark.parametrize("ranges", [1, 2, 7, 200, 20_000])
def test_ranges_of_ids(spark, ranges):
    r = random.Random(ranges)
    starts = sorted(r.sample(range(-10 ** 6, 10 ** 6), ranges), reverse=True)
    ids = [starts[0], starts[-1], starts[-1] - 5, *(s for s in starts[:300]), *(r.randrange(-10 ** 6, starts[0] + 1) for _ in range(300))]
    rows = spark.createDataFrame([(i,) for i in ids], "k long")
    want = [(i, max(j for j in (np.searchsorted(-np.array(starts), -i, side="right") - 1,))) for i in ids]
    got = fingerprint.range_of(rows, starts).collect()
    assert sorted((x.k, x.r) for x in got) == sorted((i, int(j)) for i, j in want)


def test_fingerprints_plan_at_twenty_thousand_partitions(spark):
    docs = frame(spark, [(k, f"text {k}") for k in range(30_000)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = tuples(fingerprint.fingerprints(docs).where("doc_id % 1000 = 0"), "doc_id", "near_next", "edited_sha256")
    spark.conf.set("spark.sql.shuffle.partitions", "20000")
    try:
        plan = fingerprint.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(want) == 30 and len(plan) < 2_000_000


# --- packing

LONG = [" " * 1_000_000, "\n" * 300_000 + "x", "a" + " \t" * 100_000 + "b c", "z" * 1_000_000, "word " + " " * 60_000 + "word"]


def test_packing_of_very_long_runs(spark):
    rows = [(k, t) for k, t in enumerate(LONG)]
    packed = packing.pack_tokens(frame(spark, rows), RANK_VOCABULARY, length=2048).collect()
    got = {k: [] for k, _ in rows}
    for row in packed:
        ids = np.frombuffer(row.ids, "<u4")
        for doc, first, a, z in zip(row.doc_ids, row.first_tokens, row.cu_seqlens, row.cu_seqlens[1:]):
            got[doc].append((first, ids[a:z].tolist()))
    table = bpe.PieceTable(bpe.MergeTable.load(JSON_VOCABULARY))
    for k, text in rows:
        ids = [x for _, part in sorted(got[k]) for x in part]
        assert ids == np.frombuffer(bpe.encode(table, text), "<u4").tolist()
        assert "".join(bpe.decode(table.merges, np.array(ids, "<u4").tobytes())) == text


def test_merge_list_of_ranks_is_the_tokenizers_own():
    ranks = packing.load_ranks(RANK_VOCABULARY)
    own, given = packing._rank_table(RANK_VOCABULARY).merges, bpe.MergeTable.load(JSON_VOCABULARY)
    assert own.rank == given.rank and own.made == given.made and len(own.rank) + 256 == len(ranks)


# --- decontamination


def found(spark, rows, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return tuples(decontaminate.find_leaks(frame(spark, rows), bench, **options), "doc_id", "item_id", "first_word", "n_words", "similarity")


def brute(rows, items):
    out = []
    for i, text in rows:
        w = decontaminate.words_of(text)
        for item, held in items:
            v = decontaminate.words_of(held)
            if not w or not v:
                continue
            m = min(len(v), len(w))
            cut = lambda x: Counter(tuple(x[a:a + 5]) for a in range(len(x) - 4)) if len(x) >= 5 else Counter([tuple(x)])
            best = max((round(decontaminate.similarity(cut(w[a:a + m]), cut(v)), 9), -a) for a in range(len(w) - m + 1))
            if best[0] >= 0.8:
                out.append((i, item, -best[1], m, best[0]))
    return sorted(out, key=str)


def test_items_of_several_sizes_are_judged_by_their_own_windows(spark):
    a = [f"w{k}" for k in range(20)]
    items = [(1, " ".join(a)), (2, " ".join(a[:17])), (None, " ".join(a[3:])), (4, "w0 w1 w2"), (5, None), (6, " ")]
    rows = [(10, "some filler here " + " ".join(a[:17]) + " and more filler"), (11, " ".join(a)), (12, " ".join(a[:19])),
            (13, "x " * 5 + " ".join(a[1:]) + " y" * 30), (14, "w0 w1 w2"), (15, "a w0 w1 w2 b")]
    for size in (1 << 20, 100):
        got = [(*t[:4], round(t[4], 9)) for t in found(spark, rows, items, item_bytes=size)]
        assert got == brute(rows, items)
    bench = spark.createDataFrame([(None, " ".join(a))], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.drop_leaks(frame(spark, rows), bench).orderBy("doc_id").collect()] == [10, 14, 15]


def test_recall_of_the_index_over_ten_thousand_edits():
    """Edits that leave a similarity of 0.8 or more: how many lie within the radius and are found; what the index touches."""
    r, items = random.Random(9), []
    for k in range(400):
        items.append((k, prose(k, r.randint(6, 60), 3000)))
    held = decontaminate.Items.of(items)
    pairs = met = touched = 0
    table = common.WordHash()
    while pairs < 10_000:
        i = r.randrange(len(items))
        words = decontaminate.words_of(items[i][1])
        for _ in range(r.randint(0, max(1, len(words) // 25))):
            words[r.randrange(len(words))] = f"new{r.randrange(10 ** 6)}"
        g = decontaminate.shingles(table.array([w.encode() for w in words]))
        if decontaminate.similarity(Counter(g.tolist()), held.shingles[i]) < 0.8:
            continue
        pairs += 1
        fp = int(decontaminate.simhash_windows(decontaminate.bit_sums(g), np.zeros(1, np.int64), np.array([len(g)]))[0])
        near = held.candidates(fp, len(words))
        met += i in near
        touched += len(np.unique(np.concatenate([held.table.get((len(words), b, fp >> 8 * b & 255), near[:0]) for b in range(8)])))
    print(f"recall {met / pairs:.4f}, touched {touched / pairs / len(items):.4f} of all items")
    assert met / pairs >= 0.99 and touched / pairs / len(items) < 0.1


def test_decontamination_of_a_very_long_text(spark, monkeypatch):
    item = prose(3, 40)
    text = prose(5, 300_000) + " " + item + " " + prose(6, 100_000)
    items = decontaminate.Items.of([(1, item)])
    began = time.time()
    got = decontaminate.leaks(text, items, common.WordHash())
    assert [(i, n, s) for i, _, n, s in got] == [(1, 40, 1.0)] and got[0][1] == 300_000 and time.time() - began < 30


# --- toxicity


def test_lexicon_keeps_every_term_that_passes(spark):
    r = random.Random(8)
    terms = ["".join(r.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(2000)]
    rows = [(k, prose(k, 20) + " " + " ".join(terms[(7 * k + j) % 2000] for j in range(20)), 1) for k in range(2000)]
    rows += [(5000 + k, prose(7000 + k, 25), 0) for k in range(2000)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    entries = toxicity.learn_lexicon(sample, 2000, 2000)
    assert {t for t in terms} <= {u for u, beginning, _ in entries if not beginning}


def test_many_quotation_marks_take_time_in_proportion():
    lexicon = toxicity.Matches(toxicity.Lexicon([("idiot", False, 2.0)]))
    took = []
    for n in (10_000, 100_000):
        began = time.time()
        toxicity.features('"a" idiot ' * n, lexicon)
        took.append(time.time() - began)
    assert took[1] < 30 * took[0] + 1


def test_logistic_fit_doesnt_overshoot():
    """Features as a large lexicon gives them: nearly separable, on scales that let plain Newton steps run away."""
    r = np.random.default_rng(3)
    y = (r.uniform(size=4000) < 0.1).astype(float)
    strong = np.where(y == 1, r.uniform(6, 9, 4000), np.where(r.uniform(size=4000) < 0.02, r.uniform(4, 6, 4000), 0.0))
    x = np.c_[strong > 0, strong, np.log1p(3 * strong), r.uniform(size=4000) < 0.3, r.uniform(0, 4, 4000), 30 * strong * (r.uniform(size=4000) < 0.5)]
    w = toxicity.logistic_fit(x, y, counts=np.where(y == 1, 1.0, 3.0))
    p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))
    assert ((p >= 0.5) == (y == 1)).mean() > 0.999
    gradient = np.c_[x, np.ones(4000)].T @ (np.where(y == 1, 1.0, 3.0) * (p - y)) + np.r_[np.full(6, 1e-2), 1e-6] * w
    assert np.abs(gradient).max() < 1e-2


def test_toxicity_with_a_large_lexicon_tells_held_out_rows_apart(spark):
    r = random.Random(4)
    terms = ["".join(r.choices("bcdfghjklmnpqrstvwxz", k=8)) for _ in range(600)]
    rows = [(k, prose(k, 30) + (" " + " ".join(r.sample(terms, 12)) + " you" if k % 10 == 0 else "")) for k in range(5000)]
    labels = spark.createDataFrame([(k, 0, int(k % 10 == 0)) for k, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(frame(spark, rows), labels).where("held_out").collect()
    assert sum(x.predicted != int(x.doc_id % 10 == 0) for x in got) <= 0.01 * len(got)


# --- lines


def test_lines_of_a_very_long_text(spark):
    line = "a log line that is long enough to be compared"
    rows = [(1, f"{line}\n" * 300_000 + "end"), (2, "other\n\n" + line), (3, None)]
    began = time.time()
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert (got[1].kept_text, got[1].n_lines, got[1].n_dropped) == (f"{line}\nend", 300_001, 299_999)
    assert got[2].kept_text == "other\n" and got[3].kept_text is None and time.time() - began < 60
    kept = {r.doc_id: r.text for r in linededup.strip_lines(frame(spark, rows)).collect()}
    assert kept == {1: f"{line}\nend", 2: "other\n", 3: None}
