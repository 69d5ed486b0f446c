"""Whitening, chat formatting and ranked search, against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cases import CLASHES, ODD_ROWS, frame, prose, tuples
from tripflow.llm import chat, common, search, whitening


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    common.prepare(spark)


# --- whitening


def vectors(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return df.withColumns({c: F.lit(None).cast("string") for c in (*CLASHES, "v", "component", "n")}) if clash else df


def brute_whitening(rows, most):
    kept = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit), n ** 3))
                     for b in range(d)] for a in range(d)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for i, x in kept:
        far = sum((n * x[j] - s[j]) ** 2 for j in range(d))
        y = np.array([float(Fraction(n * x[j] - s[j], n)) for j in range(d)]) @ v / np.sqrt(e)
        out += [(i, k + 1, n, far, y[k], e[k] / e.sum()) for k in range(min(most, d))]
    return out


@pytest.mark.parametrize("d, copies", [(5, 1), (20, 3)])
def test_whitening_against_fractions(spark, d, copies):
    r = random.Random(d)
    mix = [[r.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    rows = [(k, [sum(m * g for m, g in zip(line, [r.gauss(3, 1) for _ in range(d)])) for line in mix]) for k in range(90)]
    rows += [(1000 + k, rows[0][1]) for k in range(60 * copies)] + [(7, rows[3][1])]
    bad = [(500, None), (501, [1.0] * (d - 1) + [None]), (502, [math.nan] * d), (503, [1.0] * (d - 1) + [-math.inf]),
           (504, []), (505, [2.0] * (d + 1))]
    got = whitening.whiten(vectors(spark, rows + bad, True), most=16).collect()
    want = brute_whitening(rows, 16)
    key = lambda t: (t[0], t[3], t[1])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [t[:4] for t in got] == [t[:4] for t in want] and all(t[4] == str(t[3]) for t in got)
    mine = np.array([t[5] for t in got]).reshape(-1, min(16, d))
    other = np.array([t[4] for t in want]).reshape(-1, min(16, d))
    sign = np.sign((mine * other).sum(axis=0))
    assert np.allclose(mine, other * sign, rtol=1e-7, atol=1e-9)
    assert np.allclose([t[6] for t in got], [t[5] for t in want], rtol=1e-9)
    assert len({t[7] for t in got}) == 1 and got[0][7] < 1e-9


def test_whitening_odd_inputs(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [math.nan])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, 0.0)}
    assert {r.vec_id for r in one} == {1, None}
    # Values so far apart that squares exceed 64 bits: exact all the same.
    far = [(1, [1e16, 2.0]), (2, [-1e16, 5.0]), (3, [0.0, 0.5]), (4, [1e300, 1.0])]
    got = {r.vec_id: r for r in whitening.whiten(vectors(spark, far)).where("component = 1").collect()}
    want = {t[0]: t[3] for t in brute_whitening(far[:3], 2)}
    assert {i: int(r.deviation_exact) for i, r in got.items()} == want and got[1].deviation is None
    assert got[3].deviation == (want[3] if want[3] < 1 << 63 else None)


def test_whitening_lengths_that_clash_and_a_flat_dimension(spark):
    rows = [(k, [float(k), 1.0]) for k in range(5)] + [(10 + k, [float(k)] * 3) for k in range(5)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.vec_id for r in got} == set(range(5))  # equally common lengths: the shortest
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in got} == {(1, False, 1.0), (2, True, 0.0)}


def test_plain_sums_of_wide_values(spark):
    r = random.Random(0)
    x = [[r.randrange(-(1 << 62), 1 << 62) for _ in range(3)] for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(4)
    assert whitening._sums(df, whitening._plain_sums) == {(3, 0): (500, [sum(v[j] for v in x) for j in range(3)])}


# --- chat formatting


def chats(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    return df.withColumns({c: F.lit(None).cast("string") for c in (*CLASHES, "turns", "t", "starts", "mask")}) if clash else df


def brute_chat(rows):
    t, groups = chat.DEFAULT, {}
    for c, k, role, text in rows:
        groups.setdefault(c, []).append(((k is not None, k or 0), role or "", text or ""))
    esc = lambda s: re.sub(t.pattern(False), r"\1~\2\3", s)
    out = []
    for c, turns in groups.items():
        turns.sort()
        whole, before = "", None
        for k, (_, role, text) in enumerate(turns):
            if k and role == before:
                whole += t.more
            else:
                whole += (t.close if k else t.begin) + dict(t.opens).get(role, t.role + esc(role) + t.text)
            whole, before = whole + esc(text), role
        loss = "".join(text for _, role, text in turns if role == "assistant")
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), len(whole + t.close)))
    return sorted(out, key=str)


BITS = ["<s>", "</s>", "[INST]", "[/INST]", "[NEXT]", "[ROLE]", "[TEXT]", "[SYS]", "<~/s>", "[~~INST]", "<", "[", "~", "s>",
        "INST]", "/", "\n", "é", "😀", " ok ", "$1", "\\", ""]
ROLES = ["user", "assistant", "system", "tool", "a[TEXT]b", "", None]
COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def odd_chats():
    r = random.Random(12)
    text = lambda: r.choice([None, "".join(r.choices(BITS, k=r.randint(0, 9)))])
    rows = [(r.choice([None, -7, *range(40)]), r.choice([None, *range(6)]), r.choice(ROLES), text()) for _ in range(600)]
    return rows + rows[:25]


def test_chat_against_brute_force_and_sql(spark):
    rows = odd_chats()
    got = tuples(chat.digest(chat.format_conversations(chats(spark, rows, True))), *COLUMNS)
    assert got == brute_chat(rows)
    told = chats(spark, rows).toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    with_probe = chat.digest(chat.format_conversations(chat.with_probe(spark, chats(spark, rows))))
    assert tuples(with_probe, *COLUMNS) == sorted(con.execute(chat.oracle()).fetchall(), key=str)


def test_chat_turns_and_mask_read_back(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", "a"), (1, 3, "assistant", ""), (1, 4, "tool~[TEXT]", "[NEXT]x")]
    made = chat.format_conversations(chats(spark, rows))
    one = made.first()
    assert one.formatted == "<s>[INST]a</s>[/INST]b<~/s>[NEXT]</s>[ROLE]tool~[~TEXT][TEXT][~NEXT]x</s>"
    at, under = 0, []
    for run in one["mask"]:
        under += [one.formatted[at:at + run.chars]] if run.loss else []
        at += run.chars
    assert at == len(one.formatted) and under == ["b<~/s>", ""]
    back = chat.read_back(made).first()
    assert [tuple(x) for x in back.turns] == [("user", "a"), ("assistant", "b</s>"), ("assistant", ""), ("tool~[TEXT]", "[NEXT]x")]
    assert back.loss_texts == ["b</s>", ""]
    torn = made.withColumn("mask", F.slice("mask", 2, 3))
    assert chat.read_back(torn).first().loss_texts is None


def test_chat_runs_without_python_and_on_empty_tables(spark):
    made = chat.digest(chat.format_conversations(chats(spark, [])))
    assert made.count() == 0
    plan = chat.digest(chat.format_conversations(chat.with_probe(spark, spark.read.parquet(
        "/root/testdata/sf0.001/conversations.parquet"))))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_chat_of_many_turns_and_of_one_very_long_text(spark):
    rows = [(1, k, ROLES[k * 7919 % 5], BITS[k % 20]) for k in range(30_000)] + [(2, 0, "user", "<" + "~" * 1_000_000)]
    assert tuples(chat.digest(chat.format_conversations(chats(spark, rows))), *COLUMNS) == brute_chat(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>[]/~sINSTEXTROL\n", max_size=40))
def test_escaping_leaves_no_control_string_and_is_undone(text):
    t = chat.DEFAULT
    held = re.sub(t.pattern(False), r"\1~\2\3", text)
    assert not any(c in held for c in t.controls) and re.sub(t.pattern(True), r"\1\2\3", held) == text


def test_templates_that_could_not_be_read_back():
    for bad in ({"begin": "s"}, {"close": "<a<b>"}, {"more": "[~]"}, {"begin": "<s>", "close": "<s>"}, {"role": "[TEXT]x"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


# --- ranked search

TERM = re.compile(search.TERM_PATTERN)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, most=10):
    words = lambda t: TERM.findall((t or "").translate(LOW))
    told = [(i, Counter(w)) for i, t in docs if (w := words(t))]
    n_docs, n_terms = len(told), sum(sum(c.values()) for _, c in told)
    df = Counter(w for _, c in told for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in told:
            n = sum(c.values())
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 8 * m))
                        for w in set(words(text)) if w in c)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, k + 1, e[3], -e[0]) for k, e in enumerate(sorted(found)[:most])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard_docs": 40, "block": 4, "window": 16, "query_bytes": 300}])
def test_search_against_brute_force(spark, sizes):
    r = random.Random(5)
    base = [prose(3 * k, r.randint(1, 60), 90) for k in range(150)]
    docs = [(k, f"{r.choice(base)} {r.choice(base)}") for k in range(260)] + [(400 + k, base[0]) for k in range(40)]
    docs += [*ODD_ROWS, (20, "Zürich ZÜRICH zürich-İ x1_x2"), (21, "K k ﬁ")]
    items = [(k, r.choice(base)) for k in range(14)] + [(3, base[0]), (None, "word mixed ZÜRICH x1"), (50, None), (51, ""),
                                                       (52, "nowhere-to-be-found"), (53, "word"), (53, "word")]
    got = search.ranked(frame(spark, docs, True), spark.createDataFrame(items, "item_id long, text string"), **sizes)
    assert tuples(got, "item_id", "rank", "doc_id", "score") == brute_search(docs, items)


def test_search_skips_blocks_without_opening_them(spark):
    docs = [(k, "common " * (1 + k % 3) + ("rare gem" if k % 400 == 7 else f"w{k % 50} x{k % 7}")) for k in range(4000)]
    df = frame(spark, docs).coalesce(1)
    terms = [b"common", b"rare", b"gem"]
    index = search.build_index(df, terms, block=32)
    corpus = search.corpus_of(index, 3)
    assert (corpus.docs, corpus.df.tolist()) == (4000, [4000, 10, 10])
    shard = search.Shard(index.first().asDict(), corpus, corpus.weights())
    heap = []
    shard.search([0, 1, 2], heap, 5, 500)
    assert len(shard.opened) < shard.first[-1] / 3
    got = sorted((-s, d[1]) for s, _, _, d in heap)
    want = [(-s, i) for _, _, i, s in sorted(brute_search(docs, [(0, "common rare gem")], 5), key=lambda t: t[1])]
    assert got == want


def test_search_empty_tables_and_long_texts(spark):
    item = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert search.ranked(frame(spark, []), item).count() == 0
    assert search.ranked(frame(spark, [(1, "alpha")]), item.limit(0)).count() == 0
    docs = [(1, "alpha " * 600_000 + "y" * 2_000_000 + " beta"), (2, "beta, alpha"), (3, None)]
    assert tuples(search.ranked(frame(spark, docs), item), "item_id", "rank", "doc_id", "score") == brute_search(docs, [(1, "alpha beta")])


def test_competitive_pairs_give_the_block_maximum():
    r = np.random.default_rng(1)
    block, tf, n = np.repeat(np.arange(40), 25), r.integers(1, 9, 1000), r.integers(1, 400, 1000)
    corpus = search.Corpus(1000, 90_000, np.array([1]))
    best = search.competitive(block, tf, n)
    points = corpus.impact(tf, n)
    for b in range(40):
        assert points[block == b].max() == points[best[block[best] == b]].max()
    assert len(best) < 400
