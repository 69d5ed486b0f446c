"""Operators over the whole corpus: substrings, SimHash, lines; learned scores; the pipeline."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from cases import CLASHES, ODD_ROWS, frame, prose, tuples
from tripflow.llm import common, linededup, quality, simhash, substring, toxicity


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    common.prepare(spark)


# --- shared helpers


def test_pack_ints_round_trip():
    for a in ([], [5], [-(1 << 63), (1 << 63) - 1, 0], [0, 255], [0, 256], [-5, 70_000], [-1, 1 << 33]):
        a = np.array(a, np.int64)
        assert (common.unpack_ints(common.pack_ints(a)) == a).all()


def test_connected_components_on_a_long_path_and_a_star(spark):
    r = random.Random(2)
    names = r.sample(range(-10_000, 10_000), 400)
    edges = [(names[k], names[k + 1]) for k in range(149)] + [(names[200], names[k]) for k in range(201, 390)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {x: min(names[:150]) for x in names[:150]} | {x: min(names[200:390]) for x in names[200:390]}


# --- substrings


def brute_substrings(rows, size=13):
    least = {}
    for i, t in rows:
        words = substring.words_of(t)
        for j in range(len(words) - size + 1):
            key = tuple(words[j:j + size])
            i_ = -(1 << 63) if i is None else i
            least[key] = min(least.get(key, i_), i_)
    out = []
    for i, t in rows:
        words = substring.words_of(t)
        away = [False] * len(words)
        for j in range(len(words) - size + 1):
            if least[tuple(words[j:j + size])] < (-(1 << 63) if i is None else i):
                away[j:j + size] = [True] * size
        kept = b" ".join(w for w, x in zip(words, away) if not x)
        out.append((i, len(words), sum(away), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_substrings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK", block)
    r = random.Random(4)
    shared = [prose(900 + k, r.randint(10, 60)) for k in range(8)]
    rows = list(ODD_ROWS)
    for k in range(120):
        parts = [prose(k, r.randint(0, 40)), r.choice(shared), prose(1000 + k, r.randint(0, 30)), r.choice(shared)[5:]]
        rows.append((k % 70 + 100, "  ".join(parts[r.randint(0, 1):])))
    rows += [(500 + k, "the same " * 12) for k in range(40)]
    got = substring.dedup_substrings(frame(spark, rows, True))
    assert tuples(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


def test_substrings_kept_text_and_repeats(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, f"a {passage} b"), (2, f"c {passage} d {passage} e"), (3, "")]
    got = {r.doc_id: r for r in substring.dedup_substrings(frame(spark, rows), keep_text=True).collect()}
    assert (got[2].kept_text, got[2].n_removed, got[2].n_repeats) == ("c d e", 40, 2) and got[1].n_removed == 0
    assert substring.dedup_substrings(frame(spark, [])).count() == 0


# --- SimHash


def brute_simhash(rows, size=3, radius=2):
    fps = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        s = [b" ".join(words[j:j + size]) for j in range(len(words) - size + 1)] if len(words) >= size else (
            [b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return fps, brute_components(fps, radius)


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    return [find(x) for x in range(len(fps))]


def test_simhash_against_brute_force(spark):
    r = random.Random(8)
    rows = list(ODD_ROWS)
    for k in range(15):
        words = prose(k, 150).split()
        for _ in range(6):
            words[r.randrange(len(words))] = "Edit"
            rows.append((100 + len(rows), " ".join(words)))
    fps, root = brute_simhash(rows)
    low = {}
    for (i, _), x in zip(rows, root):
        if i is not None:
            low[x] = min(low.get(x, i), i)
    got = simhash.near_duplicates(frame(spark, rows, True))
    want = sorted(((i, f"{fp:016x}", low.get(x)) for (i, _), fp, x in zip(rows, fps, root)), key=str)
    assert tuples(got, "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(frame(spark, rows, True))
    assert kept.count() == len(set(root)) and set(CLASHES) < set(kept.columns)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, [])).count() == 0


def test_gray_index_finds_every_group(spark, monkeypatch):
    """Dense balls, long chains and far points, over many nodes."""
    monkeypatch.setattr(simhash, "NODE_LEAST", 8)
    r = random.Random(6)
    fps = {r.getrandbits(64) for _ in range(500)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(4):
        c = r.getrandbits(64)
        fps |= {c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)}
        for _ in range(60):
            c ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            fps.add(c)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").repartition(4)
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in map(tuple, simhash.links_within(df, 2).collect())]
    assert all((a ^ b).bit_count() <= 64 for a, b in edges) and len(edges) < 4 * len(fps)
    want, at = brute_components(fps, 2), {x: k for k, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        root[find(at[a])] = find(at[b])
    got = [find(k) for k in range(len(fps))]
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(got)) == len(set(want))


def test_tree_search_loses_nothing():
    r = np.random.default_rng(1)
    fps = np.unique(r.integers(0, 1 << 20, 700, dtype=np.uint64))
    node = simhash.Node(fps)
    q = r.integers(0, 1 << 20, 90, dtype=np.uint64)
    qi, at = node.pairs(q, 3)
    got = sorted(zip(qi.tolist(), node.fps[at].tolist()))
    assert got == sorted((i, int(x)) for i, y in enumerate(q) for x in fps if int(x ^ y).bit_count() <= 3)


# --- lines


def brute_lines(rows, least):
    def key(i):
        return -(1 << 63) if i is None else i
    first = {}
    uniq = {(i, t) for i, t in rows}
    for i, t in sorted(uniq, key=lambda r: key(r[0])):
        for no, line in enumerate(linededup.lines_of(t)):
            if line.strip():
                place = (key(i), no, simple_hash(t))
                first[line] = min(first.get(line, place), place)
    gone = {a for a in first for b in first if a != b and len(a) >= least and len(b) >= least and first[b] < first[a]
            and linededup.within_one(a, b)}
    out = []
    for i, t in rows:
        own = linededup.lines_of(t)
        kept = [x for no, x in enumerate(own) if not x.strip()
                or (x not in gone and first[x] == (key(i), no, simple_hash(t)))]
        text = t if len(kept) == len(own) else "\n".join(kept)
        out.append((i, len(own), len(own) - len(kept), text))
    return sorted(out, key=str)


def simple_hash(t):
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_lines_against_brute_force(spark):
    r = random.Random(12)
    lines = [prose(k, 5) for k in range(40)] + ["ab", "ac", "a", "", "  ", "x" * 25, "x" * 26, "x" * 24, "é" * 30, "é" * 29 + "e"]
    def edit(s):
        k, c = r.randrange(len(s) + 1), r.choice("abé ")
        return r.choice([s[:k] + c + s[k:], s[:k] + s[k + 1:], s[:k] + c + s[k + 1:]])
    rows = list(ODD_ROWS)
    for k in range(90):
        own = [r.choice(lines) for _ in range(r.randint(0, 6))]
        rows.append((r.randint(20, 80), "\n".join(edit(x) if r.random() < 0.5 else x for x in own)))
    rows += [(90 + k, "item %s of a numbered list of lines" % "abcdefghij"[k]) for k in range(10)]
    got = linededup.dedup_lines(frame(spark, rows, True), min_chars=10)
    assert tuples(got, "doc_id", "n_lines", "n_dropped", "kept_text") == brute_lines(rows, 10)
    whole = linededup.strip_lines(frame(spark, rows, True), min_chars=10)
    assert set(whole.columns) == {"doc_id", "text", *CLASHES}
    assert tuples(whole, "doc_id", "text") == sorted(((i, t) for i, _, _, t in brute_lines(rows, 10)), key=str)
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_variants_are_deletions():
    for line in ("", "a", "abcabc", prose(1, 30)):
        whole, parts = linededup.variant_hashes(line) if line else (None, [])
        for k, h in enumerate(parts):
            shorter = line[:k] + line[k + 1:]
            if shorter:
                assert linededup.variant_hashes(shorter)[0] == h
    assert linededup.within_one("abc", "abd") and linededup.within_one("ab", "abc") and not linededup.within_one("abc", "cab")


# --- learned scores


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    return (order[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize("score,label,cut", [(toxicity.score_toxicity, "toxic", 0.5), (quality.score_quality, "quality", 0.3)])
def test_held_out_accuracy(spark, score, label, cut):
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    known = {r.doc_id: r[label] for r in labels.collect()}
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= cut) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    y, s = np.array([known[r.doc_id] for r in held]), np.array([r.score for r in held])
    assert auc(s, y) > 0.95 and ((s >= cut) == y).mean() > 0.97


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_scores_on_odd_tables(spark, score):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = score(frame(spark, ODD_ROWS, True), labels).collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert score(frame(spark, ODD_ROWS), labels.limit(0)).count() == len(ODD_ROWS)
    assert score(frame(spark, []), labels).count() == 0


def test_levenshtein_automaton_against_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    entries = [("stupid", False, 3.0), ("scum", False, 2.0), ("worthless", False, 4.0), ("lowei", True, 5.0), ("vequant", True, 6.0)]
    lexicon, r = toxicity.Lexicon(entries), random.Random(1)
    words = ["stupid", "scum", "scam", "stupd", "sttupid", "worthles", "wortless", "loweiten", "loweten", "vequantum", "vquantum", "xx"]
    words += ["".join(r.choices("stupidworhlevqan", k=r.randint(1, 9))) for _ in range(400)]
    for text, *_ in entries:
        for _ in range(60):
            k, c = r.randrange(len(text)), r.choice("aeistx")
            words.append(r.choice([text[:k] + c + text[k + 1:], text[:k] + text[k + 1:], text[:k] + c + text[k:]]) + r.choice(["", "ab"]))
    for w in words:
        exact, fuzzy = 0.0, 0.0
        for text, beginning, weight in entries:
            heads = [w[:k] for k in range(len(w) + 1)] if beginning else [w]
            d = min(distance(text, h) for h in heads)
            if d == 0:
                exact = max(exact, weight)
            if d <= 1 and len(text) >= toxicity.FUZZY_LEAST and any(distance(text, h) == 1 for h in heads):
                fuzzy = max(fuzzy, weight)
        got = lexicon.find(w)
        assert got[0] == exact and (exact or got[1] == fuzzy), w


def test_quotation_scores_below_abuse():
    matches = toxicity.Matches(toxicity.Lexicon([("idiot", False, 5.0)]))
    abuse, quoted, report = (toxicity.features(t, matches)[1] for t in (
        "you are an idiot", 'the word "idiot" stands there', "he said idiot and left"))
    assert abuse > 5 > report and quoted < report


def test_bradley_terry_orders_pairs():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, len(quality.NAMES)))
    y = (x[:, 0] - 0.5 * x[:, 3] > -1).astype(int)
    model = quality.fit_pairs(x, y)
    assert auc(model.latent(x), y) > 0.98 and ((model.scores(x) >= quality.CUT) == y).mean() > 0.95
    assert abs(model.quantile - (1 - y.mean())) < 0.05


# --- pipeline


def test_pipeline_stages_against_brute_force(spark):
    import __spark_entry__ as E
    import corpus_pipeline as C
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in C.STAGES:
        out = stage(spark, before, sf).checkpoint()
        kept[name] = before, out
        before = out
        assert name == "bpe" or out.columns == columns
    a, b = kept["line_dedup"]
    want = brute_lines([(r.doc_id, r.text) for r in a.collect()], linededup.MIN_CHARS)
    assert tuples(b, "doc_id", "text") == sorted(((i, t) for i, _, _, t in want), key=str)
    assert b.where("n_chars <> length(text)").count() == 0
    a, b = kept["simhash_dedup"]
    rows = sorted((r.doc_id, r.text) for r in a.collect())
    root = brute_simhash(rows)[1]
    low = {}
    for (i, _), x in zip(rows, root):
        low[x] = min(low.get(x, i), i)
    assert tuples(b, "doc_id") == sorted(((i,) for i in low.values()), key=str)
    last = kept["bpe"][1]
    assert last.where("n_tokens <> size(ids)").count() == 0
    assert tuples(last, "doc_id") == tuples(kept["decontamination"][1], "doc_id")
    whole = E.queries()["pipeline"](spark, sf)
    assert tuples(whole, "doc_id", "ids_sha256") == tuples(last, "doc_id", "ids_sha256")


def test_stages_take_odd_tables(spark):
    import corpus_pipeline as C
    rows = frame(spark, ODD_ROWS, True).withColumn("lang", common.F.lit(None).cast("string")).withColumn("n_chars", common.F.lit(3))
    for name, stage in C.STAGES:
        assert stage(spark, rows, "/root/testdata/sf0.001").count() <= len(ODD_ROWS)
        assert stage(spark, rows.limit(0), "/root/testdata/sf0.001").count() == 0


def test_licence_oracle(spark, duck):
    import __spark_entry__ as E
    got = E.queries()["op4_licence_scan"](spark, "/root/testdata/sf0.001")
    cols = ["doc_id", "digest", "licence", "n_notice_lines", "notices"]
    assert tuples(got, *cols) == sorted(duck.sql(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()['op4_licence_scan']})").fetchall(), key=str)


def test_a_repeated_id_teaches_once(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    docs = frame(spark, [(k, f"text {k}") for k in ids] + [(ids[0], f"a copy {k}") for k in range(500)] + [(ids[1], None)] * 50)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] * 2, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.labelled_sample(docs, labels, "toxic").collect()}
    assert sorted(got) == ids and got[ids[0]]["text"] == "a copy 0" and got[ids[1]]["text"] == f"text {ids[1]}"
    assert toxicity.labelled_sample(docs, labels, "toxic").count() == len(ids)
    assert toxicity.labelled_sample(docs, labels, "toxic", most=20).count() == 20


def test_a_sample_half_toxic_teaches_as_well(spark, monkeypatch):
    """Large inputs fill both halves of the sample: the lexicon mustn't depend on the sample's toxic share."""
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    monkeypatch.setattr(toxicity, "labelled_sample", functools.partial(toxicity.labelled_sample, most=600))
    model = toxicity.fit_toxicity(docs, labels)
    assert model.entries
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda *a: model)
    known = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    held = [(known[r.doc_id], r.predicted) for r in toxicity.score_toxicity(docs, labels).collect() if r.held_out and r.doc_id in known]
    assert sum(p for y, p in held if y) > 0.8 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) < 0.03 * sum(not y for y, _ in held)


def test_scores_keep_the_labels_rates_when_the_sample_is_cut(spark, monkeypatch):
    """A word of half the toxic and a tenth of the clean texts: 5 in 13 of its texts are toxic, in a sample of halves 5 in 6."""
    r = random.Random(3)
    toxic = [k % 9 == 0 for k in range(2700)]
    docs = frame(spark, [(k, f"{prose(k, 12)}{' vexing' * (r.random() < (0.5 if y else 0.1))}") for k, y in enumerate(toxic)])
    labels = spark.createDataFrame([(k, int(y)) for k, y in enumerate(toxic)], "doc_id long, toxic int")
    whole, sampled = toxicity.fit_toxicity(docs, labels), toxicity.labelled_sample
    monkeypatch.setattr(toxicity, "labelled_sample", functools.partial(sampled, most=400))
    cut = toxicity.fit_toxicity(docs, labels)
    for model in whole, cut:
        assert "vexing" in {e[0] for e in model.entries}
        with_word, without = model.scores([f"{prose(7, 12)} vexing", prose(7, 12)], toxicity.Matches(toxicity.Lexicon(model.entries)))
        assert 0.25 < with_word < 0.5 and without < 0.12
    counts = dict(sampled(docs, labels, "toxic", most=400).groupBy("label").agg(common.F.sum("stands_for")).collect())
    known = [y for k, y in enumerate(toxic) if zlib.crc32(str(k).encode()) % 5]
    assert abs(counts[1] - sum(known)) < 1e-6 and abs(counts[0] - known.count(False)) < 1e-6


def test_logistic_fit_counts_rows():
    r = np.random.default_rng(2)
    x, y, n = r.normal(size=(60, 2)), (r.random(60) < 0.4).astype(float), r.integers(1, 5, 60)
    assert np.allclose(toxicity.logistic_fit(x, y, counts=n.astype(float)), toxicity.logistic_fit(np.repeat(x, n, 0), np.repeat(y, n)))


def test_drop_toxic_drops_what_scores_high(spark):
    import corpus_pipeline as C
    sf = "/root/testdata/sf0.1"
    docs, labels = (common.table(spark, sf, t) for t in ("documents", "labels"))
    kept = dict(C.STAGES)["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns
    low = toxicity.score_toxicity(docs, labels).where("score < 0.5").select("doc_id")
    got = tuples(kept, "doc_id")
    assert got == tuples(low, "doc_id")
    left, ids = {i for i, in got}, {r.doc_id for r in docs.select("doc_id").collect()}
    known = [(r.toxic, r.doc_id in left) for r in labels.where("toxic is not null").collect() if r.doc_id in ids]
    assert sum(k for y, k in known if y) < 0.1 * sum(y for y, _ in known)
    assert sum(not k for y, k in known if not y) < 0.02 * sum(not y for y, _ in known)


@pytest.mark.parametrize("n_good,n_poor", [(7919, 900), (2 * 7919, 2000), (3000, 20), (1, 3)])
def test_each_good_row_is_in_a_pair(monkeypatch, n_good, n_poor):
    r, fit, met = np.random.default_rng(1), quality.logistic_fit, []
    x, y = r.normal(size=(n_good + n_poor, len(quality.NAMES))), np.r_[np.ones(n_good, int), np.zeros(n_poor, int)]
    x[n_good:] = 0
    monkeypatch.setattr(quality, "logistic_fit", lambda a, *b, **k: met.append(a) or fit(a, *b, **k))
    quality.fit_pairs(x, y)
    pairs = met[0][:len(met[0]) // 2]
    assert len(np.unique(pairs, axis=0)) == n_good
