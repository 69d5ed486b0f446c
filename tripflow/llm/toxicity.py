"""Toxicity by a learned lexicon, matched with Levenshtein automata, and scores of the matches' contexts.

Learning.  From a bounded sample of labelled rows, words and word beginnings that stand in toxic texts far more often
than chance allows become the lexicon, each with its log-odds as weight.  A logistic regression over a few
sums of match scores then gives the probability.

Matching.  The lexicon is a trie.  Reading a word, the Levenshtein automata of all entries run at once over the trie:
a state is the set of (trie node, edits so far), states are built when first met and kept, and a word leaves as soon
as its state is empty, so that most words cost a few look-ups.  Long entries allow one edit, short ones none.

Context.  A match scores its weight, lowered inside quotation marks and near words of report (quotation), raised near
words of address (abuse); the window is ``WINDOW`` words either side.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripflow.llm.common import as_docs, crc_mod

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
SAMPLE_ROWS = 20_000   # most labelled rows that learning reads
STEMS = (4, 5, 6, 7)   # lengths of word beginnings that can become entries
MIN_SUPPORT = 3        # toxic texts an entry must stand in
LEAST_RATIO = 4        # an entry's share of the toxic texts is at least so many times its share of the clean ones
CHANCE = 1e-4          # an entry's support may be chance with at most this probability
FUZZY_LEAST = 4        # entries of so many characters and more allow one edit: of three letters too little would be left
WINDOW = 8
# Words of report and of address in the languages of the corpus.
REPORT = frozenset("said says wrote quote quoted quotes called calls slur term word insult report reported "
                   "dit écrit cité mot sagte schrieb zitat zitiert wort dijo escribió citó palabra".split())
ADDRESS = frozenset("you your you're youre yourself u ur du dich dir dein tu toi te ton vous eres tú ti usted".split())
QUOTES = re.compile("[\"“”„«»]")
QUOTED, REPORTED, ADDRESSED = 0.4, 0.5, 1.5
FEATURES = 9


@dataclass
class Lexicon:
    """Entries (word or beginning, is_beginning, weight) as a trie with the automaton's states met so far."""

    entries: list[tuple[str, bool, float]]
    states: list = field(default_factory=list)

    def __post_init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple] = [()]          # (entry, ...) of each trie node
        self.edits: list[int] = [0]            # edits that some entry below allows
        for n, (text, _, _) in enumerate(self.entries):
            node, allowed = 0, int(len(text) >= FUZZY_LEAST)
            for c in text:
                self.edits[node] = max(self.edits[node], allowed)
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                    self.edits.append(0)
                node = self.next[node][c]
            self.edits[node] = max(self.edits[node], allowed)
            self.ends[node] += (n,)
        self._known: dict[frozenset, int] = {}
        self.step: list[dict[str, int]] = []
        self.match: list[tuple[float, float]] = []    # at a word's end: (exact weight, fuzzy weight)
        self.prefix: list[tuple[float, float]] = []   # of beginnings complete at this point
        self.start = self._state({(0, 0)})

    def _state(self, nodes) -> int:
        """The number of a state, closed under skipping characters of an entry."""
        todo, closed = list(nodes), {}
        while todo:
            node, spent = todo.pop()
            if spent > self.edits[node] or closed.get(node, 9) <= spent:
                continue
            closed[node] = spent
            todo += ((n, spent + 1) for n in self.next[node].values())
        key = frozenset(closed.items())
        if key not in self._known:
            self._known[key] = len(self.step)
            self.step.append({})
            whole, begun = [0.0, 0.0], [0.0, 0.0]
            for node, spent in key:
                for e in self.ends[node]:
                    text, beginning, weight = self.entries[e]
                    if spent > int(len(text) >= FUZZY_LEAST):
                        continue
                    into = begun if beginning else whole
                    into[min(spent, 1)] = max(into[min(spent, 1)], weight)
            self.match.append(tuple(whole))
            self.prefix.append(tuple(begun))
            self.states.append(key)
        return self._known[key]

    def _advance(self, state: int, c: str) -> int:
        nodes = []
        for node, spent in self.states[state]:
            if c in self.next[node]:
                nodes.append((self.next[node][c], spent))
            nodes.append((node, spent + 1))                                       # an extra character
            nodes += ((n, spent + 1) for n in self.next[node].values())           # another character
        out = self.step[state][c] = self._state(nodes)
        return out

    def find(self, word: str) -> tuple[float, float]:
        """(weight of the best exact match, of the best match with an edit), 0 if none."""
        if len(self.step) > 200_000:  # only words made up to be near everything lead here
            self.states.clear()
            self.__post_init__()
        state, exact, fuzzy = self.start, 0.0, 0.0
        for c in word:
            state = self.step[state].get(c) if c in self.step[state] else self._advance(state, c)
            a, b = self.prefix[state]
            exact, fuzzy = max(exact, a), max(fuzzy, b)
            if not self.states[state]:
                return exact, fuzzy
        a, b = self.match[state]
        return max(exact, a), max(fuzzy, b)


class Matches(dict):
    """Word -> what the lexicon says, for the words seen lately."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) >= 300_000:
            self.clear()
        found = self[word] = (lambda m: m if m[0] or m[1] else None)(self.lexicon.find(word.lower()))
        return found


def features(text: str | None, matches: Matches) -> list[float]:
    words = WORD.findall(text) if text else []
    hits = [(i, m) for i, m in enumerate(map(matches.__getitem__, words)) if m]
    exact, fuzzy, plain = [], [], 0
    if hits:
        marks = [m.start() for m in QUOTES.finditer(text)]
        spans = [m.start() for m in WORD.finditer(text)] if marks else None
        for i, (a, b) in hits:
            near = {w.lower() for w in words[max(0, i - WINDOW):i + WINDOW + 1]}
            factor = 1.0
            if marks and bisect_left(marks, spans[i]) % 2:
                factor *= QUOTED
            if near & REPORT:
                factor *= REPORTED
            elif near & ADDRESS:
                factor *= ADDRESSED
            plain += factor >= 1
            (exact if a else fuzzy).append((a or b) * factor)
    n = len(words)
    return [float(bool(exact)), max(exact, default=0.0), float(np.log1p(sum(exact))), float(bool(fuzzy)), max(fuzzy, default=0.0),
            float(np.log1p(sum(fuzzy))), 100 * len(exact) / (n + 20), float(np.log1p(plain)), float(n == 0)]


def units(text: str) -> set[tuple[str, bool]]:
    out = set()
    for w in {w.lower() for w in WORD.findall(text)}:
        out.add((w, False))
        out.update((w[:k], True) for k in STEMS if len(w) > k)
    return out


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """Entries from (text, label) rows, by falling gain.  All that pass the tests are kept: as each stands in MIN_SUPPORT
    texts of the sample, the sample's bound is theirs too."""
    schema = pa.schema([("unit", pa.string()), ("beginning", pa.bool_()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches):
        for b in batches:
            seen = Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.update((*u, label) for u in units(text or ""))
            pairs = {(u, s) for u, s, _ in seen}
            yield pa.RecordBatch.from_pylist([{"unit": u, "beginning": s, "toxic": seen[u, s, 1], "clean": seen[u, s, 0]}
                                              for u, s in pairs], schema=schema)

    base = n_toxic / max(1, n_toxic + n_clean)
    t, c = F.col("toxic"), F.col("clean")
    # log of the probability (bounded by Chernoff) that so many of the unit's texts are toxic by chance
    n = t + c
    q = F.least(t / n, F.lit(1 - 1e-9))
    chance = -n * (q * F.log(q / F.lit(base)) + (1 - q) * F.log((1 - q) / F.lit(1 - base)))
    weight = F.log((t + 0.5) / F.lit(n_toxic + 1.0)) - F.log((c + 0.5) / F.lit(n_clean + 1.0))
    counted = (sample.select("text", "label").mapInArrow(count, "unit string, beginning boolean, toxic long, clean long")
               .groupBy("unit", "beginning").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
               .where((t >= MIN_SUPPORT) & (t * n_clean >= LEAST_RATIO * c * n_toxic) & (chance < F.lit(float(np.log(CHANCE)))))
               .select("unit", "beginning", "toxic", "clean", weight.alias("weight"), (t * weight).alias("gain")))
    counted = counted.checkpoint()
    # A beginning that is as frequent as a longer one of its own adds nothing but risk.
    longer = counted.select("toxic", F.explode(F.array(*[F.when(F.length("unit") > k, F.substring("unit", 1, k)) for k in STEMS])).alias("unit"))
    longer = longer.where(F.col("unit").isNotNull()).groupBy("unit").agg(F.max("toxic").alias("longer"))
    kept = (counted.join(longer, "unit", "left")
            .where(~(F.col("beginning") & (F.coalesce("longer", F.lit(0)) >= 0.9 * F.col("toxic")))))
    return [(r["unit"], r["beginning"], float(r["weight"])) for r in kept.orderBy(F.desc("gain"), "unit", "beginning").collect()]


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100, counts: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method; counts: how often each row counts, once by default.

    A step is halved until it lowers the penalised loss, so that a start far from the minimum can't overshoot for good."""
    x1 = np.c_[x, np.ones(len(x))]
    counts = np.ones(len(x)) if counts is None else counts
    w = np.zeros(x1.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]

    def loss(v):
        z = x1 @ v
        return (counts * (np.logaddexp(0, z) - y * z)).sum() + (penalty * v * v).sum() / 2

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -500, 500)))
        step = np.linalg.solve((x1 * (counts * p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-9),
                               x1.T @ (counts * (y - p)) - penalty * w)
        size = 1.0
        while size > 1e-9 and not loss(w + size * step) <= now:
            size /= 2
        w = w + size * step
        last, now = now, loss(w)
        if size <= 1e-9 or np.abs(size * step).max() < 1e-7 or last - now < 1e-10 * abs(now):
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label, stands_for): training rows of at most ``most`` ids, the first by a hash of the id.

    Training rows are those whose crc32(doc_id as text) mod 5 isn't 0; rows without a label are left out.  Half of
    the bound is for each label, so that a rare label isn't thinned out.  The chosen ids are bounded by ``most``
    and so broadcast: the texts of all other rows go no further than the scan.  Of the rows of a repeated id the
    least text teaches, so that an id with any number of rows counts once.  stands_for: all training ids of the row's
    label by those chosen, 1 where the bound cuts nothing.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_mod(F.col("doc_id")) != 0))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000.0
    # A little more than the share wanted passes the first filter, so that few rows reach the exact cut.
    chosen = [known.where((F.col("label") == k) & (u <= 1.2 * most / 2 / max(1, counts.get(k, 0)) + 1e-4))
              .orderBy(u, "doc_id").limit(most // 2) for k in (0, 1)]
    stands_for = [counts[k] / max(1, chosen[k].count()) if counts.get(k, 0) > most // 2 else 1.0 for k in (0, 1)]
    return (docs.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id", "label")
            .agg(F.min("text").alias("text"))
            .select("doc_id", "text", "label", F.when(F.col("label") == 1, stands_for[1]).otherwise(stands_for[0]).alias("stands_for")))


@dataclass
class ToxicityModel:
    entries: list[tuple[str, bool, float]]
    weights: np.ndarray

    def scores(self, texts: list, matches: Matches) -> np.ndarray:
        x = np.array([features(t, matches) for t in texts]).reshape(len(texts), FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic") -> ToxicityModel:
    """Learn from at most SAMPLE_ROWS labelled rows; without toxic rows every score is low.

    The regression counts each row for the training rows that it stands for, so that a score is the probability at the
    labels' own rates, however much of a label the sample leaves out.
    """
    sample = labelled_sample(as_docs(docs, id_col, text_col), labels, label_col).checkpoint()
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not n.get(1) or not n.get(0):
        return ToxicityModel([], np.r_[np.zeros(FEATURES), -3.0 if not n.get(1) else 3.0])
    entries = learn_lexicon(sample, n[1], n[0])

    def extract(batches):
        matches = Matches(Lexicon(entries))
        for b in batches:
            x = [features(t, matches) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *b.columns[1:]], names=["x", "label", "stands_for"])

    rows = (sample.select("text", "label", "stands_for")
            .mapInArrow(extract, "x array<double>, label int, stands_for double").toArrow())  # bounded by the sample
    x, y, counts = np.array(rows["x"].to_pylist()), rows["label"].to_numpy().astype(float), rows["stands_for"].to_numpy()
    # As many in all as rows were read, so that the penalty weighs alike at every size.
    return ToxicityModel(entries, logistic_fit(x, y, counts=counts / counts.mean()))


def _scored(df: DataFrame, text_col: str, model: ToxicityModel, name: str) -> DataFrame:
    """df with a column ``name`` of scores, row by row in Arrow batches; all other columns pass through."""
    entries = model.entries
    at = df.columns.index(text_col)

    def run(batches):
        matches = Matches(Lexicon(entries))
        for b in batches:
            s = model.scores(b.column(at).to_pylist(), matches)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    score: probability of label 1; predicted: 1 if it is at least 0.5; held_out: crc32(doc_id as text) mod 5 is 0, such
    rows never teach.  A null or empty text scores by the intercept and the feature for no words; a null id stays null
    (its text in the checksum is empty); repeated rows score alike; an empty table gives an empty result; only the
    text enters a score.
    """
    model = fit_toxicity(docs, labels, id_col, text_col)
    scored = _scored(as_docs(docs, id_col, text_col), "text", model, "score")
    return scored.select("doc_id", (crc_mod(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score ``threshold`` or more; rows and columns are otherwise as they were."""
    model = fit_toxicity(docs, labels, id_col, text_col)
    name = "toxicity_score"
    while name in docs.columns:
        name += "_"
    return _scored(docs, text_col, model, name).where(F.col(name) < threshold).drop(name)
