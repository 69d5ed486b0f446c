"""Document quality by Bradley-Terry ranking.

Each document has a latent quality s = w . x over features of its text.  A good document g is preferred to a poor one
p with probability sigmoid(s_g - s_p), so w is fitted by logistic loss on differences of features of preference pairs.
Pairs are drawn, by a fixed rule, between labelled good and poor rows of a bounded sample.  The scores of the sample
then give the threshold, a quantile of them, and the slope that turns distances from the threshold into a score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripflow.llm.common import as_docs, crc_mod
from tripflow.llm.toxicity import labelled_sample, logistic_fit

SAMPLE_ROWS = 20_000    # most labelled rows that learning reads
PAIRS_PER_POOR = 12     # preference pairs for each poor row
CUT = 0.3               # the score at the threshold
NAMES = ("log_words", "word_length", "long_words", "upper", "upper_words", "digit", "symbol", "bang", "pipe", "stop", "comma",
         "repeat_next", "distinct", "distinct_pairs", "top_word", "line_repeat", "line_words", "squeezed", "other", "capital_only")

_KINDS = np.zeros(0x3000, np.uint8)   # 0 other letters, 1 lower, 2 upper, 3 digit, 4 space, 5 symbol, 6 ! ?, 7 |, 8 . , 9 , ;
for _c in range(0x3000):
    _s = chr(_c)
    _KINDS[_c] = (1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 4 if _s.isspace() else 0 if _s.isalpha()
                  else 6 if _s in "!?" else 7 if _s == "|" else 8 if _s == "." else 9 if _s in ",;:'’-" else 5)


def features(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.bincount(_KINDS[np.minimum(c, 0x2FFF)], minlength=10).astype(float)
    words, n_chars = text.split(), max(1.0, float(len(c) - kinds[4]))
    n = max(1, len(words))
    letters = max(1.0, kinds[0] + kinds[1] + kinds[2])
    count = Counter(words)
    lines = [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    same = sum(map(str.__eq__, words, words[1:]))
    sat = lambda v, k: float(np.log1p(k * v))  # noqa: E731  a ratio whose first hundredths matter most
    raw = text.encode("utf-8", "surrogatepass")
    return [float(np.log1p(len(words))), float(np.minimum(lengths.mean(), 20)), float((lengths > 18).mean()),
            sat(kinds[2] / letters, 10), sum(map(str.isupper, words)) / n, sat(kinds[3] / n_chars, 20), sat(kinds[5] / n_chars, 50),
            sat(kinds[6] / n_chars, 50), sat(kinds[7] / n_chars, 50), sat(kinds[8] / n, 10), sat(kinds[9] / n, 10),
            sat(same / n, 10), len(count) / n ** 0.8, len(set(zip(words, words[1:]))) / n,
            max(count.values(), default=0) / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
            min(2.0, len(zlib.compress(raw, 1)) / (len(raw) + 40)), sat(kinds[0] / letters, 5), float(kinds[1] == 0)]


@dataclass
class QualityModel:
    """Bradley-Terry weights over standardised features, the threshold and the slope."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    quantile: float
    slope: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """CUT at the threshold, rising with the latent quality."""
        z = self.slope * (self.latent(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """From features and labels (1 good, 0 poor) of the sample, in a fixed order."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return QualityModel(mean, scale, np.zeros(x.shape[1]), 0.0, 0.0, 1.0)
    # As many pairs as good rows at least, and a stride that has no factor in common with their number: each good row is met.
    a = np.resize(poor, max(PAIRS_PER_POOR * len(poor), len(good)))
    stride = next(k for k in range(7919, 7919 + len(good) + 1) if math.gcd(k, len(good)) == 1)
    b = good[(np.arange(len(a)) * stride) % len(good)]
    diff = z[b] - z[a]
    # Each pair once as won and once, mirrored, as lost: the intercept is then zero.
    w = logistic_fit(np.r_[diff, -diff], np.r_[np.ones(len(diff)), np.zeros(len(diff))], ridge=1.0)[:-1]
    s = z @ w
    order = np.argsort(s, kind="stable")
    # The quantile below which poor rows, of equal weight in all to the good ones, gather most.
    gain = np.cumsum(np.where(y[order] == 0, 1 / len(poor), -1 / len(good)))
    at = int(np.argmax(gain))
    q = (at + 1) / len(s)
    low, high = s[order[at]], s[order[min(at + 1, len(s) - 1)]]
    slope = float(np.clip(logistic_fit(s[:, None], y.astype(float), ridge=1e-3)[0], 0.05, 20))
    return QualityModel(mean, scale, w, float((low + high) / 2), q, slope)


def _features_of(df: DataFrame, extra: list[T.StructField]) -> DataFrame:
    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *b.columns[1:]],
                                             names=["x", *b.schema.names[1:]])
    return df.mapInArrow(run, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), *extra]))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality") -> QualityModel:
    """Learn from at most SAMPLE_ROWS labelled rows; without rows of both labels all scores are CUT."""
    sample = labelled_sample(as_docs(docs, id_col, text_col), labels, label_col, SAMPLE_ROWS)
    rows = (_features_of(sample.select("text", "doc_id", "label"),
                         [T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType())])
            .toArrow().to_pandas().sort_values("doc_id", kind="stable"))  # bounded by the sample
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(NAMES))
    return fit_pairs(x, rows["label"].to_numpy()) if len(rows) else QualityModel(
        np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES)), 0.0, 0.0, 1.0)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    score: rises with the Bradley-Terry quality and is CUT at the learnt quantile; predicted: 1 if it is at least CUT;
    held_out: crc32(doc_id as text) mod 5 is 0, such rows never teach.  A null or empty text has all features zero; a
    null id stays null (its text in the checksum is empty); repeated rows score alike; an empty table gives an empty
    result; only the text enters a score.
    """
    model = fit_quality(docs, labels, id_col, text_col)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()], float).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x), pa.float64())], names=["doc_id", "score"])

    scored = as_docs(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
