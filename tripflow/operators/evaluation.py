"""Classifier evaluation as DataFrame aggregates: confusion matrix, metrics,
ROC points, rank-sum AUC, error slices, model comparison, exact stratified
split and re-sampling.

Counts are hash aggregates; every ordered computation (ROC cumulative
counts, mid-ranks, per-class row numbers) goes through the two-level
``running_totals`` so no class or score range is funnelled into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import r_round
from .windows import running_totals


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(actual, predicted, n) with all four cells present."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(a, p) for a in (0, 1) for p in (0, 1)], "actual int, predicted int")
    c = df.groupBy(F.col(label).cast("int").alias("actual"), F.col(pred).cast("int").alias("predicted")).agg(
        F.count("*").alias("n"))
    return cells.join(c, ["actual", "predicted"], "left").na.fill(0, ["n"])


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    """accuracy, precision, recall, F1, specificity (positive = 1), round 4;
    NULL where a ratio is 0/0."""
    one = cm.agg(*[F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n")).otherwise(0)).alias(k)
                   for k, a, p in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))])
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))

    def ratio(a, b):
        return F.when(b != 0, a / b)
    prec, rec = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return one.select(r_round(ratio(tp + tn, tp + tn + fp + fn), 4).alias("Accuracy"), r_round(prec, 4).alias("Precision"),
                      r_round(rec, 4).alias("Recall"), r_round(ratio(2 * prec * rec, prec + rec), 4).alias("F1_Score"),
                      r_round(ratio(tn, tn + fp), 4).alias("Specificity"))


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """One point per distinct threshold (score >= t is positive), ties grouped;
    the rate of a class that is missing is NULL."""
    sc = score_counts(df, label, score)
    tot = F.broadcast(sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    cum = running_totals(sc, [F.desc("score")], ["pos", "neg"])
    return cum.crossJoin(tot).select(
        F.col("score").alias("threshold"), r_round(F.try_divide(F.col("cum_pos").cast("double"), F.col("P")), 6).alias("tpr"),
        r_round(F.try_divide(F.col("cum_neg").cast("double"), F.col("N")), 6).alias("fpr"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Mann-Whitney AUC with mid-ranks for ties (no direction flip); NULL if a
    class is missing."""
    sc = score_counts(df, label, score)
    cum = running_totals(sc, [F.asc("score")], ["neg"])
    part = cum.select((F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg"))).alias("u"), "pos", "neg")
    return part.agg(F.try_divide(F.sum("u"), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc")).select(r_round(F.col("auc"), 6).alias("AUC"))


def error_types(df: DataFrame, label: str, pred: str) -> DataFrame:
    et = (F.when((F.col(label) == 1) & (F.col(pred) == 0), "False Negative")
          .when((F.col(label) == 0) & (F.col(pred) == 1), "False Positive").otherwise("Correct"))
    return df.groupBy(et.alias("error_type")).agg(F.count("*").alias("n"))


def error_profile(df: DataFrame, label: str, pred: str, features: list[str]) -> DataFrame:
    kind = (F.when((F.col(label) == 1) & (F.col(pred) == 1), "TP").when((F.col(label) == 0) & (F.col(pred) == 0), "TN")
            .when((F.col(label) == 0) & (F.col(pred) == 1), "FP").otherwise("FN"))
    return df.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"),
                                                  *[r_round(F.avg(f), 4).alias(f"mean_{f}") for f in features])


def stratified_split(df: DataFrame, label: str, order: list[str], frac: float = 0.8) -> DataFrame:
    """Exactly ceil(frac * n_c) rows of each class go to train, first in
    ``order`` (a hash of the id gives a random but reproducible split)."""
    n = F.broadcast(df.groupBy(label).agg(F.count("*").alias("__n")))
    ranked = running_totals(df.withColumn("__one", F.lit(1)), order, [], partition=[label], rn="row_in_class")
    out = ranked.join(n, label).withColumn("split", F.when(F.col("row_in_class") <= F.ceil(F.col("__n") * frac), "train").otherwise("test"))
    return out.drop("__n", "row_in_class", "__one")


def class_shares(df: DataFrame, label: str) -> DataFrame:
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    tot = F.broadcast(g.agg(F.sum("n").alias("__t")))
    return g.crossJoin(tot).select(label, "n", r_round(F.col("n") * 100.0 / F.col("__t"), 2).alias("pct"))


def upsample_exact(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """Minority class replicated to the majority size, deterministically:
    row r of the minority (1-based, in ``order``) appears
    ceil((M - r + 1) / m) times, which totals exactly M rows."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    mx = F.broadcast(n.agg(F.max("__n").alias("__M")))
    ranked = running_totals(df.withColumn("__one", F.lit(1)), order, [], partition=[label], rn="row_in_class")
    x = ranked.join(F.broadcast(n), label).crossJoin(mx)
    reps = F.when(F.col("__n") == F.col("__M"), 1).otherwise(
        F.ceil((F.col("__M") - F.col("row_in_class") + 1) / F.col("__n")))
    out = x.withColumn("__rep", F.explode(F.sequence(F.lit(1), reps.cast("int"))))
    return out.drop("__n", "__M", "row_in_class", "__one")


def downsample_exact(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """Every class cut to the minority size, first rows in ``order``."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    mn = F.broadcast(n.agg(F.min("__n").alias("__m")))
    ranked = running_totals(df.withColumn("__one", F.lit(1)), order, [], partition=[label], rn="row_in_class")
    return ranked.crossJoin(mn).where(F.col("row_in_class") <= F.col("__m")).drop("__m", "row_in_class", "__one")
