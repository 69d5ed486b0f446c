"""Column profiling: null counts, distinct counts, numeric summaries and
frequency tables — each ONE aggregate over all columns, unpivoted to the
reference's long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import exact_quantiles, r_round


def _stack(one: DataFrame, cols: list[str], fields: list[str], names: str) -> DataFrame:
    body = ", ".join(f"'{c}', " + ", ".join(f"{f}{i}" for f in fields) for i, c in enumerate(cols))
    return one.selectExpr(f"stack({len(cols)}, {body}) AS ({names})")


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Column, Missing_Count, Missing_Percent (round 2)."""
    cols = cols or df.columns
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    body = ", ".join(f"'{c}', m{i}" for i, c in enumerate(cols))
    return one.selectExpr("__n", f"stack({len(cols)}, {body}) AS (Column, Missing_Count)").select(
        "Column", F.col("Missing_Count").cast("long").alias("Missing_Count"),
        r_round(F.col("Missing_Count") * 100.0 / F.col("__n"), 2).alias("Missing_Percent"))


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """n_distinct per column; NULL counts as one value (R semantics).

    Exact distinct counts of many columns are one stacked (column, value)
    aggregation — a single shuffle, map-side de-duplicated — instead of one
    count-distinct expansion per column.  ``approx=True`` uses HLL sketches."""
    cols = cols or df.columns
    if approx:
        one = df.agg(*[(F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"u{i}")
                       for i, c in enumerate(cols)])
        return _stack(one, cols, ["u"], "Column, Unique_Values")
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                            for c in cols])).alias("x"))
    d = stacked.select("x.c", "x.v").distinct()
    out = d.groupBy("c").agg((F.count("v") + F.max(F.col("v").isNull().cast("int"))).cast("long").alias("Unique_Values"))
    return out.withColumnRenamed("c", "Column")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Column, min, max, mean, median, sd (mean/median/sd rounded 2)."""
    cols = cols or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}")]
    med = exact_quantiles(df, cols, [0.5])
    one = df.agg(*aggs)
    long = _stack(one, cols, ["l", "h", "a", "s"], "Column, min, max, mean, sd")
    meds = df.sparkSession.createDataFrame([(c, med[c][0]) for c in cols], "Column string, median double")
    return long.join(F.broadcast(meds), "Column").select(
        "Column", "min", "max", r_round(F.col("mean"), 2).alias("mean"), r_round(F.col("median"), 2).alias("median"),
        r_round(F.col("sd"), 2).alias("sd"))


def frequency(df: DataFrame, cols: list[str]) -> DataFrame:
    """table() of several columns at once: (Column, value, n), NULLs excluded."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("Column"), F.col(c).cast("string").alias("value"))
                                            for c in cols])).alias("x")).select("x.*")
    return stacked.where(F.col("value").isNotNull()).groupBy("Column", "value").agg(F.count("*").alias("n"))


def all_null_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or df.columns
    one = df.agg(*[F.count(c).alias(f"k{i}") for i, c in enumerate(cols)])
    return _stack(one, cols, ["k"], "Column, non_null").where(F.col("non_null") == 0).select("Column")


def summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """summary(): min, q1, median, mean, q3, max per numeric column (type 7)."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.min(v).alias(f"l{i}"), F.avg(v).alias(f"a{i}"), F.max(v).alias(f"h{i}")]
    long = _stack(df.agg(*aggs), cols, ["l", "a", "h"], "Column, min, mean, max")
    qs = df.sparkSession.createDataFrame([(c, *q[c]) for c in cols], "Column string, q1 double, median double, q3 double")
    return long.join(F.broadcast(qs), "Column").select(
        "Column", r_round(F.col("min"), 4).alias("min"), r_round(F.col("q1"), 4).alias("q1"),
        r_round(F.col("median"), 4).alias("median"), r_round(F.col("mean"), 4).alias("mean"),
        r_round(F.col("q3"), 4).alias("q3"), r_round(F.col("max"), 4).alias("max"))
