"""Grouped and global aggregations.

All are single ``groupBy``/``agg`` plans: partial aggregation on the map
side, one shuffle on the group key, final aggregation.  Global statistics
are one-row aggregates.  Nothing here collects rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import r_round

ARR = "actual_arrival_delay_min"
DEP = "actual_departure_delay_min"


def delay_rate(c: str = "delayed") -> Column:
    return F.avg(F.col(c).cast("double")) * 100


def group_delay(df: DataFrame, keys: list, avg_col: str = ARR, prefix: str = "",
                with_rate: bool = True, with_count: bool = True, with_sd: bool = False,
                with_delay_count: bool = False) -> DataFrame:
    aggs = [r_round(F.avg(avg_col), 2).alias(f"{prefix}avg_delay")]
    if with_delay_count:
        aggs.append(F.sum(F.col("delayed").cast("long")).alias(f"{prefix}delay_count"))
    if with_count:
        aggs.append(F.count("*").alias(f"{prefix}total_trips"))
    if with_rate:
        aggs.append(r_round(delay_rate(), 2).alias(f"{prefix}delay_rate"))
    if with_sd:
        aggs.append(r_round(F.stddev_samp(avg_col), 2).alias(f"{prefix}sd_delay"))
    return df.groupBy(*keys).agg(*aggs)


def class_balance(df: DataFrame, col: str = "delayed") -> DataFrame:
    """count and share (%) per class; the total is a window over the tiny
    grouped result, never over the fact table."""
    g = df.groupBy(col).agg(F.count("*").alias("n"))
    return g.withColumn("pct", r_round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """2-D count table; missing cells are 0 (pivot values given → no extra scan)."""
    return (df.groupBy(row).pivot(col, values).agg(F.count("*")).na.fill(0)
            .withColumnsRenamed({str(v): f"{col}_{v}" for v in values}))


def quantiles_exact_agg(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact type-7 quantiles as one aggregate row per column (long form)."""
    from ..functions.stats import exact_quantiles
    q = exact_quantiles(df, cols, probs)
    rows = [(c, *[float(v) if v is not None else None for v in q[c]]) for c in cols]
    names = ", ".join(f"q{int(round(p * 100))} double" for p in probs)
    return df.sparkSession.createDataFrame(rows, f"Column string, {names}")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max: (bin, lo, hi, n)."""
    mm = F.broadcast(df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi")))
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(F.col("__hi") == F.col("__lo"), 1).otherwise(
        F.least(F.floor((F.col(col) - F.col("__lo")) / width) + 1, F.lit(bins))).cast("int")
    g = (df.where(F.col(col).isNotNull()).crossJoin(mm).select(b.alias("bin"), "__lo", "__hi")
         .groupBy("bin", "__lo", "__hi").agg(F.count("*").alias("n")))
    w = (F.col("__hi") - F.col("__lo")) / bins
    return g.select("bin", r_round(F.col("__lo") + (F.col("bin") - 1) * w, 6).alias("bin_lo"),
                    r_round(F.col("__lo") + F.col("bin") * w, 6).alias("bin_hi"), "n")


def boxplot(df: DataFrame, key: str, col: str) -> DataFrame:
    """Per group: min, q1, median, q3, max (type 7, exact) and the count of
    points beyond 1.5 IQR, all from one table of (group, value, count): the
    rows themselves are read once.  A null key is left out."""
    from ..functions.stats import grouped_values, quantiles_of_values
    vc = grouped_values(df.where(F.col(key).isNotNull()), [key], col)
    qs = quantiles_of_values(vc, [key], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    beyond = (F.col("__v") < F.col("q1") - 1.5 * iqr) | (F.col("__v") > F.col("q3") + 1.5 * iqr)
    # the min and max are the group's own values: their type is kept
    own = dict(df.dtypes)[col]
    out = vc.join(qs, key).groupBy(key, "q1", "median", "q3").agg(
        F.sum("__c").alias("n"), F.min("__v").cast(own).alias("min"), F.max("__v").cast(own).alias("max"),
        F.coalesce(F.sum(F.when(beyond, F.col("__c"))), F.lit(0)).alias("n_outliers"))
    return out.select(key, "n", *[r_round(F.col(c), 4).alias(c) for c in ("min", "q1", "median", "q3", "max")], "n_outliers")


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(r_round(F.regr_slope(y, x), 6).alias("slope"),
                  r_round(F.regr_intercept(y, x), 6).alias("intercept"),
                  r_round(F.regr_r2(y, x), 6).alias("r2"), F.regr_count(y, x).alias("n"))


def binned_trend(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """LOESS stand-in: mean and standard error of y in equal-width x bins."""
    mm = F.broadcast(df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi")))
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(F.col("__hi") == F.col("__lo"), 1).otherwise(
        F.least(F.floor((F.col(x) - F.col("__lo")) / width) + 1, F.lit(bins))).cast("int")
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(mm)
            .groupBy(b.alias("bin")).agg(F.count("*").alias("n"), r_round(F.avg(x), 4).alias("x_mean"),
                                         r_round(F.avg(y), 4).alias("y_mean"),
                                         r_round(F.stddev_samp(y) / F.sqrt(F.count("*")), 4).alias("y_se")))


def ellipses(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Size, centre and covariance of each group (round 4)."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *[r_round(c, 4).alias(name) for name, c in (
        ("mean_x", F.avg(x)), ("mean_y", F.avg(y)), ("var_x", F.var_samp(x)), ("var_y", F.var_samp(y)), ("cov_xy", F.covar_samp(x, y)))])


def hash_sample(df: DataFrame, key: str, rate: float) -> DataFrame:
    """Rows whose key's MD5, read as a number between 0 and 1 from its first eight digits, lies below ``rate``: the same rows
    whatever the partitioning, each key with all its rows or none.  A null key is the empty one."""
    return df.where(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") < F.lit(int(rate * (1 << 32))))


def corr_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair on complete cases, long form.

    Two passes over the data: a one-row mean aggregate (broadcast), then ONE
    aggregate of the p(p+1)/2 centred co-moment sums (plain sums keep the
    aggregate inside whole-stage codegen, unlike p(p-1)/2 separate ``corr``
    buffers; centring keeps it numerically stable).  A constant column has no
    correlation with another: NULL."""
    cc = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    means = F.broadcast(cc.agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(cols)]))
    cen = cc.crossJoin(means).select(*[(F.col(c) - F.col(f"__m{i}")).alias(f"d{i}") for i, c in enumerate(cols)])
    sums = [F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"s_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    one = cen.agg(*sums)
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                parts.append(f"'{a}', '{b}', CAST(1.0 AS DOUBLE)")
            else:
                lo, hi = min(i, j), max(i, j)
                parts.append(f"'{a}', '{b}', try_divide(s_{lo}_{hi}, sqrt(s_{lo}_{lo} * s_{hi}_{hi}))")
    return one.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) AS (var1, var2, r)").select(
        "var1", "var2", r_round(F.col("r"), 6).alias("r"))


def variance_table(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', v{i}" for i, c in enumerate(cols))
    return one.selectExpr(f"stack({len(cols)}, {stack}) AS (Column, variance)").select(
        "Column", r_round(F.col("variance"), 6).alias("variance"),
        (F.coalesce(F.col("variance"), F.lit(0.0)) == 0).alias("zero_variance"))


def pivot_mean(df: DataFrame, row: str, col: str, values: list, measure: str, fill: float | None = 0.0,
               digits: int = 2) -> DataFrame:
    p = df.groupBy(row).pivot(col, values).agg(r_round(F.avg(measure), digits))
    p = p.withColumnsRenamed({str(v): f"{col}_{v}" for v in values})
    return p.na.fill(fill) if fill is not None else p


def distinct_over(df: DataFrame, cols: list[str]) -> DataFrame:
    """n_distinct(c(a, b)): values of several columns as one set (NULL counts once)."""
    vals = df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("v")).distinct()
    return vals.agg((F.count("v") + F.max(F.col("v").isNull().cast("int"))).alias("n_distinct"))
