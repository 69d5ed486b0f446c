"""Distributed statistics used across the library.

* ``exact_quantiles`` — R type-7 / ``quantile_cont`` quantiles, exact, for many
  columns at once, without ever gathering a column into one task: each pass is
  a single bucketed count (partial aggregation on every executor, a result of
  ``targets x buckets`` rows) that narrows the value range around the wanted
  ranks until the bucket holding the rank has one distinct value.  Buckets are
  of equal width at first; where that doesn't narrow the range well (values
  over many decades, infinities) they are cut at approximate quantiles, which
  are values of the column, so that every pass ends nearer to the rank.
* ``grouped_quantile`` — exact per-group quantile by pre-aggregated value
  counts and a running sum (sort-based, spillable).
* ``first_seen_mode`` — the most frequent non-null value, ties broken by the
  first occurrence in file order; all columns in one shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
LINEAR_PASSES = 6    # then buckets are cut at approximate quantiles
EDGES = 31


def _type7_ranks(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    lo = int(math.floor(h))
    hi = int(math.ceil(h))
    return lo, hi, h - lo


def exact_order_stats(df: DataFrame, requests: dict[str, list[int]],
                      counts: dict[str, tuple[int, float, float]]) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks of the non-null values of each column."""
    # target -> [col, rank, lo, hi, below, value]
    targets = []
    for c, ranks in requests.items():
        n, mn, mx = counts[c]
        for r in sorted(set(ranks)):
            if n == 0:
                targets.append([c, r, None, None, 0, None])
            elif mn == mx:
                targets.append([c, r, mn, mx, 0, mn])
            else:
                targets.append([c, r, mn, mx, 0, None])
    passes = 0
    cut_at_values: set[tuple] = set()
    while True:
        passes += 1
        active = [i for i, t in enumerate(targets) if t[5] is None and t[2] is not None]
        if not active:
            break
        # targets of one column with the same range share a bucket pass
        ranges: dict[tuple[str, float, float], int] = {}
        for i in active:
            key = (targets[i][0], targets[i][2], targets[i][3])
            ranges.setdefault(key, len(ranges))
        items = []
        by_value = [k for k in ranges if passes > LINEAR_PASSES or k in cut_at_values or not math.isfinite(k[2] - k[1])]
        edges = _edges(df, by_value)
        for (c, lo, hi), rid in ranges.items():
            v = F.col(c).cast("double")
            inside = v.between(F.lit(lo), F.lit(hi))
            if (c, lo, hi) in edges:
                # below, at and between the edges: an edge's own value is a bucket of its own
                bucket = F.lit(0)
                for e in edges[c, lo, hi]:
                    bucket = bucket + F.when(v > F.lit(e), 2).when(v == F.lit(e), 1).otherwise(0)
            else:
                bucket = F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * BUCKETS), F.lit(BUCKETS - 1))
            items.append(F.when(inside, F.struct(F.lit(rid).alias("r"), bucket.cast("int").alias("b"),
                                                 v.alias("v"))))
        cols = {c for (c, _, _) in ranges}
        hist = (df.select(*cols)
                .select(F.explode(F.array(*items)).alias("x"))
                .where(F.col("x").isNotNull())
                .groupBy(F.col("x.r").alias("r"), F.col("x.b").alias("b"))
                .agg(F.count("*").alias("n"), F.min("x.v").alias("mn"), F.max("x.v").alias("mx"))
                .collect())
        by_range: dict[int, list] = {}
        for row in hist:
            by_range.setdefault(row["r"], []).append((row["b"], row["n"], row["mn"], row["mx"]))
        for i in active:
            t = targets[i]
            rid = ranges[(t[0], t[2], t[3])]
            cum = t[4]
            for b, n, mn, mx in sorted(by_range.get(rid, [])):
                if t[1] < cum + n:
                    if mn == mx:
                        t[5] = mn
                    else:
                        if (mn, mx) == (t[2], t[3]):
                            cut_at_values.add((t[0], mn, mx))
                        t[2], t[3], t[4] = mn, mx, cum
                    break
                cum += n
    return {(t[0], t[1]): t[5] for t in targets}


def _edges(df: DataFrame, ranges: list[tuple[str, float, float]]) -> dict[tuple, list[float]]:
    """At most EDGES values of each range's column, near its quantiles."""
    if not ranges:
        return {}
    probs = [(i + 1) / (EDGES + 1) for i in range(EDGES)]
    row = df.agg(*[F.percentile_approx(F.when(F.col(c).cast("double").between(F.lit(lo), F.lit(hi)), F.col(c).cast("double")),
                                       probs, 1000).alias(f"e{i}") for i, (c, lo, hi) in enumerate(ranges)]).first()
    return {k: sorted(set(row[f"e{i}"])) for i, k in enumerate(ranges)}


def column_counts(df: DataFrame, cols: list[str]) -> dict[str, tuple[int, float, float]]:
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v).alias(f"n__{c}"), F.min(v).alias(f"mn__{c}"), F.max(v).alias(f"mx__{c}")]
    row = df.agg(*aggs).collect()[0]
    return {c: (row[f"n__{c}"], row[f"mn__{c}"], row[f"mx__{c}"]) for c in cols}


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Type-7 quantiles of each column (nulls and NaN ignored), exact and distributed."""
    counts = column_counts(df, cols)
    req: dict[str, list[int]] = {}
    plan = {}
    for c in cols:
        n = counts[c][0]
        for p in probs:
            if n == 0:
                plan[(c, p)] = None
                continue
            lo, hi, frac = _type7_ranks(n, p)
            plan[(c, p)] = (lo, hi, frac)
            req.setdefault(c, []).extend([lo, hi])
    stats = exact_order_stats(df, req, counts)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        vals = []
        for p in probs:
            spec = plan[(c, p)]
            if spec is None:
                vals.append(None)
                continue
            lo, hi, frac = spec
            a, b = stats[(c, lo)], stats[(c, hi)]
            vals.append(a + frac * (b - a) if frac and a != b else a)
        out[c] = vals
    return out


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}


def grouped_values(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys..., __v, __c, __cum, __n): the distinct values of ``col`` in each
    group, their counts, the running counts and the group's size.

    Duplicated values collapse first (map-side combine); the running counts
    come from range-partitioned buckets with offsets, so that a group of any
    size is spread over the tasks (``running_totals``)."""
    from ..operators.windows import running_totals
    vc = (df.where(F.col(col).isNotNull())
          .groupBy(*keys, F.col(col).cast("double").alias("__v")).agg(F.count("*").alias("__c")))
    plain = [f"k{i}" for i in range(len(keys))]
    # a null key is a group too: it is joined with its size by <=>
    vc = vc.select(*[F.col(k).alias(a) for k, a in zip(keys, plain)], F.col("__v").alias("v"), F.col("__c").alias("c"))
    cum = running_totals(vc.withColumn("k", F.struct(*plain)).drop(*plain), ["v"], ["c"], partition=["k"])
    sizes = cum.groupBy(F.col("k").alias("own")).agg(F.sum("c").alias("n"))
    return cum.join(sizes, cum.k.eqNullSafe(F.col("own"))).select(
        *[F.col(f"k.{a}").alias(k) for k, a in zip(keys, plain)], F.col("v").alias("__v"), F.col("c").alias("__c"),
        F.col("cum_c").alias("__cum"), F.col("n").alias("__n"))


def quantiles_of_values(vc: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact type-7 quantiles {alias: p} of each group of ``grouped_values``: one aggregate for all."""
    start, aggs, out = F.col("__cum") - F.col("__c"), [], []
    for i, (alias, p) in enumerate(quantiles.items()):
        h = (F.col("__n") - 1) * F.lit(p)
        for side, r in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            aggs.append(F.max(F.when((r >= start) & (r < F.col("__cum")), F.col("__v"))).alias(f"__{side}{i}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"__f{i}"))
        out.append((F.col(f"__lo{i}") + F.col(f"__f{i}") * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).alias(alias))
    return vc.groupBy(*keys).agg(*aggs).select(*keys, *out)


def grouped_quantile(df: DataFrame, keys: list[str], col: str, p: float, alias: str) -> DataFrame:
    """Exact type-7 quantile of ``col`` per group: (keys..., alias)."""
    return quantiles_of_values(grouped_values(df, keys, col), keys, {alias: p})


def first_seen_mode(df: DataFrame, cols: list[str], order_cols: list[str]) -> dict[str, str | None]:
    """Mode of each column as a string (cast back by the caller).

    One shuffle for all columns: rows are stacked as (column, value) and
    counted with map-side combine, carrying the earliest first-order key
    (a fixed-width long, so the aggregate stays a codegen'd hash
    aggregate).  The winner per column is the largest count, then the
    earliest first occurrence; remaining ties on the first key are settled by
    the later order keys over only the few tied candidate rows.
    """
    if not cols:
        return {}
    first, rest = order_cols[0], order_cols[1:]
    stacked = df.select(F.col(first).alias("__o"), *[F.col(c).alias(f"__r{i}") for i, c in enumerate(rest)],
                        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                            for c in cols])).alias("x"))
    stacked = stacked.select("__o", *[f"__r{i}" for i in range(len(rest))], "x.c", "x.v").where(F.col("v").isNotNull())
    counted = stacked.groupBy("c", "v").agg(F.count("*").alias("n"), F.min("__o").alias("first"))
    best = counted.groupBy("c").agg(F.max("n").alias("bn"))
    tops = counted.join(F.broadcast(best), "c").where(F.col("n") == F.col("bn"))
    firsts = tops.groupBy("c").agg(F.min("first").alias("bf"))
    cand = tops.join(F.broadcast(firsts), "c").where(F.col("first") == F.col("bf")).select("c", "v", "first").collect()
    by_col: dict[str, list] = {}
    for r in cand:
        by_col.setdefault(r["c"], []).append((r["v"], r["first"]))
    out = {}
    tied = {c: vs for c, vs in by_col.items() if len(vs) > 1}
    for c, vs in by_col.items():
        if len(vs) == 1:
            out[c] = vs[0][0]
    if tied and rest:
        keys = df.sparkSession.createDataFrame([(c, v, f) for c, vs in tied.items() for v, f in vs], "c string, v string, first long")
        rows = (stacked.join(F.broadcast(keys), ["c", "v"]).where(F.col("__o") == F.col("first"))
                .groupBy("c", "v").agg(F.min(F.struct(*[f"__r{i}" for i in range(len(rest))])).alias("k"))
                .groupBy("c").agg(F.min_by("v", F.struct("k", "v")).alias("m")).collect())
        out.update({r["c"]: r["m"] for r in rows})
    elif tied:
        out.update({c: min(v for v, _ in vs) for c, vs in tied.items()})
    return {c: out.get(c) for c in cols}


def mode_alpha(df: DataFrame, keys: list[str], col: str, alias: str) -> DataFrame:
    """Per-group mode, ties to the alphabetically first value (R ``table`` order)."""
    counted = df.groupBy(*keys, col).agg(F.count("*").alias("__n"))
    return counted.groupBy(*keys).agg(
        F.min_by(F.col(col), F.struct((-F.col("__n")).alias("a"), F.col(col).alias("b"))).alias(alias))


def r_round(c: Column, d: int) -> Column:
    """Round half away from zero on the binary value: sign(x) *
    floor(|x| * 10^d + 0.5) / 10^d, then +0.0 (no negative zero).

    Spark's ``round`` rounds the shortest decimal text of the double
    (10.075 -> 10.08) while SQL engines and R round the binary value
    (10.0749999... -> 10.07); this form gives the latter, bit-identically to
    ``round(x, d)`` in DuckDB.  From 2^53 on a scaled value has no fraction
    left to round (and would pass the range of BIGINT): it stays as it is."""
    x = c.cast("double")
    p = float(10 ** d)
    return (F.when(F.abs(x) * p < float(1 << 53), F.signum(x) * F.floor(F.abs(x) * p + 0.5).cast("double") / p)
            .otherwise(x) + F.lit(0.0))
