"""Window operators.

Partitioned windows (per trip, per user, per group) shuffle once on the
partition key.  Un-partitioned windows (ranks, cumulative shares) are only
ever applied to *aggregated* results whose size is the number of groups,
never to a fact table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import r_round


def rank_rows(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """row_number over a total order (ties broken by the caller's last key)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("int"))


def first_rows(df: DataFrame, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of a total order with their rank: every task keeps
    n rows, and only those are ranked."""
    return rank_rows(df.orderBy(*order).limit(n), order, name)


def top_n_with_ties(df: DataFrame, by: str, n: int, name: str = "rank") -> DataFrame:
    """dplyr ``top_n``: min_rank(desc(by)) <= n, ties kept, no NULLs.  The n-th
    value is found first; only the rows that reach it are ranked."""
    known = df.where(F.col(by).isNotNull())
    least = known.select(by).orderBy(F.desc(by)).limit(n).agg(F.min(by).alias("__least"))
    reach = known.crossJoin(F.broadcast(least)).where(F.col(by) >= F.col("__least")).drop("__least")
    return reach.withColumn(name, F.rank().over(Window.orderBy(F.desc(by))).cast("int"))


def top1_with_ties(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``slice_max(by, n = 1)`` per group, ties kept.

    The per-group max is a hash aggregate (map-side combine), joined back on
    the key; no per-group sort of all rows.
    """
    mx = df.groupBy(*keys).agg(F.max(by).alias("__mx"))
    return df.join(mx, keys).where(F.col(by) == F.col("__mx")).drop("__mx")


def cumulative_share(df: DataFrame, item: str, n: str, pct: str) -> DataFrame:
    """Shares sorted by size desc, 1-based index and running total of the
    rounded shares (as the reference sums rounded percentages)."""
    w = Window.orderBy(F.desc(n), F.asc(item))
    return df.select(item, n, pct,
                     F.row_number().over(w).cast("int").alias("idx"),
                     r_round(F.sum(pct).over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("cum_pct"))


def threshold_index(df: DataFrame, cum: str, idx: str, thresholds: list[float]) -> DataFrame:
    """First index whose running total reaches each threshold (one aggregate)."""
    return df.agg(*[F.min(F.when(F.col(cum) >= t, F.col(idx))).alias(f"idx_{int(t)}") for t in thresholds])


def next_in_sequence(df: DataFrame, entity: str, order: list[str], *cols: str) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(*order)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in cols})


def time_to_next(df: DataFrame, entity: str, ts: str, tiebreak: str, name: str) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(ts, tiebreak)
    nxt = F.lead(ts).over(w)
    minutes = (F.unix_micros(F.to_timestamp(nxt)) - F.unix_micros(F.to_timestamp(F.col(ts)))) / 6e7
    return df.select(entity, tiebreak, ts, r_round(minutes, 6).alias(name))


def group_size_filter(df: DataFrame, keys: list[str], min_exclusive: int, name: str = "n") -> DataFrame:
    """``group_by(keys) %>% filter(n() > k)``: count per group joined back
    (hash aggregate, skew-safe) rather than a window over every row."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > min_exclusive)
    return df.join(counts, keys)


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    from .quality import dedup_key
    return dedup_key(df, key, order)


def running_totals(df: DataFrame, order: list, sums: list[str], partition: list[str] | None = None,
                   buckets: int | None = None, prefix: str = "cum_", rn: str | None = None) -> DataFrame:
    """Inclusive running sums (and optionally a 1-based row number) in
    ``order`` within ``partition`` — exact, without sending a whole group
    through one task.  There are as many buckets as shuffles begin with
    partitions, a number that the stages raise with their input.

    Two levels: rows are range-partitioned on (partition, order) into
    ordered buckets (equal keys stay together); each bucket sums its rows
    locally, a tiny table of bucket totals yields each bucket's offset, and
    the offset is added to the within-bucket running sums.  The bucket
    assignment is frozen with a reliable checkpoint so recomputation cannot
    reshuffle rows across buckets."""
    from pyspark.sql import Window as _W
    from ..session import ensure_checkpoint_dir
    partition = list(partition or [])
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    buckets = buckets or max(int(spark.conf.get(k, None) or 1) for k in (
        "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    order_cols = [o if not isinstance(o, str) else F.col(o) for o in order]
    b = df.repartitionByRange(buckets, *[F.col(p) for p in partition], *order_cols) \
        .withColumn("__pid", F.spark_partition_id()).checkpoint()
    keys = partition + ["__pid"]
    w_in = _W.partitionBy(*keys).orderBy(*order_cols).rowsBetween(_W.unboundedPreceding, 0)
    cols = {f"__in_{s}": F.sum(s).over(w_in) for s in sums}
    if rn:
        cols["__in_rn"] = F.row_number().over(_W.partitionBy(*keys).orderBy(*order_cols))
    inner = b.withColumns(cols)
    tot_aggs = [F.sum(s).alias(f"__t_{s}") for s in sums] + ([F.count("*").alias("__t_rn")] if rn else [])
    tots = b.groupBy(*keys).agg(*tot_aggs)
    w_off = _W.partitionBy(*partition).orderBy("__pid").rowsBetween(_W.unboundedPreceding, -1)
    names = sums + (["rn"] if rn else [])
    offs = tots.select(*keys, *[F.coalesce(F.sum(f"__t_{s}").over(w_off), F.lit(0)).alias(f"__o_{s}") for s in names])
    out = inner.join(F.broadcast(offs), keys)
    res = out.withColumns({(f"{prefix}{s}" if s != "rn" else rn): F.col(f"__in_{s}") + F.col(f"__o_{s}") for s in names})
    return res.drop(*[c for c in res.columns if c.startswith("__")])
