"""Density and distance operators on a 2-D feature plane: exact k-NN
distance, epsilon neighbourhoods, DBSCAN — plus cluster profiling/labelling.

Scale design:
* identical points are collapsed first into (x, y, multiplicity) — a hot
  duplicate point costs one row, not a quadratic group;
* neighbours are found by a grid equi-join (cell keys shifted by the nine
  offsets around a cell), never by a cross join; exact k-NN takes wider cells
  only for the points whose k-th distance is not yet provably final, until
  none is left or the cells span the plane;
* DBSCAN connects core points by iterative min-label propagation over the
  core-core edge table, checkpointing each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import r_round
from ..session import ensure_checkpoint_dir


def points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct points with multiplicity: (x, y, m); rows without a finite
    place in the plane are no points."""
    return (df.where((F.abs(F.col(x).cast("double")) < float("inf")) & (F.abs(F.col(y).cast("double")) < float("inf")))
            .groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
            .agg(F.count("*").alias("m")))


def _cells(p: DataFrame, cell: float) -> DataFrame:
    return p.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))


def _offsets(spark, r: int) -> DataFrame:
    rng = list(range(-r, r + 1))
    return spark.createDataFrame([(a, b) for a in rng for b in rng], "dx long, dy long")


def neighbour_pairs(p: DataFrame, cell: float, ring: int = 1) -> DataFrame:
    """Pairs of distinct points whose cells are within ``ring`` of each other,
    with their distance: (x, y, m, x2, y2, m2, d)."""
    spark = p.sparkSession
    a = _cells(p, cell)
    shifted = a.crossJoin(F.broadcast(_offsets(spark, ring))).select(
        "x", "y", "m", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    b = a.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("m").alias("m2"), "cx", "cy")
    j = shifted.join(b, ["cx", "cy"])
    d = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    return j.select("x", "y", "m", "x2", "y2", "m2", d.alias("d"))


def _widening(p: DataFrame, cell: float, step):
    """Union of ``step(todo, pairs)``'s final rows over ever wider cells.

    ``step`` returns (rows of every todo point, condition under which a row is
    final given the reach); points without a final row go on with cells four
    times as wide.  Once a cell is wider than the plane, the nine cells around
    a point hold all points and every row is final."""
    ensure_checkpoint_dir(p.sparkSession)
    low_x, high_x, low_y, high_y = p.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    span = max(high_x - low_x, high_y - low_y) if low_x is not None else 0.0
    todo, done, reach = p, None, cell
    while True:
        rows, is_final = step(todo, neighbour_pairs_subset(todo, p, reach, 1), reach)
        whole = reach > span
        rows = rows.checkpoint()
        final = rows if whole else rows.where(is_final)
        done = final if done is None else done.unionByName(final)
        if whole:
            return done
        todo = rows.where(~F.coalesce(is_final, F.lit(False))).select("x", "y", "m").distinct().checkpoint()
        if todo.isEmpty():
            return done
        reach *= 4


def knn_distance(p: DataFrame, k: int, cell: float) -> DataFrame:
    """Exact distance to the k-th nearest other point (self excluded,
    duplicates count) for every distinct point: (x, y, m, knn); NULL where
    there are fewer than k others."""
    def step(todo, pairs, reach):
        cnt = F.when((F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")), F.col("m2") - 1).otherwise(F.col("m2"))
        c = pairs.withColumn("c", cnt).where(F.col("c") > 0)
        w = Window.partitionBy("x", "y").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
        c = c.withColumn("cum", F.sum("c").over(w))
        kth = c.where(F.col("cum") >= k).groupBy("x", "y", "m").agg(F.min("d").alias("knn"))
        return todo.join(kth, ["x", "y", "m"], "left"), F.col("knn") <= reach
    return _widening(p, cell, step)


def nearest_points(p: DataFrame, k: int, cell: float) -> DataFrame:
    """(x, y, m, near): for every distinct point its k nearest other distinct
    points as an array of (d, x2, y2) in that order; fewer if there are not
    as many."""
    def step(todo, pairs, reach):
        others = pairs.where((F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2")))
        w = Window.partitionBy("x", "y").orderBy("d", "x2", "y2")
        best = (others.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("x", "y", "m")
                .agg(F.sort_array(F.collect_list(F.struct("d", "x2", "y2"))).alias("near")))
        out = todo.join(best, ["x", "y", "m"], "left").withColumn(
            "near", F.coalesce("near", F.array().cast("array<struct<d:double,x2:double,y2:double>>")))
        return out, (F.size("near") == k) & (F.array_max(F.transform("near", lambda e: e["d"])) <= reach)
    return _widening(p, cell, step)


def neighbour_pairs_subset(q: DataFrame, p: DataFrame, cell: float, ring: int) -> DataFrame:
    """Like ``neighbour_pairs`` but only for query points ``q`` against all ``p``."""
    spark = p.sparkSession
    a = _cells(q, cell)
    shifted = a.crossJoin(F.broadcast(_offsets(spark, ring))).select(
        "x", "y", "m", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    b = _cells(p, cell).select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("m").alias("m2"), "cx", "cy")
    d = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    return shifted.join(b, ["cx", "cy"]).select("x", "y", "m", "x2", "y2", "m2", d.alias("d"))


def eps_neighbours(p: DataFrame, eps: float) -> DataFrame:
    """Points within eps (<=), counting the point itself and its duplicates:
    (x, y, m, n_eps)."""
    pairs = neighbour_pairs(p, eps, 1).where(F.col("d") <= eps)
    return pairs.groupBy("x", "y", "m").agg(F.sum("m2").alias("n_eps"))


def eps_estimate(knn: DataFrame, q: float = 0.9, floor_: float = 1.5) -> float:
    """Value of the sorted k-NN distance curve at position round(q * n)
    (points weighted by multiplicity), floored.  Found by a running count
    over the distinct distance values."""
    knn = knn.where(F.col("knn").isNotNull())
    n = knn.agg(F.sum("m")).collect()[0][0] or 0
    pos = int(round(q * n))
    from .windows import running_totals
    by_d = knn.groupBy("knn").agg(F.sum("m").alias("m"))
    cum = running_totals(by_d, ["knn"], ["m"])
    v = cum.where(F.col("cum_m") >= pos).agg(F.min("knn")).collect()[0][0]
    return max(floor_, v if v is not None else floor_)


def dbscan(p: DataFrame, eps: float, min_pts: int = 5, max_rounds: int = 10_000) -> DataFrame:
    """(x, y, m, cluster_x, cluster_y, is_core): the cluster is named by the
    smallest core point of its component; noise has NULL cluster.

    core = at least ``min_pts`` points within eps (itself included);
    components = connected core points (distance <= eps), found by min-label
    propagation; a border point joins the least-named component among its
    core neighbours (a deterministic rule)."""
    ensure_checkpoint_dir(p.sparkSession)
    pairs = neighbour_pairs(p, eps, 1).where(F.col("d") <= eps).checkpoint()
    cnt = pairs.groupBy("x", "y", "m").agg(F.sum("m2").alias("n_eps"))
    core = cnt.where(F.col("n_eps") >= min_pts).select("x", "y").withColumn("is_core", F.lit(True)).checkpoint()
    cc = (pairs.join(core, ["x", "y"])
          .join(core.select(F.col("x").alias("x2"), F.col("y").alias("y2")), ["x2", "y2"])
          .select("x", "y", "x2", "y2")).checkpoint()
    label = core.select("x", "y", F.struct(F.col("x"), F.col("y")).alias("lab"))
    for _ in range(max_rounds):
        # one hop along core-core edges, then pointer jumping (a node adopts
        # its label's label): components settle in O(log diameter) rounds
        nb = (cc.join(label.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("lab").alias("nl")), ["x2", "y2"])
              .groupBy("x", "y").agg(F.min("nl").alias("nl")))
        hop = label.join(nb, ["x", "y"], "left").select(
            "x", "y", F.col("lab").alias("old"), F.least("lab", F.coalesce("nl", "lab")).alias("lab"))
        ptr = hop.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("lab").alias("pl"))
        jumped = hop.join(ptr, (hop.lab.x == ptr.px) & (hop.lab.y == ptr.py), "left").select(
            "x", "y", "old", F.least("lab", F.coalesce("pl", "lab")).alias("lab"))
        new = jumped.select("x", "y", "lab", (F.col("lab") != F.col("old")).alias("changed")).checkpoint()
        changed = new.where(F.col("changed")).limit(1).count()
        label = new.drop("changed")
        if changed == 0:
            break
    else:
        raise RuntimeError(f"DBSCAN components unsettled after {max_rounds} rounds")
    border = (pairs.join(core.select(F.col("x").alias("x2"), F.col("y").alias("y2")), ["x2", "y2"])
              .join(label.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("lab").alias("nl")), ["x2", "y2"])
              .groupBy("x", "y").agg(F.min("nl").alias("blab")))
    out = (cnt.join(core, ["x", "y"], "left").join(label, ["x", "y"], "left").join(border, ["x", "y"], "left")
           .withColumn("lab", F.coalesce("lab", "blab")))
    return out.select("x", "y", "m", F.col("lab.x").alias("cluster_x"), F.col("lab.y").alias("cluster_y"),
                      F.coalesce("is_core", F.lit(False)).alias("is_core"))


# ---------------------------------------------------------------- profiles / labels

def profile(df: DataFrame, cluster: str, means: list[str], modes: list[str]) -> DataFrame:
    """n, means (round 2) and alphabetical-tie modes per cluster."""
    from ..functions.stats import mode_alpha
    g = df.groupBy(cluster).agg(F.count("*").alias("n_observations"),
                                *[r_round(F.avg(c), 2).alias(f"avg_{c}") for c in means])
    for c in modes:
        g = g.join(mode_alpha(df, [cluster], c, f"dominant_{c}"), cluster)
    return g


# Cluster names by rank of mean arrival delay.
LOW_LABEL, MID_LABEL, HIGH_LABEL = "On-Time / Stable", "Moderate / Delay-Sensitive", "Bottleneck-Prone / High-Delay"


def label_by_rank(prof: DataFrame, by: str, cluster: str) -> DataFrame:
    """First (lowest ``by``) → stable, last → bottleneck, else moderate."""
    w = Window.orderBy(F.col(by), F.col(cluster))
    x = prof.withColumn("__rn", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy()))
    lab = F.when(F.col("__rn") == 1, LOW_LABEL).when(F.col("__rn") == F.col("__n"), HIGH_LABEL).otherwise(MID_LABEL)
    return x.withColumn("label", lab).drop("__rn", "__n")


def silhouette_sq(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, exact, from per-cluster
    sums (no point pairs): mean d²(x, C) = |x|² - 2 x·mu_C + mean|y|²_C.

    The k cluster summaries travel as one array row (size proven: k) next to
    every point; a and b are computed with higher-order array functions."""
    xs = F.array(*[F.col(f).cast("double") for f in features])
    sq = F.aggregate(F.transform(xs, lambda v: v * v), F.lit(0.0), lambda acc, v: acc + v)
    base = df.select(F.col(cluster).alias("__k"), xs.alias("__x"), sq.alias("__sq"))
    cs = base.groupBy("__k").agg(F.count("*").alias("n"), F.avg("__sq").alias("msq"),
                                 F.array(*[F.avg(F.col("__x")[i]) for i in range(len(features))]).alias("mu"))
    summary = F.broadcast(cs.agg(F.collect_list(F.struct(F.col("__k").alias("c"), "n", "msq", "mu")).alias("__cs")))
    x = base.crossJoin(summary)

    def dist(e):
        dot = F.aggregate(F.zip_with(e["mu"], F.col("__x"), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return F.col("__sq") - 2 * dot + e["msq"]
    own = F.filter(F.col("__cs"), lambda e: e["c"] == F.col("__k"))[0]
    n_own = own["n"]
    a = F.when(n_own > 1, dist(own) * n_own / (n_own - 1)).otherwise(F.lit(0.0))
    b = F.array_min(F.transform(F.filter(F.col("__cs"), lambda e: e["c"] != F.col("__k")), dist))
    # coincident clusters (a = b = 0) have no better or worse side: 0
    s = F.when((n_own <= 1) | (F.greatest(a, b) <= 0), 0.0).otherwise(F.try_divide(b - a, F.greatest(a, b)))
    return x.select(s.alias("s")).agg(r_round(F.avg("s"), 6).alias("silhouette"))
