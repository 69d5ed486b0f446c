"""Euclidean silhouette without point pairs: sums of distances per (point, cluster), tile by tile.

Rows with the same features are one place with a count of each cluster, as their sums are the same.  Asked places and all places are
dealt out to a grid of tiles of bounded size; a tile adds up the distances of its asked places to its places, by cluster, and
sends one row for each (asked place, cluster).  No place goes through the driver; the work is the product of both numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .metric import _long, _vectors, distances

BLOCK = 32_768  # asked points of a tile, at most, and four times as many points
LEAST = 2_048   # and at least, where there are enough: smaller tiles would only be more copies of the points


def _grid(asked: int, points: int, block: int, wanted: int) -> tuple[int, int]:
    """Numbers of parts of the asked points and of the points: tiles of bounded size, about ``wanted`` of them if they aren't too small."""
    na, nb = -(-asked // block), -(-points // (4 * block))
    more = max(1, int((wanted / (na * nb)) ** 0.5))
    return (max(na, min(na * more, -(-asked // LEAST))), max(nb, min(nb * more, -(-points // LEAST))))


def distance_sums(asked: DataFrame, points: DataFrame, n_clusters: int, block: int = BLOCK) -> DataFrame:
    """(id, c, s): sum of the distances from the asked place to the points of cluster number c.

    asked: (id, v); points: (v, cs, ms), the numbers of the clusters that have points there and how many."""
    na, nb = _grid(asked.count(), points.count(), block, 4 * asked.sparkSession.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # fresh names: both sides come from one table
    fresh = lambda df, *names: [df[c].alias(c) for c in names]
    left = asked.select(*fresh(asked, "id", "v"), F.pmod(F.xxhash64("v"), F.lit(na)).cast("int").alias("ta"), every(nb).alias("tb"))
    right = points.select(*fresh(points, "v", "cs", "ms"), F.pmod(F.xxhash64("v", F.lit(1)), F.lit(nb)).cast("int").alias("tb"), every(na).alias("ta"))
    schema = pa.schema([("id", pa.int64()), ("c", pa.int32()), ("s", pa.float64())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_batches([], schema=schema)
        x, y = _vectors(a["v"]), _vectors(b["v"])
        member = np.zeros((len(y), n_clusters))
        cs, ms = b["cs"].combine_chunks(), b["ms"].combine_chunks()
        member[np.repeat(np.arange(len(y)), np.diff(cs.offsets)), cs.flatten().to_numpy()] = ms.flatten().to_numpy()
        total = np.zeros((len(x), n_clusters))
        for at in range(0, len(y), 256):
            for q in range(0, len(x), 128):  # so that a slice's distances stay in the cache
                total[q:q + 128] += distances(x[q:q + 128], y[at:at + 256]) @ member[at:at + 256]
        q, k = np.nonzero(total)
        return pa.table({"id": a["id"].combine_chunks().take(pa.array(q)), "c": pa.array(k, pa.int32()), "s": pa.array(total[q, k])}, schema=schema)

    # a stated number of partitions: tiles are small and long work, so they mustn't be joined up by their size
    dealt = [df.repartition(max(2, min(na * nb, 4096)), "ta", "tb").groupBy("ta", "tb") for df in (left, right)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(run, "id long, c int, s double").groupBy("id", "c").agg(F.sum("s").alias("s"))


def silhouette_exact(df: DataFrame, key: str, cluster: str, features: list[str], asked: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(key, cluster, a, b, silhouette) for all rows of df, or those where ``asked`` holds, against all rows of df.

    a: mean distance to the others of the own cluster; b: least mean distance to another cluster.  A point alone in its
    cluster, one without another cluster to compare and one with a = b = 0 have silhouette 0.  Rows with a null cluster or
    without finite features take no part; the number of clusters is that of a summary table on the driver."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    v = F.array(*[F.col(c).cast("double") for c in features])
    wanted = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    base = (df.select(F.col(key).alias("key"), F.col(cluster).alias("cluster"), v.alias("v"), wanted.alias("asked"))
            .where(F.col("cluster").isNotNull() & F.forall("v", lambda x: F.abs(x) < float("inf"))))
    held = base.groupBy("v", "cluster").agg(F.count("*").alias("m"), F.max("asked").alias("asked"))
    names = [tuple(r) for r in held.groupBy("cluster").agg(F.sum("m")).orderBy("cluster").collect()]
    kind = base.schema["cluster"].dataType.simpleString()
    summary = F.broadcast(spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(names)], f"c int, cluster {kind}, n long"))
    here = F.collect_list(F.struct("c", "m"))
    places = (held.join(summary, "cluster").groupBy("v")
              .agg(here["c"].alias("cs"), here["m"].alias("ms"), F.collect_list(F.when(F.col("asked"), F.col("cluster"))).alias("owns"))
              .select(F.monotonically_increasing_id().alias("id"), "*").checkpoint())
    queries = places.where(F.size("owns") > 0)
    if not names or queries.isEmpty():
        return base.where("false").select(F.col("key").alias(key), F.col("cluster").alias(cluster),
                                          *[F.lit(0.0).alias(c) for c in ("a", "b", "silhouette")])
    sums = distance_sums(queries.select("id", "v"), places.select("v", "cs", "ms"), len(names), block)
    # a cluster whose points all lie at the asked place has no row: its sum is 0
    of = F.map_from_entries(F.collect_list(F.struct("c", "s"))).alias("of")
    told = queries.join(_long(sums.groupBy("id").agg(of)), "id", "left").select("v", F.explode("owns").alias("own"), "of")
    own = F.col("cluster") == F.col("own")
    s = F.coalesce(F.try_element_at("of", "c"), F.lit(0.0))
    agg = told.crossJoin(summary).withColumn("s", s).groupBy("own", "v").agg(
        F.max(F.when(own, F.try_divide("s", F.col("n") - 1))).alias("a"), F.max(F.when(own, F.col("n"))).alias("n"),
        F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    score = F.when((F.col("n") == 1) | F.col("b").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise(
        F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    rows = base.where("asked").select("key", F.col("cluster").alias("own"), "v").join(_long(agg.withColumn("silhouette", score)), ["own", "v"])
    return rows.select(F.col("key").alias(key), F.col("own").alias(cluster), "a", "b", "silhouette")
