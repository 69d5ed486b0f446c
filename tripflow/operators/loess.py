"""LOESS: local linear fits with tricube weights over the nearest share of the rows, with their standard errors.

Rows are summed up by distinct x first.  For each of a few places the distance of the q-th nearest row is a running count
over those sums; then the weighted moments of all places are one aggregate, and fit and error follow from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import running_totals


def loess(df: DataFrame, x: str, y: str, places: int = 20, span: float = 0.75) -> DataFrame:
    """(place, x, reach, fit, se) at ``places`` evenly spaced values of x (one, if all are equal).

    reach: distance of the nearest ceil(span * n) rows; weights (1 - (d / reach)^3)^3, equal ones if all of these rows lie at
    the place.  Where the weighted rows share one x the fit is their mean.  se: root of the weighted mean squared residual of the
    local line, times the norm of the fit's row of the smoother.  Rows with a null or non-finite x or y take no part."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    told = (df.select(xs.alias("x"), ys.alias("y")).where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
            .groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")))
    span_of = told.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("rows"))
    step = (F.col("hi") - F.col("lo")) / F.lit(max(1, places - 1))
    grid = (span_of.where("rows > 0").select(F.explode(F.sequence(F.lit(0), F.when(F.col("hi") > F.col("lo"), F.lit(places - 1)).otherwise(F.lit(0)))).alias("place"),
                                             "lo", step.alias("step"), F.ceil(F.col("rows") * F.lit(span)).alias("q"))
            .select("place", (F.col("lo") + F.col("place") * F.col("step")).alias("x0"), "q"))
    pairs = told.crossJoin(F.broadcast(grid)).withColumn("u", F.col("x") - F.col("x0")).withColumn("d", F.abs("u"))
    counts = pairs.groupBy("place", "d").agg(F.sum("n").alias("n"), F.first("q").alias("q"))
    reach = (running_totals(counts, ["d"], ["n"], partition=["place"]).where(F.col("cum_n") >= F.col("q"))
             .groupBy("place").agg(F.min("d").alias("reach")))
    t = F.col("d") / F.col("reach")
    w = F.when(F.col("reach") == 0, F.when(F.col("d") == 0, 1.0)).when(F.col("d") < F.col("reach"), F.pow(1 - t * t * t, F.lit(3.0)))
    u, n, sy = F.col("u"), F.col("n"), F.col("sy")
    weighed = pairs.join(F.broadcast(reach), "place").withColumn("w", w).where(F.col("w") > 0)
    w = F.col("w")
    m = weighed.groupBy("place", "x0", "reach").agg(
        F.sum(w * n).alias("s0"), F.sum(w * u * n).alias("s1"), F.sum(w * u * u * n).alias("s2"), F.sum(w * sy).alias("t0"),
        F.sum(w * u * sy).alias("t1"), F.sum(w * F.col("syy")).alias("t2"), F.sum(w * w * n).alias("r0"),
        F.sum(w * w * u * n).alias("r1"), F.sum(w * w * u * u * n).alias("r2"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = det > 1e-12 * F.col("s0") * F.col("s2")
    fit = F.when(line, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / F.col("det")).otherwise(F.col("t0") / F.col("s0"))
    slope = F.when(line, (F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / F.col("det")).otherwise(0.0)
    norm = F.when(line, (F.col("s2") * F.col("s2") * F.col("r0") - 2 * F.col("s2") * F.col("s1") * F.col("r1") + F.col("s1") * F.col("s1") * F.col("r2"))
                  / (F.col("det") * F.col("det"))).otherwise(F.col("r0") / (F.col("s0") * F.col("s0")))
    fitted = m.withColumn("det", det).withColumn("fit", fit).withColumn("slope", slope).withColumn("norm", norm)
    left = (F.col("t2") - F.col("fit") * F.col("t0") - F.col("slope") * F.col("t1")) / F.col("s0")
    return fitted.select("place", F.col("x0").alias("x"), "reach", "fit",
                         F.sqrt(F.greatest(left, F.lit(0.0)) * F.greatest(F.col("norm"), F.lit(0.0))).alias("se"))
