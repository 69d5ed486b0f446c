"""Distributed statistics against brute force on small fixtures."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st


def test_exact_quantiles_match_numpy(spark):
    from tripflow.functions.stats import exact_quantiles
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(size=500), np.full(400, 3.25), rng.integers(0, 5, 300).astype(float)])
    b = rng.exponential(size=1200)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    got = exact_quantiles(df, ["a", "b"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])
    for c, arr in (("a", a), ("b", b)):
        want = np.quantile(arr, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])  # type 7
        assert np.allclose(got[c], want, rtol=0, atol=1e-12)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=-3, max_value=3), min_size=1, max_size=40))
def test_running_totals_match_cumsum(spark, xs):
    from pyspark.sql import functions as F
    from tripflow.operators.windows import running_totals
    pdf = pd.DataFrame({"k": list(range(len(xs))), "v": xs})
    df = spark.createDataFrame(pdf)
    got = running_totals(df, [F.asc("k")], ["v"], buckets=3, rn="rn").orderBy("k").toPandas()
    assert list(got["cum_v"]) == list(np.cumsum(xs))
    assert list(got["rn"]) == list(range(1, len(xs) + 1))


def test_grouped_quantiles_match_numpy(spark):
    from tripflow.functions.stats import grouped_quantile
    from tripflow.operators.aggregate import boxplot
    rng = np.random.default_rng(3)
    groups = {"hot": rng.normal(size=900), "few": np.array([1.0, 2.0, 4.0]), "one": np.array([7.0]), "same": np.full(50, -2.5),
              None: rng.integers(0, 9, 41).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["q"] for r in grouped_quantile(df, ["g"], "v", 0.3, "q").collect()}
    assert got.keys() == groups.keys()
    assert all(abs(got[g] - np.quantile(v, 0.3)) < 1e-12 for g, v in groups.items())
    box = {r["g"]: r for r in boxplot(df, "g", "v").collect()}
    assert box.keys() == {"hot", "few", "one", "same"}
    for g, r in box.items():
        q1, q2, q3 = np.quantile(groups[g], [0.25, 0.5, 0.75])
        out = int(((groups[g] < q1 - 1.5 * (q3 - q1)) | (groups[g] > q3 + 1.5 * (q3 - q1))).sum())
        assert (r["n"], r["n_outliers"]) == (len(groups[g]), out)
        assert abs(r["median"] - q2) < 1e-4 and abs(r["q1"] - q1) < 1e-4 and abs(r["max"] - groups[g].max()) < 1e-4


def test_first_seen_mode(spark):
    from tripflow.functions.stats import first_seen_mode
    rows = [(1, 0.0, "b"), (2, 0.0, "a"), (3, 0.0, "a"), (4, 0.0, "b"), (5, 0.0, None), (6, 0.0, "c")]
    df = spark.createDataFrame(rows, "seq long, att double, v string")
    assert first_seen_mode(df, ["v"], ["seq", "att"])["v"] == "b"   # tie a/b: b seen first


def test_r_round_matches_sql_engines(spark):
    from pyspark.sql import functions as F
    from tripflow.functions.stats import r_round
    df = spark.createDataFrame([(10.075,), (2.675,), (-1.005,), (0.125,)], "x double")
    got = [r[0] for r in df.select(r_round(F.col("x"), 2)).collect()]
    import duckdb
    want = [duckdb.sql(f"SELECT round({v}::DOUBLE, 2)").fetchall()[0][0] for v in (10.075, 2.675, -1.005, 0.125)]
    assert got == want
