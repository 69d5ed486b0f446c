"""Spark result == DuckDB oracle on the smallest scale factor, for a broad
slice of keys (every operator family)."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

KEYS = [
    "agg_station", "agg_route", "agg_hour_weekend", "agg_crosstab", "agg_quantiles", "agg_mode", "agg_corr_matrix",
    "agg_boxplot", "agg_histogram", "agg_station_hour_features", "prof_nulls", "prof_distinct", "prof_report",
    "prof_numeric", "dq_impute_mode", "dq_outlier_log", "dq_audit_log", "dq_dedup_key", "fe_zscore", "fe_minmax",
    "fe_weather_severity", "fe_temporal", "win_station_rank", "win_cumulative_share", "win_next_stop", "topk_origin",
    "rep_kpi", "rep_hourly_patterns", "ts_locf_mean", "ts_sequences", "ts_metrics", "jn_calendar_left",
    "gr_edges", "gr_degree", "gr_pagerank", "gr_closeness", "ml_auc", "ml_roc_points", "ml_stratified_split",
    "ml_upsample", "cl_knn_distance", "cl_eps_neighbors", "cl_dbscan", "cl_silhouette", "src_trips_csv",
    "set_union_by_name", "sc_date_parts", "st_hourly", "cl_silhouette_exact", "cl_knn_distance_3d", "cl_eps_neighbors_3d",
    "cl_dbscan_3d", "agg_loess", "ts_entity_forecast", "agg_group_ellipse", "gr_node_list", "agg_scatter_sample",
]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(cols)
    idx = [cols.index(c) for c in order]
    out = [tuple(_norm(r[i]) for i in idx) for r in rows]
    return order, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("key", KEYS)
def test_parity(spark, duck, key):
    q, sql = E.queries()[key], E.oracle_sql()[key]
    sdf = q(spark, SF_SMALL)
    s_cols, s_rows = _rows(sdf.columns, sdf.collect())
    rel = duck.sql(sql)
    d_cols, d_rows = _rows(rel.columns, rel.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    for a, b in zip(s_rows, d_rows):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert abs(x - y) <= 1e-6 * max(1.0, abs(x)), (key, a, b)
            else:
                assert x == y, (key, a, b)


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
