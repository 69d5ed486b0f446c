"""Query registry: each key binds a library operator to the test tables and,
where the result is expressible in SQL, carries the DuckDB oracle text.

Oracle SQL is written against the pre-registered base views; the stand-in
``trips`` table and the cleaned / transformed stages are inlined as CTEs
(``with_ctes``) so the oracle recomputes every step independently.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


MODULES = ("q_io", "q_profile", "q_quality", "q_features", "q_aggregate", "q_windows", "q_report",
           "q_timeseries", "q_graph", "q_eval", "q_cluster", "q_ml", "q_metric", "q_curves", "q_fitted", "q_streaming")


def load_all() -> None:
    import importlib
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")
