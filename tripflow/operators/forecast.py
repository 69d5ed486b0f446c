"""Forecasts that are fitted by sums: a regression on lags for each entity, and a next-step network of one hidden layer.

Regressions: every task adds up the moments of its rows, one row for each entity; a grouped sum and a solve follow, so an
entity with any share of the rows is a few numbers when it meets others of its own.

Network: linear output over tanh units.  Its training is Levenberg and Marquardt's: J'J and J'r are sums over the rows, so each
round is one pass; a step that doesn't lower the training error is undone and damped more.  The last rows of the training
part are held out, and the weights with the least error there are the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .manylinear import CELLS
from .metric import _vectors

HIDDEN = 25           # fixed value: units of the hidden layer


# ---------------------------------------------------------------- a regression for each entity

def entity_lags(df: DataFrame, entity: str, order: str, value: str, k: int, frac: float = 0.8) -> DataFrame:
    """(entity, order, y, x, split): the value, its k predecessors (nearest first), and whether the row is among the entity's
    first ``frac`` complete rows.  An entity's series is as long as its calendar."""
    w = Window.partitionBy(entity).orderBy(order)
    # nulls aren't collected, so a row with a null among its predecessors has too few of them
    laid = (df.select(entity, order, F.col(value).cast("double").alias("y"))
            .select("*", F.reverse(F.collect_list("y").over(w.rowsBetween(-k, -1))).alias("x"))
            .where((F.size("x") == k) & F.col("y").isNotNull()))
    n = F.count("*").over(Window.partitionBy(entity))
    return laid.select(entity, order, "y", "x", F.when(F.row_number().over(w) <= F.floor(n * frac), "train").otherwise("test").alias("split"))


def entity_regressions(rows: DataFrame, entity: str) -> DataFrame:
    """(entity, beta): least squares of y on 1 and x for each entity; beta[0] is the constant.

    Columns that others determine get the solution of least norm (a pseudo-inverse of the centred moments), so an entity
    with few rows or a constant series is predicted by its mean."""
    def moments(batches):
        total: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(0).dictionary_encode()
            code, y, x = names.indices.fill_null(-1).to_numpy(), b.column(1).to_numpy(), _vectors(b.column(2))
            z = np.c_[np.ones(len(x)), x, y]
            for c in np.unique(code).tolist():
                own = z[code == c]
                key = names.dictionary[c].as_py() if c >= 0 else None
                total[key] = total.get(key, 0.0) + own.T @ own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([t.ravel().tolist() for t in total.values()], pa.list_(pa.float64()))],
                                             names=[entity, "s"])

    def solve(t: pa.Table) -> pa.Table:
        s = np.array(t["s"].to_pylist()).sum(axis=0)
        d = int(len(s) ** 0.5)
        s = s.reshape(d, d)
        n, mean = s[0, 0], s[0] / s[0, 0]
        c = s - n * np.outer(mean, mean)
        slope = np.linalg.pinv(c[1:-1, 1:-1], rcond=1e-10, hermitian=True) @ c[1:-1, -1]
        return pa.table({entity: t[entity][:1], "beta": [[float(mean[-1] - slope @ mean[1:-1]), *map(float, slope)]]})

    kind = rows.schema[entity].dataType.simpleString()
    part = rows.select(entity, "y", "x").mapInArrow(moments, f"{entity} {kind}, s array<double>")
    return part.groupBy(entity).applyInArrow(solve, f"{entity} {kind}, beta array<double>")


def entity_forecast(rows: DataFrame, entity: str, order: str) -> DataFrame:
    """(entity, order, actual, predicted) of the test rows, by the regression of the entity's training rows."""
    beta = entity_regressions(rows.where(F.col("split") == "train"), entity)
    told = F.aggregate(F.zip_with("x", F.slice("beta", 2, F.size("x")), lambda a, b: a * b), F.get("beta", F.lit(0)), lambda s, v: s + v)
    return (rows.where(F.col("split") == "test").join(beta, entity)
            .select(entity, order, F.col("y").alias("actual"), told.alias("predicted")))


# ---------------------------------------------------------------- next-step network

@dataclass
class Network:
    """tanh units over the inputs, a linear output: weights in one flat array."""
    inputs: int
    hidden: int
    weights: np.ndarray

    @classmethod
    def start(cls, inputs: int, hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        w1 = rng.normal(0, 1 / inputs ** 0.5, (hidden, inputs))
        return cls(inputs, hidden, np.r_[w1.ravel(), rng.normal(0, 0.1, hidden), rng.normal(0, 1 / hidden ** 0.5, hidden), 0.0])

    def parts(self):
        a, h = self.inputs * self.hidden, self.hidden
        w = self.weights
        return w[:a].reshape(h, self.inputs), w[a:a + h], w[a + h:a + 2 * h], w[-1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts()
        return np.tanh(x @ w1.T + b1) @ w2 + b2

    def jacobian(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, their derivatives by the weights)."""
        w1, b1, w2, b2 = self.parts()
        u = np.tanh(x @ w1.T + b1)
        g = (1 - u * u) * w2
        return u @ w2 + b2, np.c_[(g[:, :, None] * x[:, None, :]).reshape(len(x), -1), g, u, np.ones(len(x))]


def _passes(rows: DataFrame, net: Network) -> tuple[float, float, np.ndarray, np.ndarray, float]:
    """(squared error, held-out squared error, J'r, J'J, rows) over all rows (x, y, held)."""
    d = len(net.weights)
    size = 3 + d + d * d

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if not b.num_rows:
                continue
            x, y, held = _vectors(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            total[1] += ((net(x[held]) - y[held]) ** 2).sum()
            for at in range(0, len(x), 1024):
                own = ~held[at:at + 1024]
                if not own.any():
                    continue
                f, j = net.jacobian(x[at:at + 1024][own])
                r = f - y[at:at + 1024][own]
                total += np.r_[r @ r, 0.0, len(r), j.T @ r, (j.T @ j).ravel()]
        cuts = range(0, size, CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([total[c:c + CELLS].tolist() for c in cuts])],
                                         names=["part", "s"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"part": t["part"][:1], "s": [np.array(t["s"].to_pylist()).sum(axis=0).tolist()]})

    got = rows.select("x", "y", "held").mapInArrow(run, "part int, s array<double>").groupBy("part").applyInArrow(
        add, "part int, s array<double>").collect()
    s = np.concatenate([r["s"] for r in sorted(got, key=lambda r: r["part"])])
    return s[0], s[1], s[3:3 + d], s[3 + d:].reshape(d, d), s[2]


def fit_network(rows: DataFrame, inputs: int, hidden: int = HIDDEN, rounds: int = 25, decay: float = 1e-3, seed: int = 42,
                patience: int = 5) -> Network:
    """The network with the least held-out error on the way; ends after ``patience`` accepted steps without a new least.

    rows: (x array<double>, y double, held boolean), best cached.  Equal rows give equal weights up to rounding."""
    net = Network.start(inputs, hidden, seed)
    best, kept, waited, damping = np.inf, net, 0, None
    last, state = np.inf, None
    for _ in range(rounds):
        error, held, grad, hess, n = _passes(rows, net)
        loss = error + decay * n * 1e-3 * (net.weights ** 2).sum()
        if loss < last:
            gain, last = last - loss, loss
            state = (net, grad + decay * n * 1e-3 * net.weights, hess + decay * n * 1e-3 * np.eye(len(grad)))
            damping = damping / 4 if damping else 1e-2 * np.trace(hess) / len(grad)
            if held < best * (1 - 1e-6):
                best, kept, waited = held, net, 0
            else:
                waited += 1
            if waited >= patience or gain < 1e-7 * loss:
                break
        else:
            damping *= 8
        base, g, h = state
        net = Network(inputs, hidden, base.weights - np.linalg.solve(h + damping * np.eye(len(g)), g))
    return kept


def network_forecast(rows: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """rows' columns ``keep`` and ``prediction``."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(net(_vectors(b.column(0))))], names=[*keep, "prediction"])
    return rows.select("x", *keep).mapInArrow(run, f"{kinds}, prediction double")
