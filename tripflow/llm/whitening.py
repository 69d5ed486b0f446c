"""Embedding whitening from a covariance that is put together by polarisation.

Only squares are aggregated: for every dimension i the squares of the centred values, and for every pair of dimensions
the squares of the sum of the two centred values.  As var(a + b) = var(a) + var(b) + 2 cov(a, b), the differences of
these variances give all cross-covariances, which are assembled for an eigendecomposition.

Everything up to the covariance is exact.  Entries are fixed-point integers x.  With n vectors and the sum S of a
dimension, c = S div n and r = S mod n, the values are centred at the integer c before they are squared (z = x - c),
and since n*x - S = n*z - r, the sum of (n*x - S)^2 is n * (n * sum z^2 - r^2), in integers of any length.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
# Sums travel as digits to this base, so that adding up to 2^23 of them stays within a long.
DIGIT_BITS, DIGITS = 40, 4
# Pair sums of a dimension are aggregated in rows of this many.
SUMS_A_ROW = 4096


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: n vectors, integer centres c and rests r (S = n*c + r), components as columns."""
    n: int
    centre: tuple[int, ...]
    rest: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    live: np.ndarray  # whether a component has any variance

    @property
    def dims(self) -> int:
        return len(self.centre)


def fixed_point(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): x = floor(64 * c) + 1000000 for each entry c as a double.

    Vectors that are null, empty, or hold a null, a non-finite entry or one whose x is no 64-bit integer
    (beyond about 7e16) are dropped.
    """
    x = F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0 ** 56)))
    return (rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
            .where((F.size("v") > 0) & fine).select("vec_id", x.alias("x")))


def _matrices(column: pa.ListArray):
    """(places, rows) for each length of vector in a batch."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    flat, at = flat.astype(np.int64, copy=False), at - at[0]
    sizes = np.diff(at)
    for d in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == d)
        yield places, flat[at[places][:, None] + np.arange(d)]


def _shifted(x: np.ndarray, centre: tuple[int, ...], room: int) -> np.ndarray:
    """x - centre, as long as squares of twice that value, ``room`` of them, sum up within 64 bits; else Python integers."""
    c = [int(v) for v in centre]
    if max(map(abs, c)) < 1 << 61 and np.abs(x >> 1).max(initial=0) < 1 << 61:
        z = x - np.array(c, np.int64)
        if np.abs(z).max(initial=0) ** 2 < (1 << 60) // max(room, 1) and np.abs(z).max(initial=0) < 1 << 30:
            return z
    return x.astype(object) - np.array(c, object)


def _digits(values: list[int]) -> list[list[int]]:
    """For each place of a digit, the digits of all values (the last one has the sign)."""
    low, out = (1 << DIGIT_BITS) - 1, []
    for k in range(DIGITS):
        out.append([(v >> DIGIT_BITS * k) & low if k < DIGITS - 1 else v >> DIGIT_BITS * k for v in values])
    return out


def _sums(df: DataFrame, each) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(d, i) -> (count, sums): integer sums over all rows of df (x) that ``each`` gives for matrices of a length d.

    each(x) yields (i, sums of the matrix).  Per task one row for each (d, i) and SUMS_A_ROW of its sums, added up by a
    grouped sum; the driver gets one row for each sum, whatever the number of vectors.
    """
    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()),
                        *((f"s{k}", pa.int64()) for k in range(DIGITS))])

    def run(batches):
        counts, total = defaultdict(int), {}
        for b in batches:
            for _, x in _matrices(b.column(0)):
                counts[x.shape[1]] += len(x)
                for i, s in each(x):
                    key, s = (x.shape[1], i), s.astype(object)
                    total[key] = total[key] + s if key in total else s
        for (d, i), s in total.items():
            for at in range(0, len(s), SUMS_A_ROW):
                part = [int(v) for v in s[at:at + SUMS_A_ROW]]
                size = len(part)
                columns = [[d] * size, [i] * size, range(at, at + size), [counts[d]] * size, *_digits(part)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    names = ", ".join(f"{f.name} {'int' if f.name in 'dij' else 'long'}" for f in schema)
    out: dict[tuple[int, int], tuple[int, dict[int, int]]] = {}
    grouped = df.select("x").mapInArrow(run, names).groupBy("d", "i", "j").agg(
        F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(DIGITS)))
    for row in grouped.toLocalIterator():
        found = out.setdefault((row["d"], row["i"]), (row["n"], {}))
        found[1][row["j"]] = sum(row[f"s{k}"] << DIGIT_BITS * k for k in range(DIGITS))
    return {key: (n, [s[j] for j in range(len(s))]) for key, (n, s) in out.items()}


def _plain_sums(x: np.ndarray):
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    yield 0, high.astype(object) * (1 << 32) + low.astype(object)


def fit(vectors: DataFrame) -> tuple[Whitening, DataFrame] | None:
    """The whitening of distinct vectors (x), and those of them that were fitted; None if there are none.

    Fitted is the commonest length (of equally common ones the shortest).  The pass for the sums S, the pass for the
    squares and the eigendecomposition: the driver holds d * d numbers for vectors of d entries.
    """
    sums = _sums(vectors, _plain_sums)
    if not sums:
        return None
    (d, _), (n, totals) = min(sums.items(), key=lambda e: (-e[1][0], e[0][0]))
    centre, rest = tuple(s // n for s in totals), tuple(s % n for s in totals)
    fitted = vectors.where(F.size("x") == d)

    def squares(x):
        # For the place i: squares of z_i, then of z_i + z_j for each later j.
        z = _shifted(x, centre, 4 * len(x))
        for i in range(d):
            both = z[:, i:i + 1] + z[:, i:]
            both[:, 0] = z[:, i]
            yield i, (both * both).sum(axis=0)

    square = {i: s for (_, i), (_, s) in _sums(fitted, squares).items()}
    cov = np.empty((d, d))
    for i in range(d):
        cov[i, i] = (n * square[i][0] - rest[i] ** 2) / n ** 2
        for j in range(i + 1, d):
            cross = square[i][j - i] - square[i][0] - square[j][0]
            cov[i, j] = cov[j, i] = (n * cross - 2 * rest[i] * rest[j]) / (2 * n ** 2)
    values, vectors_ = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    values, vectors_ = values[order], vectors_[:, order]
    trace = sum(n * square[i][0] - rest[i] ** 2 for i in range(d)) / n ** 2
    live = values > max(trace, 0) * d * 1e-15
    explained = np.where(live, values / trace if trace else 0.0, 0.0)
    return Whitening(n, centre, rest, vectors_, values, explained, live), fitted


def project(x: np.ndarray, w: Whitening, most: int) -> np.ndarray:
    """Whitened coordinates on the first components; those without variance give NaN."""
    z = _shifted(x, w.centre, 1).astype(np.float64) - np.array([r / w.n for r in w.rest])
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (z @ w.components[:, :most]) / np.sqrt(np.where(w.live, w.eigenvalues, 1.0))[:most]
    out[:, ~w.live[:most]] = np.nan
    return out


def identity_error(fitted: DataFrame, w: Whitening, most: int) -> float:
    """Largest absolute entry of (covariance of the whitened fit list minus the identity), over components with variance."""
    k = int(w.live[:most].sum())
    if not k:
        return 0.0

    def run(batches):
        n, sums, products = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            for _, x in _matrices(b.column(0)):
                y = project(x, w, k)
                n, sums, products = n + len(y), sums + y.sum(axis=0), products + y.T @ y
        if n:
            yield pa.RecordBatch.from_pydict({"s": [sums.tolist()], "p": [products.ravel().tolist()]})

    cells = fitted.select("x").mapInArrow(run, "s array<double>, p array<double>").select(
        F.posexplode(F.concat("s", "p")).alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v"))
    found = dict(map(tuple, cells.collect()))
    mean = np.array([found[j] for j in range(k)]) / w.n
    cov = np.array([found[k + j] for j in range(k * k)]).reshape(k, k) / w.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


RESULT = ("component int, n long, deviation long, deviation_exact string, whitened double, explained double, "
          "identity_error double")


def whiten(rows: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each remaining row and each of the first ``most`` components (vec_id, component, n, deviation,
    deviation_exact, whitened, explained, identity_error).

    Rows drop out as ``fixed_point`` says, also those of another length than the commonest one of the distinct vectors.
    The fit list holds each distinct x vector once; n is its size; repeated rows and repeated ids each get their rows
    of the result, a null id stays null; an empty table gives no rows; other columns are not read.

    deviation: sum over the dimensions of (n*x - S)^2, exact; null where it exceeds a long, while deviation_exact has
    it in decimal digits always.  whitened: x - S/n on the component, over the root of its eigenvalue; explained: the
    eigenvalue's share of the trace; a component without variance has null and 0.  identity_error: one value, measured
    on the fit list over the components that have variance.

    Distinct vectors come from a grouping with map-side combine, so that copies of a vector meet once a task.
    """
    points = fixed_point(rows, id_col, vector_col)
    id_type = points.schema["vec_id"].dataType
    distinct = points.select("x").distinct().checkpoint()
    found = fit(distinct)
    spark = rows.sparkSession
    schema = f"vec_id {id_type.simpleString()}, {RESULT}"
    if found is None:
        return spark.createDataFrame([], schema)
    w, fitted = found
    k = min(most, w.dims)
    error = identity_error(fitted, w, k)
    share, live = w.explained[:k], w.live[:k]
    peak = (1 << 63) - 1

    def run(batches):
        for b in batches:
            for places, x in _matrices(b.column(1)):
                if x.shape[1] != w.dims:
                    continue
                size = len(x)
                y = project(x, w, k)
                z = _shifted(x, w.centre, 4)
                reach = w.n * (int(np.abs(z).max(initial=0)) + 1)
                kind = np.int64 if reach ** 2 < peak // w.dims else object
                off = z.astype(kind) * w.n - np.array(w.rest, kind)
                far = [int(v) for v in (off * off).sum(axis=1)]
                out = [b.column(0).take(pa.array(np.repeat(places, k))),
                       pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                       pa.array(np.full(size * k, w.n, np.int64)),
                       pa.array([v if v <= peak else None for v in far for _ in range(k)], pa.int64()),
                       pa.array([t for t in map(str, far) for _ in range(k)], pa.string()),
                       pa.array(y.ravel(), mask=~np.tile(live, size)),
                       pa.array(np.tile(share, size)), pa.array(np.full(size * k, error))]
                yield pa.RecordBatch.from_arrays(out, names=["vec_id", *(c.split()[0] for c in RESULT.split(", "))])

    return points.mapInArrow(run, schema)
