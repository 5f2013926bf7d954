"""Embedding whitening: the leading components of a table of vectors by FEAST, and its rows on them with unit variance.

1. Vectors become integers, so that sums are exact; each distinct one is listed once, and tasks add up centred products of the list.
2. The spectrum of the covariance (a matrix of dimension by dimension, whatever the rows are) is cut into intervals by inertia counts.
3. ``feast``, a task an interval: quadrature of a contour around it, complex shifted solves at the nodes, Rayleigh-Ritz in the subspace that they give.
   The inertia counts say how many eigenvalues lie in the interval; a result with another number is refused.
4. Rows are projected in tasks.

Rows take no part whose vector is null, empty, holds null or non-finite entries, or has another length than most (of equally many the longer). Rows and
ids that repeat are rows of the result each, their vector counts once. Entries beyond 2^53 in size count as 2^53; a deviation beyond a long is null.
Components without variance (under 1e-12 of the largest) are left out: vectors that are all the same give no rows, nor does an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.shared import ship, stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Nodes of the upper half of a contour; eigenvalues of an interval, if it can be cut; rounds of refinement.
NODES, SLICE, ROUNDS = 8, 6, 60
#: Variances below this share of the largest are none, intervals below this share of it are not cut further, residuals are below the last.
NONE, NARROW, RESIDUAL = 1e-12, 1e-11, 4e-15
LARGEST = 1 << 53


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that take part, x = floor(64 c) + 1000000 of each entry."""
    good = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & good)
    usual = rows.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size(vec_col) == (usual["d"] if usual else 0))
    limit = F.lit(float(LARGEST))
    x = F.transform(vec_col, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, limit), -limit)).cast("bigint") + SHIFT)
    return rows.select(F.col(id_col).alias("id"), x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: as longs where these hold it, else as Python's integers."""
    if int(np.abs(x).max(initial=0)) * n + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(y: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; None beyond a long."""
    if y.dtype != object and y.size and float(np.abs(y).max()) ** 2 * y.shape[1] < 2.0**62:
        return (y * y).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (y.astype(object) ** 2).sum(1).tolist()] if y.size else []


def added(fit: DataFrame, values, kind: str) -> dict[int, object]:
    """What ``values`` (a matrix of vectors to a flat list of numbers) gives for all of the list: added up in tasks, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = values(matrix(batch.column(0)))
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)] if isinstance(got, list) else total + got
        if total is not None:
            out = pa.array(total if isinstance(total, np.ndarray) else [str(v) for v in total])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), out], names=["k", "v"])

    parts = fit.select("x").mapInArrow(run, f"k int, v {'double' if kind == 'double' else 'string'}")
    return {r["k"]: r["v"] for r in parts.groupBy("k").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()}


def moments(fit: DataFrame, n: int, sums: list[int], turn: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the list (divisor n), centred before multiplying; of its vectors times ``turn`` if that is given."""

    def values(x: np.ndarray) -> np.ndarray:
        y = (differences(x, n, sums) / n).astype(float)
        y = y if turn is None else y @ turn
        return np.concatenate([(y.T @ y)[np.triu_indices(y.shape[1])], y.sum(0)])

    size = len(sums) if turn is None else turn.shape[1]
    got = added(fit, values, "double")
    flat = np.array([got[k] for k in range(len(got))]) / n
    v = np.zeros((size, size))
    v[np.triu_indices(size)] = flat[:-size]
    v = v + np.triu(v, 1).T
    return v - np.outer(flat[-size:], flat[-size:])


def inertia(a: np.ndarray) -> tuple[int, int]:
    """Positive and negative eigenvalues of a symmetric matrix, from the signs of its block-diagonal factor (pivots of one or two rows)."""
    a, n, k, plus, minus = a.copy(), len(a), 0, 0, 0
    share = (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        a[[i, j], k:] = a[[j, i], k:]
        a[k:, [i, j]] = a[k:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        most, size = below.max(initial=0.0), 1
        if most > 0 and abs(a[k, k]) < share * most:
            r = k + 1 + int(below.argmax())
            other = np.abs(a[r, k:])
            other[r - k] = 0
            if abs(a[k, k]) * other.max() < share * most * most:
                if abs(a[r, r]) >= share * other.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        if size == 1:
            pivot = a[k, k]
            plus, minus = plus + int(pivot > 0), minus + int(pivot < 0)
            if pivot != 0:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k + 1 :, k] / pivot)
        else:  # such a block has one eigenvalue of each sign
            plus, minus = plus + 1, minus + 1
            c = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(a[k : k + 2, k : k + 2], c.T)
        k += size
    return plus, minus


def above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues above a shift."""
    return inertia(v - shift * np.eye(len(v)))[0]


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues within) from the top of the spectrum on, until they hold the wanted number or all that are not none."""
    top = float(np.abs(v).sum(1).max()) * (1 + 1e-9)
    if top == 0:
        return []
    low, high = 0.0, top  # the largest eigenvalue, by halving
    while high - low > 1e-3 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if above(v, middle) else (low, middle)
    floor = NONE * high
    todo, found = [(floor, high * 1.1, above(v, floor))], []
    while todo and sum(c for *_, c in found) < wanted:
        low, high, count = todo.pop()
        if count <= SLICE or high - low <= NARROW * top:
            found += [(*apart(v, low, high), count)] if count else []
            continue
        middle = (low + high) / 2
        upper = above(v, middle) - above(v, high)
        todo += [(low, middle, count - upper), (middle, high, upper)]
    return found


def apart(v: np.ndarray, low: float, high: float) -> tuple[float, float]:
    """The interval with its ends moved to the middle of the empty stretches at both, away from eigenvalues inside and out."""
    below, over = above(v, low), above(v, high)
    a, b, c, d = low, high, low, high
    for _ in range(12):
        m, k = (a + b) / 2, (c + d) / 2
        a, b = (m, b) if above(v, m) == below else (a, m)
        c, d = (c, k) if above(v, k) == over else (k, d)
    return (low + a) / 2, (d + high) / 2


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues in (low, high], falling, and their unit eigenvectors (columns); ``count`` says how many there are."""
    d = len(v)
    width = min(d, 2 * count + 4)
    centre, radius = (low + high) / 2, max((high - low) / 2, NARROW * high)
    at, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (at + 1))
    y = np.random.default_rng(20240607).standard_normal((d, width))
    scale = float(np.linalg.norm(v))
    near, best = min(RESIDUAL * scale, (high - low) / 2), np.inf
    for _ in range(ROUNDS):
        q = sum(w / 2 * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(d) - v, y)).real for t, w in zip(turn, weight))
        basis, _ = np.linalg.qr(q)
        values, small = np.linalg.eigh(basis.T @ v @ basis)
        y = basis @ small
        inside = np.flatnonzero((values > low - near) & (values <= high + near))
        if len(inside) == count:
            worst = float(np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0).max()) / scale
            if worst < RESIDUAL or (worst < 1e3 * RESIDUAL and worst > best / 2):  # as near as doubles come
                return values[inside][::-1], y[:, inside][:, ::-1]
            best = min(best, worst)
    raise ArithmeticError(f"{count} eigenvalues were counted from {low} to {high}, the search did not settle on them")


def components(spark, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues and eigenvectors (columns) of a covariance, found interval by interval in tasks; matrix and result have no rows of data."""
    cuts = intervals(v, wanted)
    if not cuts:
        return np.empty(0), np.empty((len(v), 0))
    sent = spark.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values, vectors = feast(sent.value, r["low"], r["high"], r["n"])
                yield pa.RecordBatch.from_arrays([pa.array([r["k"]], pa.int32()), pa.array([values.tolist()]), pa.array([vectors.T.ravel().tolist()])], names=["k", "e", "c"])

    asked = spark.createDataFrame([(k, *c) for k, c in enumerate(cuts)], "k int, low double, high double, n int").repartition(len(cuts), "k")
    got = sorted(asked.mapInArrow(run, "k int, e array<double>, c array<double>").collect(), key=lambda r: r["k"])
    values = np.array([e for r in got for e in r["e"]])
    vectors = np.concatenate([np.reshape(r["c"], (-1, len(v))) for r in got]).T
    if len(values) < min(wanted, above(v, cuts[-1][0])):
        raise ArithmeticError("components are missing")
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row and component: id, component (from 1), n (distinct vectors), deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(integer_vectors(vectors, id_col, vec_col), "integers")
    fit = stored(rows.select("x").distinct(), "fit")
    n = fit.count()
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if n == 0:
        return spark.createDataFrame([], schema)
    got = added(fit, lambda x: [int(s) for s in x.astype(object).sum(0)], "decimal(38,0)")
    sums = [int(got[k]) for k in range(len(got))]
    v = moments(fit, n, sums)
    values, axes = components(spark, v, wanted)
    turn = axes / np.sqrt(values)
    error = float(np.abs(moments(fit, n, sums, turn) - np.eye(len(values))).max()) if len(values) else 0.0
    explained = values / np.trace(v) if len(values) else values
    m = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not m or not batch.num_rows:
                continue
            y = differences(matrix(batch.column(1)), n, sums)
            on = (y / n).astype(float) @ turn
            size = batch.num_rows
            every = np.repeat(np.arange(size), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(every)),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * m, n)),
                    pa.array(squares(y), pa.int64()).take(pa.array(every)),
                    pa.array(on.ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * m, error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
