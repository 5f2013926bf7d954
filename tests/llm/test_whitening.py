import math

import numpy as np
import pytest

from loglake.llm import whitening


def brute(rows, wanted=16):
    """Plain numpy over all rows."""
    held = [(k, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for k, v in rows]
    fit = [list(x) for x in {tuple(x) for _, x in held}]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - t) / n for c, t in zip(x, s)] for x in fit])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    out = {}
    for k, x in held:
        deviation = sum((n * c - t) ** 2 for c, t in zip(x, s))
        on = np.array([(n * c - t) / n for c, t in zip(x, s)]) @ q / np.sqrt(e)
        out[k] = (n, deviation, on, e / np.trace(y.T @ y / n))
    return out


def compare(got, want, wanted=16):
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert by.keys() == want.keys()
    keys = sorted(by)
    for c in range(1, wanted + 1):
        a, b = np.array([by[k][c]["whitened"] for k in keys]), np.array([want[k][2][c - 1] for k in keys])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    for k in keys:
        assert len(by[k]) == wanted
        for c, r in by[k].items():
            assert (r["n"], r["deviation"]) == want[k][:2]
            assert abs(r["explained"] / want[k][3][c - 1] - 1) < 1e-9
            assert r["identity_error"] < 1e-9


def test_whitening_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    compare(whitening.whiten(table).collect(), brute([(r.vec_id, r.embedding) for r in table.collect()]))


def test_rows_that_take_no_part(spark):
    r = np.random.default_rng(1)
    rows = [(k, r.standard_normal(5).tolist()) for k in range(40)]
    rows += [(100 + k, rows[0][1]) for k in range(30)]
    odd = [(-1, None), (-2, []), (-3, [1.0, None, 1.0, 1.0, 1.0]), (-4, [float("nan")] + [0.0] * 4), (-5, [0.0] * 4 + [float("inf")]), (-6, [1.0] * 6)]
    table = spark.createDataFrame([(*x, "y", 3) for x in rows + odd], "vec_id bigint, embedding array<float>, x string, id int").repartition(5)
    compare(whitening.whiten(table, 3).collect(), brute(rows, 3), 3)
    again = whitening.whiten(table.union(table), 3).collect()
    assert len(again) == 2 * 3 * 70 and {x["n"] for x in again} == {40}


def test_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0, float(-k)]) for k in range(9)], schema)).collect()
    assert len(line) == 9 and all(abs(x["explained"] - 1) < 1e-9 for x in line)  # one component has all


def test_huge_entries(spark):
    rows = [(k, [3e38 if k % 2 else -3e38, float(k)]) for k in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert {r["deviation"] for r in got} == {None} and {r["component"] for r in got} == {1}


@pytest.mark.parametrize("spectrum", [np.arange(40.0, 0, -1), [9.0] * 12 + [1.0] * 28, [5.0] * 20 + [5 - 1e-9] * 20, np.geomspace(1e6, 1e-3, 40), [3.0] + [0.0] * 39])
def test_feast_and_inertia(spectrum):
    spectrum = np.array(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((40, 40)))
    v = q * spectrum @ q.T
    v = (v + v.T) / 2
    for shift in (0.5, 2.5, 4.9, 7.3, 100.1):
        assert whitening.inertia(v - shift * np.eye(40)) == (int((spectrum > shift).sum()), int((spectrum < shift).sum()))
    found = []
    for low, high, count in whitening.intervals(v, 16):
        values, vectors = whitening.feast(v, low, high, count)
        assert np.abs(v @ vectors - vectors * values).max() < 1e-11 * spectrum.max()
        found += values.tolist()
    rank = int((spectrum > 1e-12 * spectrum.max()).sum())
    assert len(found) >= min(16, rank)
    assert np.allclose(found[:16], spectrum[: min(16, rank)], rtol=1e-9)
