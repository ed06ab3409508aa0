"""Whitening against exact fractions."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch
from strandloom.llm.whitening import add, divided, eigen, fit, op13_whitening, product, two_sum, whiten


def exact(pair, i, j):
    return Fraction(float(pair[0][i, j])) + Fraction(float(pair[1][i, j]))


def test_products_are_exact_to_double_double():
    rng = np.random.default_rng(1)
    a = two_sum(rng.normal(size=(2500, 3)) * [1, 1e6, 1e-3], rng.normal(size=(2500, 3)) * 1e-17)
    p = product(a, a)
    for i in range(3):
        for j in range(3):
            col = lambda c: [Fraction(float(x)) + Fraction(float(y)) for x, y in zip(a[0][:, c], a[1][:, c], strict=True)]  # noqa: B023, E731
            want = sum(x * y for x, y in zip(col(i), col(j), strict=True))
            size = sum(abs(x * y) for x, y in zip(col(i), col(j), strict=True))
            assert abs(exact(p, i, j) - want) < size * Fraction(1, 10**26)
    q = divided(p, 2500)
    assert abs(exact(q, 0, 1) * 2500 - exact(p, 0, 1)) < abs(exact(p, 0, 1)) * Fraction(1, 10**29)
    assert exact(add(p, p), 1, 2) == 2 * exact(p, 1, 2)


def test_eigenvectors_of_close_eigenvalues():
    """A gap of 1e-6: refined vectors are apart as finely as doubles allow."""
    d, rng = 6, np.random.default_rng(2)
    g = np.round(rng.normal(size=(d, d)) * 2**20) / 2**20
    q, _ = np.linalg.qr(g)
    q = np.round(q * 2**24) / 2**24  # short entries, so that the matrix below is exact in pairs
    w = np.array([3.0, 3.0 - 2**-20, 2.0, 1.0, 0.5, 0.25])
    scaled = (q * w, np.zeros((d, d)))
    v = product((scaled[0].T.copy(), np.zeros((d, d))), (q.T.copy(), np.zeros((d, d))))
    values, x = eigen(v)
    for k in range(d):
        want = [sum(exact(v, i, j) * Fraction(float(x[j, k])) for j in range(d)) for i in range(d)]
        rest = [float(y - Fraction(float(values[k])) * Fraction(float(x[i, k]))) for i, y in enumerate(want)]
        assert np.abs(rest).max() < 2e-15
    off = float(sum(Fraction(float(x[i, 0])) * exact(v, i, j) * Fraction(float(x[j, 1])) for i in range(d) for j in range(d)))
    assert abs(off) / 2**-20 < 2e-9


def brute(rows, k=4):
    """(id, component, deviation) exactly, and whitened values with numpy on exact centred vectors."""
    keep = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in keep})
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    c = [[Fraction(a * n - s, n) for a, s in zip(x, sums, strict=True)] for x in listed]
    d = len(sums)
    v = np.array([[float(sum(r[i] * r[j] for r in c) / n) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for i, x in keep:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        mid = np.array([float(Fraction(a * n - s, n)) for a, s in zip(x, sums, strict=True)])
        out.setdefault(i, []).append((n, dev, mid @ q[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)))
    return out


@pytest.mark.parametrize("offset", [0.0, 1e4])
def test_whitened_rows(spark, offset):
    rng = np.random.default_rng(3)
    base = np.float32(rng.normal(size=(60, 6)) * [3, 2, 1.5, 1, 0.5, 0.2] + offset)
    rows = [(i, base[i].tolist()) for i in range(60)] + [(100 + i, base[0].tolist()) for i in range(40)] + [(0, base[1].tolist())]
    odd = [(200, None), (201, []), (202, [1.0] * 5 + [None]), (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5)]
    want = brute(rows + odd)
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("component", F.lit(1)).repartition(5)
    model = fit(df, Scratch(spark, "t"))
    got = whiten(df, model).collect()
    assert len(got) == 4 * len(rows) and model.identity_error < 1e-12
    sign = {}
    for r in got:
        found = [w for w in want[r.id] if w[1] == r.deviation and w[0] == r.n]
        assert found and r.explained == pytest.approx(found[0][3][r.component - 1], rel=1e-12)
        w = found[0][2][r.component - 1]
        s = sign.setdefault(r.component, 1.0 if abs(r.whitened - w) < 1e-8 else -1.0)
        assert s * r.whitened == pytest.approx(w, abs=1e-9)


def test_edges(spark):
    kind = "vec_id long, embedding array<float>"
    s = Scratch(spark, "t")
    assert fit(spark.createDataFrame([], kind), s) is None
    one = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], kind)
    assert whiten(one, fit(one, s)).count() == 0  # no variance, no components
    line = spark.createDataFrame([(1, [0.0, 1.0]), (None, [0.0, -1.0]), (3, [5.0]), (4, [3e38, 3e38])], kind)
    rows = whiten(line, fit(line, s)).collect()
    assert {r.id for r in rows} == {1, None, 4} and all(np.isfinite(r.whitened) for r in rows)
    flat = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, -1.0])], kind)
    rows = sorted(whiten(flat, fit(flat, s)).collect())
    assert [(r.id, r.component, abs(r.whitened), r.explained, r.deviation) for r in rows] == [(1, 1, 1.0, 1.0, 262144), (2, 1, 1.0, 1.0, 262144)]


def test_query_on_small_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    empty.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert op13_whitening(spark, str(tmp_path)).count() == 0
    rows = op13_whitening(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert rows.where("deviation IS NULL OR identity_error > 1e-9").count() == 0
