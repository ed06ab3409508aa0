"""Whitening of embeddings by a compensated covariance.

Entries become integers (``floor(scale * entry)``), so sums are exact and equal vectors are equal
bit for bit. The fit list has every distinct integer vector once. Its mean is an exact fraction; the
centred vectors are pairs of doubles (high, low). Blocks of centred vectors are cut, column by column,
into slices of 21 bits, so that the outer products of a block of 1,024 vectors are sums of integers
below 2**53: the matrix product makes no rounding error at all (an error-free transformation). Blocks
are added up in double-double; tasks give high and low parts, which are merged in double-double again,
a row of the matrix at a time. The eigenvectors come from LAPACK's tridiagonal reduction with divide
and conquer (what ``numpy.linalg.eigh`` calls) and are refined twice against the double-double matrix,
because its rounding to doubles alone would turn eigenvectors whose eigenvalues are close.

What comes to the driver is a matrix of the vectors' dimension, never rows.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries are left out, and so
are those whose length is not the one most distinct vectors have (ties: the longer); zero vectors take
part; repeated rows and repeated ids each get their rows, and count once in the fit; entries beyond
2**63 / scale become the greatest or smallest long; ``deviation`` is exact up to 38 digits, null
beyond; components without variance (an eigenvalue of at most dimension * 2**-52 of the greatest) are
not given, so one distinct vector gives no rows, as does an empty table; a null id is carried along;
columns besides id and vector are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, shuffle_partitions

#: Bits of a slice, rows of a block: 2 * 21 + 10 < 53.
SLICE_BITS, BLOCK, SLICES = 21, 1 << 10, 5

Pair = tuple[np.ndarray, np.ndarray]


# ---------------------------------------------------------------- double-double


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """(s, e): s + e is a + b exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two pairs, as a pair whose low part is below half a unit of the high one."""
    s, e = two_sum(a[0], b[0])
    e = e + a[1] + b[1]
    high = s + e
    return high, e - (high - s)


def slices(x: Pair) -> list[np.ndarray]:
    """Summands of ``x`` (rows, columns) that have 21 bits each, counted from the greatest value of their
    column: products of columns of two slices are exact."""
    high, low = x
    top = np.frexp(np.abs(high).max(axis=0))[1] if len(high) else np.zeros(high.shape[1], int)
    out = []
    for i in range(1, SLICES + 1):
        unit = np.ldexp(1.0, top - SLICE_BITS * i)
        out.append(np.rint(high / unit) * unit)
        high, low = two_sum(high - out[-1], low)
    return out


def product(a: Pair, b: Pair) -> Pair:
    """The transpose of ``a`` times ``b``, in double-double."""
    out = (np.zeros((a[0].shape[1], b[0].shape[1])),) * 2
    for at in range(0, len(a[0]), BLOCK):
        left, right = (slices((x[0][at : at + BLOCK], x[1][at : at + BLOCK])) for x in (a, b))
        for i in range(SLICES):
            for j in range(SLICES - i):
                part = left[i].T @ right[j]
                out = add(out, (part, np.zeros_like(part)))
    return out


def divided(x: Pair, n: int) -> Pair:
    """A pair over an integer below 2**53."""
    first = x[0] / n
    back, lost = _times(first, float(n))
    rest = ((x[0] - back) - lost) + x[1]
    return two_sum(first, rest / n)


def _times(a: np.ndarray, b: float) -> Pair:
    """(p, e): p + e is a * b exactly, by halves of 26 bits."""
    half = lambda v: (t := v * 134217729.0) - (t - v)
    p = a * b
    a1, b1 = half(a), half(b)
    a2, b2 = a - a1, b - b1
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def eigen(v: Pair, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix given in double-double, the
    greatest first; of the two signs, the one whose greatest entry is positive. Each round corrects
    all vectors by first-order terms of what the matrix and their products leave."""
    _, vectors = np.linalg.eigh(v[0])  # tridiagonal reduction, divide and conquer
    x: Pair = (vectors, np.zeros_like(vectors))
    one = np.eye(len(vectors))
    values = np.zeros(len(vectors))
    for _ in range(rounds):
        gram = product(x, x)
        miss = (one - gram[0]) - gram[1]
        inner = product(x, product(v, x))
        values = np.diag(inner[0]) / (1 - np.diag(miss))
        rest = (inner[0] - np.diag(values)) + inner[1]
        np.fill_diagonal(rest, 0)
        near = 2 * (np.linalg.norm(rest, 2) + np.abs(values).max(initial=0) * np.linalg.norm(miss, 2))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > near
        turn = np.where(apart, (rest + values[None, :] * miss) / np.where(apart, gap, 1), miss / 2)
        x = add(x, (x[0] @ turn, np.zeros_like(turn)))
    order = np.argsort(-values, kind="stable")
    out = x[0][:, order]
    sign = np.sign(out[np.abs(out).argmax(axis=0), np.arange(len(out))]) if len(out) else 1.0
    return values[order], out * sign


# ---------------------------------------------------------------- fit


@dataclass(frozen=True)
class Fit:
    """The fit list's size, its sums by dimension, eigenvalues and eigenvectors (as columns) of the
    components that have variance, the trace of the covariance, and the greatest entry of the whitened
    fit list's covariance minus the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> Pair:
        """Integer vectors minus the mean."""
        mean = [Fraction(s, self.n) for s in self.sums]
        high = np.array([float(m) for m in mean])
        low = np.array([float(m - Fraction(h)) for m, h in zip(mean, high.tolist(), strict=True)])
        s, e = two_sum(x.astype(np.float64), -high)
        return add((s, e), (-low, np.zeros_like(low)))

    def project(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centred(x)
        return (high @ self.vectors + low @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """sum (n * x - S)**2 of each row, exactly."""
        most = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums), default=0)
        if len(self.sums) * most * most < 1 << 63:
            d = self.n * x - np.array(self.sums, np.int64)
            return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
        d = self.n * x.astype(object) - np.array(self.sums, object)
        return pa.array([Decimal(s) if s < 10**38 else None for s in (d * d).sum(axis=1).tolist()], pa.decimal128(38, 0))


def integer_vectors(rows: DataFrame, scale: int, vector: str) -> Column:
    """``floor(scale * entry)`` of each entry as long; null where the vector takes no part."""
    c = F.col(vector)
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.when(F.coalesce((F.size(c) > 0) & fine, F.lit(False)), F.transform(c, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fit(rows: DataFrame, scratch: Scratch, components: int = 4, scale: int = 256, vector: str = "embedding") -> Fit | None:
    """Fit on the distinct integer vectors of ``rows``; None where there are none."""
    spark = scratch.spark
    distinct = scratch.table(rows.select(integer_vectors(rows, scale, vector).alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.lit(1).alias("one")).select("x", F.size("x").alias("d")), "fit")
    lengths = distinct.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d, n = lengths[0].d, lengths[0].n
    listed = distinct.where(F.col("d") == d).select("x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the upper and lower 32 bits, which do not overflow."""
        total = np.zeros((2, d), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            total += np.array([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), *map(pa.array, total)], names=["i", "upper", "lower"])

    big = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    added = listed.mapInArrow(sums, "i int, upper long, lower long").groupBy("i").agg(big("upper"), big("lower")).orderBy("i").collect()  # a row a dimension
    centre = Fit(n, [(int(r.upper) << 32) + int(r.lower) for r in added], np.zeros(0), np.zeros((d, 0)), 0.0)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Pair = (np.zeros((d, d)),) * 2
        for batch in batches:
            x = centre.centred(_matrix(batch.column(0), d))
            total = add(total, product(x, x))
        part = TaskContext.get().partitionId()
        yield _pair_rows(np.arange(d, dtype=np.int32), np.full(d, part, np.int32), total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum the parts of each row of the matrix; they come sorted by row, a row is held at a time."""
        held: list = []  # [row, high, low]
        for batch in batches:
            high, low = (_matrix(batch.column(c), d) for c in (2, 3))
            for k, i in enumerate(batch.column(0).to_pylist()):
                if held and held[0] == i:
                    held[1:] = add((held[1], held[2]), (high[k], low[k]))
                    continue
                if held:
                    yield _pair_rows(np.array(held[:1], np.int32), np.zeros(1, np.int32), (held[1][None], held[2][None]))
                held = [i, high[k], low[k]]
        if held:
            yield _pair_rows(np.array(held[:1], np.int32), np.zeros(1, np.int32), (held[1][None], held[2][None]))

    shape = "i int, part int, high array<double>, low array<double>"
    parts = scratch.table(listed.mapInArrow(outer, shape), "outer")
    rows_of = parts.repartition(min(d, shuffle_partitions(spark)), "i").sortWithinPartitions("i", "part").mapInArrow(merge, shape).collect()  # a row a dimension
    rows_of.sort(key=lambda r: r.i)
    v = divided((np.array([r.high for r in rows_of]), np.array([r.low for r in rows_of])), n)
    values, vectors = eigen(v)
    trace = float(sum(Fraction(float(h)) + Fraction(float(l)) for h, l in zip(np.diag(v[0]), np.diag(v[1]), strict=True)))
    kept = int(np.count_nonzero(values[:components] > d * 2.0**-52 * max(float(values[0]), 0.0)))
    found = Fit(n, centre.sums, values[:kept], vectors[:, :kept], trace)
    if not kept:
        return found

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept + 1, kept))
        for batch in batches:
            w = found.project(_matrix(batch.column(0), d))
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "s"])

    m = listed.mapInArrow(moments, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    m = np.array([r.s for r in m]).reshape(kept + 1, kept) / n
    error = float(np.abs(m[:kept] - np.outer(m[kept], m[kept]) - np.eye(kept)).max())
    return Fit(n, found.sums, found.values, found.vectors, trace, error)


def _pair_rows(rows: np.ndarray, parts: np.ndarray, x: Pair) -> pa.RecordBatch:
    as_list = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(parts), as_list(x[0]), as_list(x[1])], names=["i", "part", "high", "low"])


def whiten(rows: DataFrame, model: Fit, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row that takes part and
    each component; no shuffle."""
    d, k = len(model.sums), len(model.values)
    kind = rows.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            cols = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), model.deviations(x).take(each)]
            cols += [pa.array(c) for c in (model.project(x).ravel(), np.tile(model.values / model.trace, m), np.full(m * k, model.identity_error))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    taking = rows.select(F.col(id_col).alias("id"), integer_vectors(rows, scale, vector).alias("x")).where(F.size("x") == d)
    return taking.mapInArrow(task, shape) if k else rows.sparkSession.createDataFrame([], shape)


# ---------------------------------------------------------------- query


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(rows, Scratch(spark, "whitening")) or Fit(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    return whiten(rows, model).select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES = {"op13_whitening": op13_whitening}
#: SQL has no eigenvectors; tests/llm/test_whitening.py recomputes the rows in exact fractions.
ORACLE_SQL: dict[str, str] = {}
