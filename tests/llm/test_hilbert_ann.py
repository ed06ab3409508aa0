"""Nearest neighbours where rough distances cannot tell them apart: ties, common offsets, repeated ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import hilbert_ann
from strandloom.llm.common import Scratch

KIND = "vec_id long, embedding array<double>"


def brute(rows, asked, k):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    out = {}
    for i, x in rows:
        if i in asked:
            d = np.sqrt(((v - np.array(x)) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(spark, rows, asked, k=10, **more):
    df = spark.createDataFrame(rows, KIND).withColumn("rank", F.lit(1)).repartition(3)
    got = {}
    for r in hilbert_ann.nearest(df, Scratch(spark, "t"), F.col("vec_id").isin(list(asked)), k=k, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    return got


def test_one_hot(spark):
    ids = random.Random(1).sample(range(500), 500)
    rows = [(i, [float(j == at) for j in range(500)]) for at, i in enumerate(ids)]
    asked = set(ids[:12])
    assert found(spark, rows, asked, reach=1.0, curves=2) == brute(rows, asked, 10)


@pytest.mark.parametrize("offset", [1e7, 1e8, 1e9])
def test_offset(spark, offset):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=16) + offset).tolist()) for i in range(800)]
    asked = set(range(0, 800, 50))
    assert found(spark, rows, asked, reach=1.0, curves=2) == brute(rows, asked, 10)


def test_defaults(spark):
    """Recall of the defaults on structureless vectors is 0.9 at least, with and without an offset."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3000, 32))
    for offset in (0.0, 1e6):
        rows = [(i, x.tolist()) for i, x in enumerate(base + offset)]
        asked = set(range(0, 3000, 100))
        got, want = found(spark, rows, asked), brute(rows, asked, 10)
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in asked) >= 0.9 * 10 * len(asked)


def test_repeated_ids_and_equal_distances(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, -1.0]), (4, [1.0, 1.0])]
    got = found(spark, rows, {4}, k=4, reach=1.0)
    assert [i for i, _ in got[4]] == [1, 1, 2, 3]
    assert [i for i, _ in found(spark, [(9, [1.0, 1.0]), *rows[2:]], {9}, k=2, reach=1.0)[9]] == [4, 2]


def test_best_near_the_limits_of_doubles():
    v = np.array([[1e200, 0.0], [0.0, 1e200], [1.0, 1.0]])
    with np.errstate(all="ignore"):
        _, ids, d = hilbert_ann.best(v[2:], np.array([2]), v, np.arange(3), 3)
    assert ids[0] == 2 and d[0] == 0 and len(ids) == 3
