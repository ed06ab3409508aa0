"""Successors and predecessors by packed words: the same rows as by texts, from two rows a node."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators.graph import DeBruijnGraph
from tests.test_compaction import rc, text


@pytest.mark.parametrize("k", [4, 7, 31, 33])
def test_against_sets(spark, k):
    rng = random.Random(k)
    seqs = [text(rng, 40) for _ in range(3)] + ["0" * (k + 2), "02" * k]
    nodes = {min(s[i : i + k], rc(s[i : i + k])) for s in seqs for i in range(len(s) - k + 1)}
    g = DeBruijnGraph(spark.createDataFrame([(x, 1) for x in sorted(nodes)], "kmer string, abundance int"), k)
    asked = [o for x in nodes for o in (x, rc(x))] + [text(rng, k) for _ in range(20)] + [seqs[0][:k], None, "0", "0" * (k - 1) + "x"]
    o = spark.createDataFrame([(x,) for x in asked], "o string")
    node = lambda x: not set(x) - set("0123") and min(x, rc(x)) in nodes
    rows = [x for x in asked if x]
    for nt in (None, "2"):
        assert sorted(map(tuple, g.successors(o, nt).collect())) == sorted((x, n, x[1:] + n) for x in rows for n in nt or "0123" if node(x[1:] + n))
        assert sorted(map(tuple, g.predecessors(o, nt).collect())) == sorted((x, n, n + x[: k - 1]) for x in rows for n in nt or "0123" if node(n + x[: k - 1]))


def test_rows_that_meet(spark):
    g = DeBruijnGraph(spark.createDataFrame([(text(random.Random(1), 21), 1)], "kmer string, abundance int"), 21)
    plan = g.successors(g.oriented())._jdf.queryExecution().optimizedPlan().toString()
    assert "array(0, 1, 2, 3)" not in plan and "[0,1,2,3]" not in plan
