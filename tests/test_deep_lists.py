"""Depth first, a search is given what follows a walk together: rounds do not follow the levels of a search."""

import random

from pyspark.sql import functions as F

from strandloom.functions import encoding as enc
from strandloom.operators import extend
from strandloom.operators import traversal as tr
from strandloom.operators.graph import DeBruijnGraph
from strandloom.sources import readers as rd
from tests.test_compaction import text

K = 11


def test_rounds_of_a_long_chain_of_forks(spark, monkeypatch):
    rng = random.Random(8)
    base = text(rng, 160)
    # a dead end after every fourth letter
    seqs = [base, *(base[at : at + 14] + str((int(base[at + 14]) + 1) % 4) + text(rng, 3) for at in range(10, 140, 4))]
    reads = rd.strings(spark, [s.translate(str.maketrans("0123", "ACTG")) for s in seqs]).withColumn("d", enc.digits(F.col("seq")))
    g = DeBruijnGraph.from_reads(reads, K)
    paths = tr.Paths(DeBruijnGraph(g.nodes.persist(), K))
    rounds, searches = [], extend._searches
    monkeypatch.setattr(extend, "_searches", lambda *bounds: rounds.append(1) or searches(*bounds))
    got = sorted(tuple(r) for r in extend.ordered_extensions(paths, spark.createDataFrame([(base[:K],)], "seed string"), 300, 40).select("number", "depth", "text").collect())
    assert len(got) == 41 and max(d for _, d, _ in got) > 70
    assert len(rounds) <= 5


def test_lists_are_in_the_order_of_a_search():
    entry = lambda *x: [{"id": i, "d": d} for i, d in x]
    # 1 leads to 2 and 3; 2 to 4 and 5; 3 to 2 and 6
    x = {"walks": entry((1, 0), (2, 1), (3, 1)), "more": [{"pos": 1, "walks": entry((2, 0), (4, 1), (5, 1))}, {"pos": 2, "walks": entry((3, 0), (2, 1), (6, 1))}]}
    y = {**x}
    extend.deeper(x, 1, 64)
    assert [e["id"] for e in x["walks"]] == [1, 2, 4, 5, 3, 6]
    extend.deeper(y, 1, 4)
    assert [e["id"] for e in y["walks"]] == [1, 2, 4, 5]
