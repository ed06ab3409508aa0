"""Paths and branching edges come from unitigs, and are those found node by node."""

import random
from collections import Counter

import pytest

from strandloom.functions.encoding import revcomp
from strandloom.operators import traversal as tr
from strandloom.operators.graph import DeBruijnGraph
from strandloom.operators.iterate import cut

K = 7
RC = str.maketrans("0123", "2301")


def sample(spark, seed):
    """Random reads, a ring, a single letter, and a read that ends in its own mirror image."""
    r = random.Random(seed)
    reads = ["".join(r.choice("0123") for _ in range(r.choice([20, 40]))) for _ in range(8)]
    reads += ["0" * 12, "323320203213233202032132332020321", reads[0] + reads[0][::-1].translate(RC)]
    g = DeBruijnGraph.from_reads(spark.createDataFrame([(i, x) for i, x in enumerate(reads)], "read_id long, d string"), K)
    return DeBruijnGraph(cut(g.nodes), K)


def rows(df):
    return Counter(map(tuple, df.collect()))


def no_nodes(*_):
    raise AssertionError("all nodes were ranked or joined")


@pytest.mark.parametrize("seed", [1, 2])
def test_branching_edges(spark, monkeypatch, seed):
    g = sample(spark, seed)
    want = rows(g._branching_edges_by_node())
    for name in ("edges", "links", "degrees"):
        monkeypatch.setattr(DeBruijnGraph, name, no_nodes)
    assert rows(g.branching_edges()) == want


def test_paths(spark, monkeypatch):
    g = sample(spark, 3)
    oriented, edges, steps = g.oriented().select("o"), rows(g.edges().select("source", "target")), {x.o: x.step for x in g.avance().collect()}
    for name in ("edges", "links", "chains", "avance"):
        monkeypatch.setattr(DeBruijnGraph, name, no_nodes)
    p = tr.Paths(g)
    assert rows(p.places.select("o")) == rows(oriented)
    assert p.unitigs.where("circular").count()
    assert rows(p.following(oriented)) == edges
    stop = {"no_extension": 0, "out_branching": -1, "in_branching": -2, "mirror": 1}
    assert all(stop[x.stop] == steps[x.tail] for x in p.stops.collect())
    seeds = g.nodes.selectExpr("kmer AS seed")
    assert tr.extensions(p, seeds, 60, 9).count() and tr.unitig_walks(p, seeds).count() == g.nodes.count()
    ring = p.unitigs.where("circular").select(revcomp("head").alias("at"))
    assert {(x.tail, x.around) for x in p.ahead(ring).collect()} == {(x.at, True) for x in ring.collect()}
