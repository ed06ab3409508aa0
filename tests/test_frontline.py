"""Side branches against a search node by node."""

import random

from pyspark.sql import functions as F

from strandloom.functions import encoding as enc
from strandloom.operators import traversal as tr
from strandloom.operators.graph import DeBruijnGraph
from strandloom.sources import readers as rd
from tests.test_traversal import DIGITS, Brute, rc

K = 7


def forked(seed, n=6):
    """Sequences with side branches that fork, lie across each other, fold back and are as long as the bound."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    out = []
    for _ in range(n):
        a = text(70)
        out += [a, a]
        for at in rng.sample(range(10, 50), 3):
            side = text(rng.choice([4, 9, 20, 21, 22, 23, 30])) + a[at : at + K]
            out += [side, text(rng.choice([3, 12, 25])) + side[2 : K + 4], text(5) + side[1 : K + 2]]
        i = rng.randrange(15, 45)
        out.append(a[:i] + rng.choice("ACGT") + a[i + 1 :])
        hair = text(8)
        out.append(hair + text(3) + hair[::-1].translate(str.maketrans("ACGT", "TGCA")) + a[20:30])
    return out


def compared(spark, seqs, k):
    brute = Brute([s.translate(DIGITS) for s in seqs], k)
    g = DeBruijnGraph.from_reads(rd.strings(spark, seqs).withColumn("d", enc.digits(F.col("seq"))), k)
    paths = tr.Paths(DeBruijnGraph(g.nodes.persist(), k))
    got = {(x.tail, x.head) for x in paths.short.collect()}
    arcs = {(p, o) for n in brute.n for o in {n, rc(n)} if len(brute.into(o)) > 1 for p in brute.into(o)}
    arcs = {(p, o) for p, o in arcs if p not in (o, rc(o))}
    want = {(p, o) for p, o in arcs if brute.short_side(o, p)}
    assert {x for x in got if x in arcs} == want
    return brute, paths, want


def test_branches_that_fork(spark):
    for seed in (1, 2):
        brute, paths, want = compared(spark, forked(seed), K)
        forks = [x for x in want if len(brute.into(x[0])) > 1]
        assert len(want) > 10 and (seed > 1 or forks)
    bounds = tr.Bounds()
    across = {x.fork: (x.text, x.end) for x in tr.bubbles(paths).collect()}
    assert across and all(x == brute.bubble(fork, bounds) for fork, x in across.items())


def test_dense_graph_and_bound(spark):
    """Random letters at a small k: searches that meet themselves, and levels that grow too broad."""
    rng = random.Random(5)
    compared(spark, ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(12)], 5)
    long = "".join(rng.choice("ACGT") for _ in range(60))
    for n in (3 * K + 1, 3 * K + 2):  # nodes of a dead end: the longest that is short, and one more
        side = "".join(rng.choice("ACGT") for _ in range(n + 1)) + long[31:36]
        compared(spark, [long, long, side], K)


def test_no_branches(spark):
    _, paths, want = compared(spark, ["AAACACCCCAACCA"], K)
    assert not want and paths.short.count() == 0
