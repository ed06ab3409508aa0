"""Contigs that share no node, against seeds taken one after the other, node by node."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import encoding as enc
from strandloom.operators import contigs as ct
from strandloom.operators import traversal as tr
from strandloom.operators.graph import DeBruijnGraph
from strandloom.sources import readers as rd
from tests.test_traversal import DIGITS, Brute, can, rc, sample

K = 7


def nodes(text, k=K):
    return {can(text[i : i + k]) for i in range(len(text) - k + 1)}


def all_unitigs(brute):
    """(circular, text), each once, its first node the smaller of both orientations."""
    met, out = set(), []
    for n in sorted(brute.n):
        if n in met:
            continue
        text, stop = brute.unitig(rc(n))
        if stop == "loop":
            text = text[:-1]
        else:
            text, _ = brute.unitig(rc(text[-K:]))
            text = min(text, rc(text), key=lambda t: t[:K])
        met |= nodes(text)
        out.append((stop == "loop", text))
    return out


def one_after_the_other(brute, seeds, bounds):
    """(text, nodes) of contigs of seed unitigs in their order."""
    marked, out = set(), []

    def side(text):
        added, wide = "", 0
        while True:
            at = (text + added)[-K:]
            more, end = brute.bubble(at, bounds)
            if more is None:
                return added, wide
            goal, depth, _ = brute.end_of(at, bounds)
            on = brute.unitig(end)[0][K:]
            met = nodes(end + on)
            for t in brute.walks(at, goal, depth, bounds)[0]:
                met |= nodes((at + t)[1:])
            if met & marked:
                return added, wide
            marked.update(met)
            added, wide = added + more + on, wide + (len(more) > 1)

    for text in seeds:
        if nodes(text) & marked:
            continue
        marked.update(nodes(text))
        right, a = side(text)
        left, b = side(rc(text))
        out.append((rc(left) + text + right, a + b))
    return out


def graph_of(spark, seqs):
    g = DeBruijnGraph.from_reads(rd.strings(spark, seqs).withColumn("d", enc.digits(F.col("seq"))), K)
    return DeBruijnGraph(g.nodes.persist(), K)


@pytest.mark.parametrize("seed", [1, 2])
def test_contigs_against_one_after_the_other(spark, seed):
    seqs = sample(seed)
    if seed == 2:  # walks that meet: three ways into one path, and out of it
        rng = random.Random(9)
        text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
        mid = text(30)
        seqs = seqs[:4] + [text(20 + 5 * i) + mid + text(40 - 5 * i) for i in range(3)] + [mid + text(3) + mid]
    brute, bounds = Brute([s.translate(DIGITS) for s in seqs], K), tr.Bounds()
    every = all_unitigs(brute)
    paths = tr.Paths(graph_of(spark, seqs))
    order = sorted(every, key=lambda x: (-len(x[1]), x[1][:K]))
    want = one_after_the_other(brute, [t for _, t in order], bounds)
    got = ct.contigs(paths).collect()
    rings = {frozenset(nodes(t)) for c, t in every if c}
    plain = lambda rows: sorted((t, b) for t, b in rows if frozenset(nodes(t)) not in rings)
    assert plain([(x.text, x.bubbles) for x in got]) == plain(want)
    assert rings <= {frozenset(nodes(x.text)) for x in got}
    assert sum(len(nodes(x.text)) for x in got) == len(set().union(*(nodes(x.text) for x in got)))
    assert any(x.bubbles for x in got) and any(x.unitigs > 2 for x in got)

    if seed == 1:
        return
    # an order of one's own; of the seeds, one is within a unitig
    lines = [t for c, t in every if not c]
    random.Random(seed).shuffle(lines)
    some = lines[: len(lines) * 2 // 3]
    inside = max(lines, key=len)[2 : 2 + K]
    table = spark.createDataFrame([(t[:K], i) for i, t in enumerate(some)] + [(inside, 10**6)], "seed string, place int")
    got = ct.contigs(paths, table).collect()
    assert sorted((x.text, x.bubbles) for x in got) == sorted(one_after_the_other(brute, some, bounds))
    assert ct.contigs(paths, table.limit(0)).collect() == []
