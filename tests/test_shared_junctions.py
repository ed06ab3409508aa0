"""Bulges of single unitigs are found without the links of all unitigs."""

import random
from collections import defaultdict

import pytest

from strandloom.operators import simplify as sp
from strandloom.operators.graph import DeBruijnGraph
from strandloom.operators.iterate import cut

K = 7
RC = str.maketrans("0123", "2301")


def rc(s):
    return s[::-1].translate(RC)


@pytest.mark.parametrize("seed", [1, 2])
def test_bulges(spark, monkeypatch, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("0123") for _ in range(300))
    seqs = [base]
    for _ in range(8):
        at, s = rng.randrange(20, 280), rng.choice(seqs)
        seqs.append(s[:at] + rng.choice("0123") + s[at + rng.randrange(0, 3) :])
    g = DeBruijnGraph.from_reads(spark.createDataFrame([(i, rc(s) if i % 2 else s) for i, s in enumerate(seqs)], "read_id long, d string"), K)
    g = DeBruijnGraph(cut(g.nodes), K)
    unitigs = [(r.seq, r.n_kmers, r.kc / r.n_kmers) for r in g.unitigs().collect()]
    begin = {o[: K - 1] for s, *_ in unitigs for o in (s, rc(s))}
    groups, limits = defaultdict(list), sp.Limits(bulge_length=2, bulge_add=3, bulge_path_add=4)
    for s, n, mean in unitigs:
        x, y = s[: K - 1], s[1 - K :]
        if y in begin and rc(x) in begin and n <= limits.bulge_length * K + limits.bulge_add:
            groups[min((x, y), (rc(y), rc(x)))].append((mean, n, s[:K], s))
    want = {u[3] for rows in groups.values() for u in rows if u != max(rows) and abs(u[1] - max(rows)[1]) <= limits.bulge_path_add}
    assert want

    def none(*_):
        raise AssertionError("all unitigs were linked")

    monkeypatch.setattr(sp, "_ends", none)
    assert sorted(r.seq for r in sp.doomed_bulges(g, limits).collect()) == sorted(want)
