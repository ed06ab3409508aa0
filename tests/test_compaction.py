"""Contracted compaction against a walk over all k-mers, one after the other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import compaction, iterate
from strandloom.operators.graph import DeBruijnGraph

RC = str.maketrans("0123", "2301")


def rc(s):
    return s[::-1].translate(RC)


def canon(s):
    return min(s, rc(s))


def brute(counts, k):
    """{seq: (abundances, circular)} by walking from every k-mer that no simple path leads into."""
    out = {}
    o = {x for m in counts for x in (m, rc(m))}
    after = lambda x: [x[1:] + c for c in "0123" if x[1:] + c in o]
    into = lambda x: [c + x[:-1] for c in "0123" if c + x[:-1] in o]

    def step(x):
        n = after(x)
        return n[0] if len(n) == 1 and len(into(n[0])) == 1 and canon(n[0]) != canon(x) else None

    has_before = {step(x) for x in o}
    met = set()
    for x in sorted(o - has_before):
        path = [x]
        while (n := step(path[-1])) is not None:
            path.append(n)
        met |= set(path)
        seq = path[0] + "".join(p[-1] for p in path[1:])
        if seq <= rc(seq):
            out[seq] = ([counts[canon(p)] for p in path], False)
    for x in sorted(o - met, key=canon):
        if x in met or x != canon(x):
            continue
        ring = [x]
        while (n := step(ring[-1])) != x:
            ring.append(n)
        met |= set(ring) | set(map(rc, ring))
        out[x + "".join(p[-1] for p in ring[1:])] = ([counts[canon(p)] for p in ring], True)
    return out


def kmers_of(seqs, k, rng):
    return {canon(s[i : i + k]): rng.randrange(1, 50) for s in seqs for i in range(len(s) - k + 1)}


def graph_of(spark, counts, k):
    return DeBruijnGraph(spark.createDataFrame(list(counts.items()), "kmer string, abundance int").repartition(3), k)


def text(rng, n):
    return "".join(rng.choice("0123") for _ in range(n))


def cases():
    rng = random.Random(5)
    yield 5, ["0" * 12, text(rng, 40), text(rng, 9)]
    for k in (3, 5, 7):
        yield k, [text(rng, rng.randrange(k, 60)) for _ in range(4)]
    base = text(rng, 400)
    variant = base[:150] + "0" + base[151:]
    ring = text(rng, 90)
    yield 21, [base, variant, rc(base[100:300]) + text(rng, 50), ring + ring[:20], text(rng, 21)]
    small = text(rng, 40)
    yield 41, [base, variant, ring + ring[:40], small + small + small[:5]]
    yield 65, [base, variant, ring + ring[:64]]


@pytest.mark.parametrize("k, seqs", list(cases()))
@pytest.mark.parametrize("way", ["usual", "hot", "rounds"])
def test_unitigs(spark, monkeypatch, k, seqs, way):
    if way == "hot":  # no minimizer stays together
        monkeypatch.setattr(compaction, "max", lambda *x: 1 if x[0] == 4096 else max(*x), raising=False)
    if way == "rounds":  # no task takes over the loop
        monkeypatch.setattr(compaction, "ranked", lambda start: iterate.ranked(start, one_task=0))
    counts = kmers_of(seqs, k, random.Random(1))
    got = {r.seq: (r.abundances, r.circular) for r in graph_of(spark, counts, k).unitigs().collect()}
    assert got == brute(counts, k)


def test_even_k_and_empty(spark):
    counts = kmers_of([text(random.Random(7), 80), "0202020202"], 6, random.Random(1))
    got = {r.seq: (r.abundances, r.circular) for r in graph_of(spark, counts, 6).unitigs().collect()}
    assert set(got) == set(brute(counts, 6))
    assert DeBruijnGraph(spark.createDataFrame([], "kmer string, abundance int"), 21).unitigs().count() == 0


def test_long_path_takes_few_tables(spark, monkeypatch):
    """4,000 k-mers on one path: four tables written on the way, one left."""
    made = []
    for module in (compaction, iterate):
        monkeypatch.setattr(module, "cut", lambda df, f=iterate.cut, **m: made.append(f(df, **m)) or made[-1])
    gone = []
    for module in (compaction, iterate):
        monkeypatch.setattr(module, "drop", lambda df, f=iterate.drop: gone.append(df) or f(df))
    counts = kmers_of([text(random.Random(8), 4020)], 21, random.Random(1))
    u = graph_of(spark, counts, 21).unitigs()
    assert [r.n_kmers for r in u.collect()] == [4000]
    assert len(made) - len(gone) == 1 and len(made) <= 8


def test_ranks_in_rounds_and_in_one_task(spark):
    rng = random.Random(9)
    names = rng.sample(range(10**6), 700)
    before, at = {}, 0
    for size in (1, 2, 37, 260):
        for a, b in zip([None, *names[at : at + size - 1]], names[at : at + size], strict=True):
            before[b] = a
        at += size
    for size in (1, 2, 5, 300):
        ring = names[at : at + size]
        before |= dict(zip(ring, [ring[-1], *ring[:-1]], strict=True))
        at += size
    df = spark.createDataFrame(list(before.items()), "o long, before long").repartition(4)

    def want(o):
        n = 0
        while before[o] is not None:
            o, n = before[o], n + 1
        return o, n

    for most in (0, 100, 1 << 20):
        paths, rings = iterate.ranked(df, most)
        got = {r.o: (r.ptr, r["rank"]) for r in paths.collect()}
        assert len(got) == 300 and all(want(o) == g for o, g in got.items())
        assert {(r.o, r.before) for r in rings.collect()} == {(o, b) for o, b in before.items() if o not in got}
    low = iterate.smallest_on_rings(rings, F.col("o"))
    assert low.select("low").distinct().count() == 4


def test_rotated_ring():
    ring = text(random.Random(3), 50)
    k, n = 7, 50
    names = {}
    for s in (ring, rc(ring)):
        for i in range(n):
            t = (s[i:] + s[:i]) * 2
            a = list(range(n)) if s == ring else [(n - k - j) % n for j in range(n)]
            names[compaction.rotated(t[: n + k - 1], a[i:] + a[:i], k)[0]] = compaction.rotated(t[: n + k - 1], a[i:] + a[:i], k)[1]
    assert len(names) == 1
    (seq, a), = names.items()
    assert seq[:k] == min(canon((ring * 2)[i : i + k]) for i in range(n)) and sorted(a) == list(range(n))
    assert np.unique(np.diff(a) % n).tolist() in ([1], [n - 1])
