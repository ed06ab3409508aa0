"""Walks against walks node by node."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions import encoding as enc
from strandloom.operators import traversal as tr
from strandloom.operators.graph import DeBruijnGraph
from strandloom.sources import readers as rd

K = 7
RC = str.maketrans("0123", "2301")
DIGITS = str.maketrans("ACTG", "0123")


def rc(x):
    return x[::-1].translate(RC)


def can(x):
    return min(x, rc(x))


class Brute:
    """The same walks, one node at a time."""

    def __init__(self, seqs, k):
        self.k, self.n = k, Counter()
        for s in seqs:
            for i in range(len(s) - k + 1):
                self.n[can(s[i : i + k])] += 1

    def out(self, o):
        return [o[1:] + c for c in "0123" if can(o[1:] + c) in self.n]

    def into(self, o):
        return [c + o[:-1] for c in "0123" if can(c + o[:-1]) in self.n]

    def step(self, o):
        nxt = self.out(o)
        if len(nxt) != 1:
            return None, "no_extension" if not nxt else "out_branching"
        if len(self.into(nxt[0])) > 1:
            return None, "in_branching"
        return (nxt[0], None) if can(nxt[0]) != can(o) else (None, "mirror")

    def unitig(self, seed):
        text, at = seed, seed
        while True:
            nxt, stop = self.step(at)
            if nxt is None:
                return text, stop
            text, at = text + nxt[-1], nxt
            if at == seed:
                return text, "loop"

    def short_side(self, o, p):
        """Whether nothing is left of the ways back from p, a node before o, within 3 k + 1 levels of ten nodes."""
        seen, level = {can(o), can(p)}, [p]
        for _ in range(3 * self.k + 1):
            before = {can(q): q for x in level for q in self.into(x) if can(q) not in seen}
            seen |= set(before)
            level = list(before.values())
            if not level:
                return True
            if len(level) > 10 and _ < 3 * self.k:
                return False
        return False

    def end_of(self, fork, bounds):
        seen, front, depth = {can(fork)}, [fork], 0
        while True:
            if depth > 0:
                for o in front:
                    if any(can(p) not in seen and not self.short_side(o, p) for p in self.into(o)):
                        return None, depth, "in_branching"
            nxt = []
            for o in front:
                for t in self.out(o):
                    if can(t) not in seen:
                        seen.add(can(t))
                        nxt.append(t)
            front, depth = nxt, depth + 1
            if depth > bounds.depth:
                return None, depth, "depth"
            if len(front) > bounds.breadth:
                return None, depth, "breadth"
            if not front:
                return None, depth, "no_extension"
            if len(front) == 1:
                return front[0], depth, None

    def walks(self, fork, end, depth, bounds):
        found, bad = set(), []

        def go(o, text, used):
            if len(text) > depth + 2:
                bad.append("long")
            elif can(o) == can(end):
                found.add(text)
            else:
                for t in self.out(o):
                    if can(t) in used:
                        bad.append("loop")
                    else:
                        go(t, text + t[-1], used | {can(t)})

        go(fork, "", {can(fork)})
        return sorted(found), not bad and 0 < len(found) <= bounds.breadth

    def bubble(self, fork, bounds):
        end, depth, stop = self.end_of(fork, bounds)
        if stop:
            return None, None
        texts, good = self.walks(fork, end, depth, bounds)
        if not good:
            return None, None
        mean = sum(map(len, texts)) // len(texts)
        spread = (sum((len(t) - mean) ** 2 for t in texts) / len(texts)) ** 0.5
        alike = all(int(tr.identity(a, b) * 100) >= bounds.identity for i, a in enumerate(texts) for b in texts[i + 1 :])
        if mean > bounds.depth or (len(texts) == 1 and mean > self.k + 1) or spread > mean // 5 or not alike:
            return None, None
        score = lambda t: sum(self.n[can((fork + t)[i : i + self.k])] for i in range(len(t))) // len(t)
        text = max(texts, key=lambda t: (score(t), [-int(c) for c in t]))
        return text, (fork + text)[-self.k :]

    def contig(self, seed, bounds):
        text, at, taken = seed, seed, set()
        while True:
            nxt, _ = self.step(at)
            if nxt is not None:
                more = nxt[-1]
            else:
                if at in taken:
                    return text
                taken.add(at)
                more, _ = self.bubble(at, bounds)
                if more is None:
                    return text
            for c in more:
                text += c
                if can(text[-self.k :]) == can(seed):
                    return text
            at = text[-self.k :]


def sample(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = []
    for _ in range(4):
        a = text(60)
        seqs += [a, a]
        i = rng.randrange(15, 45)
        seqs.append(a[:i] + rng.choice("ACGT") + a[i + 1 :])  # a bubble
        seqs.append(a[20:30] + text(5))  # a tip
    ring = text(25)
    return [*seqs, ring + ring[: K - 1], text(40), *map("".join, [[text(30)] * 2])]


@pytest.mark.parametrize("seed", [1])
def test_walks_against_node_by_node(spark, seed):
    seqs = sample(seed)
    brute = Brute([s.translate(DIGITS) for s in seqs], K)
    g = DeBruijnGraph.from_reads(rd.strings(spark, seqs).withColumn("d", enc.digits(F.col("seq"))), K)
    g = DeBruijnGraph(g.nodes.persist(), K)
    paths = tr.Paths(g)
    seeds = g.oriented().select(F.col("o").alias("seed"))
    got = {x.seed: (x.text, x.stop) for x in tr.unitig_walks(paths, seeds).collect()}
    assert got == {o: brute.unitig(o) for n in brute.n for o in {n, rc(n)}}
    bounds = tr.Bounds()
    across = {x.fork: (x.text, x.end) for x in tr.bubbles(paths).collect()}
    for fork, x in across.items():
        assert x == brute.bubble(fork, bounds), fork
    assert any(x[0] and len(x[0]) > 1 for x in across.values())
    some = seeds.where(F.col("seed").isin([s.translate(DIGITS)[:K] for s in seqs]))
    rows = tr.contig_walks(paths, some).collect()
    assert {x.seed: x.text for x in rows} == {x.seed: brute.contig(x.seed, bounds) for x in rows} and len(rows) > 5
    assert any(x.bubbles for x in rows)
    found = tr.extensions(paths, some.limit(3), max_depth=120).collect()
    for s in {x.seed for x in found}:
        assert sorted(tuple(x)[1:] for x in found if x.seed == s) == breadth_first(brute, s, 120)


def breadth_first(brute, seed, most):
    queue, met, out = [(seed, 0)], {seed[1:]}, []
    while queue:
        o, depth = queue.pop(0)
        text, _ = brute.unitig(o)
        out.append((len(out), text, depth))
        n = len(text) - brute.k
        if depth + len(text) > most:
            continue
        last = text[-(brute.k - 1) :]
        if len(out) > 1 or n > 0:
            if last in met:
                continue
            met.add(last)
        queue += [(t, depth + n + 1) for t in brute.out(text[-brute.k :])]
    return out


def test_identity():
    assert tr.identity("0123", "0123") == 1 and tr.identity("0123", "0023") == 0.75
    assert tr.identity("0120123", "012123") == 6 / 7 and tr.identity("", "01") == 0
