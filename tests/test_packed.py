"""Packed k-mers against digit strings."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import packed
from strandloom.operators import counting as ct
from strandloom.operators.graph import DeBruijnGraph
from tests.test_compaction import canon, graph_of, kmers_of, rc, text


def number(s):
    return int(s, 4)


@pytest.mark.parametrize("k", [1, 2, 3, 16, 21, 30, 31, 32, 41, 61, 62])
def test_windows(k):
    s = text(random.Random(k), 200)
    codes = np.frombuffer(s.encode(), np.uint8) & 3
    want = [s[i : i + k] for i in range(len(s) - k + 1)]
    split = lambda x: [number(x)] if k <= 31 else [number(x[: k - 31]), number(x[k - 31 :])]
    for canonical, names in ((False, want), (True, list(map(canon, want)))):
        got = packed.packed_windows(codes, k, canonical)
        assert [list(map(int, w)) for w in zip(*got, strict=True)] == [split(x) for x in names]


@pytest.mark.parametrize("k", [1, 4, 15, 31, 33, 62, 63, 70])
def test_counts(spark, monkeypatch, k):
    monkeypatch.setattr(packed, "BLOCK", 50)  # reads run over many blocks
    rng = random.Random(k)
    seqs = [text(rng, n) for n in (0, k - 1, k, 300, 90)] + ["N".join(text(rng, 80) for _ in range(3)), "x" + text(rng, 99) + "é" + text(rng, 70), "2" * 100]
    rows = [(i % 3, s) for i, s in enumerate(seqs)] + [(0, None), (1, seqs[3]), (None, seqs[4])]
    df = spark.createDataFrame(rows, "bank int, d string").repartition(2)
    want, by_bank = Counter(), {}
    for b, s in rows:
        for i in range(len(s or "") - k + 1):
            x = s[i : i + k]
            if set(x) <= set("0123"):
                want[canon(x)] += 1
                by_bank.setdefault(canon(x), Counter())[b] += 1
    assert {r.kmer: r.abundance for r in ct.count_kmers(df, k).collect()} == want
    got = {r.kmer: (r.c0, r.c1) for r in ct.bank_counts(df, k, "bank", [2, 1]).collect()}
    assert got == {x: (c[2], c[1]) for x, c in by_bank.items()}


@pytest.mark.parametrize("k", [2, 5, 21, 31])
def test_words_as_columns(spark, k):
    rng = random.Random(k)
    names = [text(rng, k) for _ in range(50)] + ["0" * k, "3" * k]
    rows = spark.createDataFrame([(s,) for s in names], "d string").withColumn("w0", packed.packed(F.col("d"), k))
    got = rows.select("d", "w0", packed.unpacked(k).alias("s"), packed.revcomp_word(F.col("w0"), k).alias("rc"), packed.prefix_word(F.col("w0")).alias("p"), packed.suffix_word(F.col("w0"), k).alias("t")).collect()
    for r in got:
        assert r.s == r.d and (r.w0, r.rc, r.p, r.t) == (number(r.d), number(rc(r.d)), number(r.d[:-1]), number(r.d[1:]))


@pytest.mark.parametrize("k", [3, 4, 6, 7, 21, 33, 34])
def test_degrees(spark, k):
    rng = random.Random(k)
    seqs = [text(rng, 120), "0" * (k + 3), "02" * k, "13" * k, "0022" * k, rc(text(rng, 40))]
    counts = kmers_of(seqs, k, rng)
    o = {x for m in counts for x in (m, rc(m))}
    want = {m: (sum(c + m[:-1] in o for c in "0123"), sum(m[1:] + c in o for c in "0123")) for m in counts}
    assert {r.kmer: (r.indegree, r.outdegree) for r in graph_of(spark, counts, k).degrees().collect()} == want


def test_limits(spark):
    with pytest.raises(ValueError):
        packed.words(63)
    assert DeBruijnGraph.from_reads(spark.createDataFrame([], "d string"), 21).degrees().count() == 0


def test_checksum_of_several_words(spark):
    rng = random.Random(1)
    for k in (21, 41, 63, 70):
        names = [text(rng, k) for _ in range(40)] + ["3" * k] * 5
        n = 64 * -(-2 * k // 64)
        got = ct.checksum_words(spark.createDataFrame([(s,) for s in names], "kmer string"), k).first().checksum
        assert len(got) == n // 4 and int(got, 16) == sum(map(number, names)) % (1 << n)
    assert int(ct.checksum_words(spark.createDataFrame([], "kmer string"), 41).first().checksum, 16) == 0
