import random
import re

import numpy as np
import pytest

from strandloom.llm.common import Scratch
from strandloom.llm.ngram_join import long_difference, long_signature, least_difference, signature, similar_documents


def brute(rows, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (k, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((k, len(sets[i]), min(same) if k is not None else None))
    return out


def near(rng, words, times):
    w = list(words)
    for _ in range(times):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return w


@pytest.mark.parametrize("small", [2, 48])
def test_against_all_pairs(spark, small):
    rng = random.Random(small)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(40)
    rows, i = [], 0

    def add(words):
        nonlocal i
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
        i += 1

    for _ in range(15):
        add(text(rng.randint(1, 90)))
    base = text(120)
    for _ in range(70):  # a large group of near copies, and of copies
        add(near(rng, base, rng.choice([0, 1, 2, 3, 6])))
    for _ in range(30):  # a passage in most of the text: close, but mostly not linked
        add(passage + text(rng.choice([4, 8, 15, 30])))
    chain = text(100)
    for _ in range(12):  # a chain: neighbours link, the ends do not
        add(chain)
        chain = near(rng, chain, 2)
    rows += [(i, None), (i + 1, ""), (i + 2, " \n "), (i + 3, "one two"), (i + 4, "ONE  two"), (None, "one two"), (None, None), (5, "again and again and again and again"), (i + 3, "one two")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, g string, n int")
    got = similar_documents(df, Scratch(spark, "t"), small=small, rounds=3 if small == 2 else 6).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_signatures_bound_the_difference(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in (1, 20, 300, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 2**63, rng.integers(0, n + 1)).astype(np.uint64)])
        differ = len(set(a) ^ set(b))
        assert long_difference(long_signature(a), long_signature(b)) <= differ
        rows.append((signature(a).tolist(), signature(b).tolist(), differ))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, differ long")
    for x in df.select(least_difference(df.a, df.b).alias("low"), "differ").collect():
        assert x.differ * 0.2 < x.low <= x.differ or x.differ > 1000 > x.low


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert similar_documents(df, Scratch(spark, "t")).count() == 0
