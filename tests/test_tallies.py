"""m-mers of the smallest rank, tallied, against one k-mer after the other."""

import random
from collections import Counter

from strandloom.functions import minimizers as mz

RC = str.maketrans("0123", "2301")


def test_tallies_by_rank(spark):
    r, k, m = random.Random(3), 9, 3
    texts = ["".join(r.choice("0123") for _ in range(n)) for n in (0, 5, 9, 30, 200)] + ["0123012301x" + "3210" * 5]
    reads = spark.createDataFrame([(i, d) for i, d in enumerate([*texts, None])], "read_id long, d string")
    can = lambda x: min(x, x[::-1].translate(RC))
    ranks = {x.mmer: x["rank"] for x in mz.frequency_ranks(reads, m).collect()}
    mmers = Counter(can(d[i : i + m]) for d in texts for i in range(len(d) - m + 1) if "x" not in d[i : i + m])
    assert ranks == {x: i for i, x in enumerate(sorted(mmers, key=lambda x: (mmers[x], x)))}
    ranks.pop(max(ranks))  # one without a rank
    want = Counter()
    for d in texts:
        for i in range(len(d) - k + 1):
            f = d[i : i + k]
            if "x" not in f:
                want[min((can(f[j : j + m]) for j in range(k - m + 1)), key=lambda x: (ranks.get(x, 4**m), x))] += 1
    assert {x.minimizer: x.kmers for x in mz.tallies_by_rank(reads, k, m, ranks).collect()} == dict(want)
