"""Three words a k-mer, checksums from words."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions.packed import unpacked
from strandloom.operators import counting as ct

RC = str.maketrans("0123", "2301")


def sample(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("0123") for _ in range(r.choice([0, 50, 63, 150])))) for i in range(20)]
    return rows, spark.createDataFrame([*rows, (99, None), (98, rows[3][1][:70] + "x" + rows[5][1])], "read_id long, d string")


@pytest.mark.parametrize("k", [41, 63, 93])
def test_words(spark, k):
    rows, reads = sample(spark)
    want = Counter()
    for d in [*(d for _, d in rows), rows[3][1][:70], rows[5][1]]:
        for i in range(len(d) - k + 1):
            want[min(d[i : i + k], d[i : i + k][::-1].translate(RC))] += 1
    counts = ct.packed_counts(reads, k)
    assert {x.kmer: x.abundance for x in counts.select(unpacked(k).alias("kmer"), "abundance").collect()} == dict(want)
    size = 64 * -(-2 * k // 64)
    total = f"{sum(int(x, 4) for x in want) % (1 << size):0{size // 4}x}"
    assert ct.checksum_words(counts, k, None).first().checksum == total
    assert ct.checksum_words(ct.count_kmers(reads, k), k).first().checksum == total


def test_minimizers_are_dealt_to_many_tasks(spark):
    _, reads = sample(spark)
    found = ct.count_kmers_by_minimizer(reads.where("d IS NOT NULL"), 15, 5)
    assert found.rdd.getNumPartitions() == ct.BUCKETS
    assert found.agg(F.sum("abundance")).first()[0] == ct.kmer_rows(reads, 15).count()
