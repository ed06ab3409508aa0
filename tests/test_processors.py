"""Chains of count processors against plain loops."""

from collections import Counter

import pytest

from strandloom.operators import processors as pr


class Longest(pr.CountProcessor):
    """One's own: the greatest k-mer of those that get here, and how many batches' rows it saw."""

    name = "longest"

    def begin(self):
        return ("", 0)

    def process(self, state, kmers, counts):
        return (max([state[0], *kmers.to_pylist()]), state[1] + len(kmers)), None

    def merge(self, a, b):
        return (max(a[0], b[0]), a[1] + b[1])

    def finish(self, state):
        return {state[0]: state[1]}


def figures(df):
    return {(x.processor, x.key): x.value for x in df.collect()}


def test_chain_against_a_loop(spark):
    rows = [(f"{i:03d}", i % 7, None if i % 5 == 0 else i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "kmer string, c0 int, c1 int").repartition(40)  # three levels of merges
    got = figures(pr.process_in_chain(df, pr.Totals(), pr.Solid(3, 6), pr.Histogram(5), Longest(), pr.SharedBanks(["a", "b"]), pr.Totals("kept")))
    plain = [(k, a, b or 0) for k, a, b in rows]
    kept = [x for x in plain if 3 <= x[1] + x[2] <= 6]
    want = {("totals", "distinct"): 500, ("totals", "occurrences"): sum(a + b for _, a, b in plain), ("totals", "most"): max(a + b for _, a, b in plain)}
    want |= {("solid", "solid"): len(kept), ("solid", "weak"): 500 - len(kept)}
    want |= {("histogram", str(i)): n for i, n in Counter(min(a + b, 5) for _, a, b in kept).items()}
    want |= {("longest", max(kept)[0]): len(kept)}
    want |= {("shared", "a-a"): sum(a > 0 for _, a, b in kept), ("shared", "a-b"): sum(a > 0 and b > 0 for _, a, b in kept), ("shared", "b-b"): sum(b > 0 for _, a, b in kept)}
    want |= {("kept", "distinct"): len(kept), ("kept", "occurrences"): sum(a + b for _, a, b in kept), ("kept", "most"): max(a + b for _, a, b in kept)}
    assert got == want


def test_no_rows_and_names(spark):
    df = spark.createDataFrame([], "kmer string, c0 int")
    assert figures(pr.process_in_chain(df, pr.Totals(), pr.Histogram())) == {("totals", "distinct"): 0, ("totals", "occurrences"): 0, ("totals", "most"): 0}
    with pytest.raises(ValueError, match="one name"):
        pr.process_in_chain(df, pr.Totals(), pr.Totals())
