"""The text of a histogram has a line for each abundance, however large."""

from collections import Counter

from strandloom.operators import histogram as hg
from strandloom.operators.counting import count_kmers
from strandloom.sources import writers as wr

RC = str.maketrans("0123", "2301")


def test_histogram_text_has_no_last_bin(spark):
    reads = spark.createDataFrame([(0, "0123" * 30_000)], "read_id long, d string")
    lines = {x.value for x in wr.histogram_lines(hg.histogram(count_kmers(reads, 5), most=None)).collect()}
    want = Counter()
    d = "0123" * 30_000
    for i in range(len(d) - 4):
        want[min(d[i : i + 5], d[i : i + 5][::-1].translate(RC))] += 1
    assert lines == {f"{a}\t{n}" for a, n in Counter(want.values()).items()}
