"""k-mers of reads found among nodes by word, against texts."""

import random
from collections import Counter

from pyspark.sql import functions as F

from strandloom.functions import encoding as enc
from strandloom.operators.graph import DeBruijnGraph, read_branching
from strandloom.operators.iterate import cut


def test_among_reads(spark):
    r = random.Random(7)
    reads = [(i, "".join(r.choice("0123") for _ in range(r.choice([0, 6, 7, 40])))) for i in range(12)]
    reads = spark.createDataFrame([*reads, (50, "0123012x0123012"), (51, None), (52, reads[3][1] * 2)], "read_id long, d string")
    g = DeBruijnGraph.from_reads(reads, 7, 2)
    g = DeBruijnGraph(cut(g.nodes), 7)
    rows = lambda df: Counter(map(tuple, df.collect()))
    asked = reads.select("read_id", F.posexplode(enc.kmers(F.col("d"), 7)).alias("pos", "q"))
    found = g.among_reads(reads, ("read_id",), pos="pos")
    assert rows(found) == rows(g.abundance_of(asked, "q").select("read_id", "pos", "abundance")) and rows(found)
    assert "string" not in dict(found.dtypes).values() and dict(found.dtypes)["pos"] == "bigint"
    assert rows(g.among_reads(reads, ("read_id",), some=g.nodes)) == rows(g.contains(asked, "q").select("read_id"))
    assert rows(read_branching(g, reads, "read_id")) == rows(read_branching(g, reads, "read_id", enc.canonical_kmers(F.col("d"), 7)))
