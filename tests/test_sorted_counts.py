"""Long k-mers are counted in the order of their words, without a table of partial sums."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import packed
from strandloom.operators import counting as ct


@pytest.mark.parametrize("k, canon", [(13, True), (21, False), (31, True)])
def test_same_counts(spark, k, canon):
    rng = random.Random(k)
    base = "".join(rng.choice("0123") for _ in range(300))
    reads = [base, base[50:200], "0" * 200, base[:40] + "N" + base[41:], "", None, base[: k - 1], base[:k]] * 3
    df = spark.createDataFrame([(x,) for x in reads], "d string").repartition(3)
    want = {(r.w0, r["count"]) for r in packed.packed_rows(df, k, (), "d", canon).groupBy("w0").count().collect()}
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        got = ct.packed_counts(df, k, "d", canon)
        rows = [(r.w0, r.abundance) for r in got.collect()]
        small = packed.packed_tallies(df, k, "d", canon, tally=50).groupBy("w0").agg(F.sum("n").alias("n"))
        assert {(r.w0, r.n) for r in small.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert len(rows) == len(want) and set(rows) == want
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert not ct.packed_counts(df.where("false"), k).count()
