"""Unitigs are numbered in the order of their texts, and linked by number."""

import random

from pyspark.sql import functions as F

from strandloom.operators.graph import DeBruijnGraph, numbered


def test_numbers_and_links(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("0123") for _ in range(rng.randrange(6, 20))) for _ in range(300)})
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "seq string, place long").orderBy(F.rand(1))
    u = numbered(rows, "seq")
    assert all(r.id == r.place for r in u.collect()) and u.count() == len(texts)
    assert not numbered(rows.where("false"), "seq").count()
    g = DeBruijnGraph(None, 5)
    want = {(texts.index(r.from_seq), r.from_sign, texts.index(r.to_seq), r.to_sign) for r in g.unitig_links(rows.select("seq")).collect()}
    got = g.unitig_links(u.select("id", "seq"), "id")
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
