"""What a compact read store asks about reads: anchors, and qualities that may be smoothed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.encoding import canonical_kmers
from strandloom.operators.graph import DeBruijnGraph


def _solid_positions(reads: DataFrame, solid: DataFrame, k: int, id_col: str, d: str) -> DataFrame:
    rows = reads.select(id_col, F.posexplode(canonical_kmers(F.col(d), k)).alias("pos", "kmer"))
    return rows.join(solid.select("kmer"), "kmer", "left_semi").select(id_col, "pos")


def anchorable_reads(reads: DataFrame, graph: DeBruijnGraph, id_col: str, d: str = "d") -> DataFrame:
    """(id): reads with two solid k-mers that do not overlap."""
    at = _solid_positions(reads, graph.nodes, graph.k, id_col, d).groupBy(id_col).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return at.where(F.col("hi") - F.col("lo") >= graph.k).select(id_col)


def smooth_quality(reads: DataFrame, solid: DataFrame, k: int, cover: int, id_col: str, d: str = "d", quality: str = "quality") -> DataFrame:
    """Reads with ``@`` for the quality of letters that ``cover`` solid k-mers at least hold; other
    letters keep theirs. Positions of one read are gathered, as many as it has k-mers."""
    at = _solid_positions(reads, solid, k, id_col, d).groupBy(id_col).agg(F.collect_list("pos").alias("_at"))
    rows = reads.join(at, id_col, "left").withColumn("_at", F.coalesce("_at", F.array().cast("array<int>")))
    letter = lambda i: F.when(F.size(F.filter("_at", lambda p: (p <= i - 1) & (p > i - 1 - k))) >= cover, F.lit("@")).otherwise(F.substr(quality, i, F.lit(1)))
    new = F.when(F.length(quality) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(quality)), letter), "")).otherwise(F.col(quality))
    return rows.withColumn(quality, new).drop("_at")
