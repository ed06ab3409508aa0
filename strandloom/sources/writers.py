"""Sinks: FASTA, FASTQ, unitig FASTA, GFA, DOT, histogram text, k-mer tables, albums, properties."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.encoding import letters


def write_fasta(reads: DataFrame, path: str, gzip: bool = False) -> None:
    reads.select(F.concat(F.lit(">"), F.coalesce("comment", F.lit("")), F.lit("\n"), "seq")).write.text(path, compression="gzip" if gzip else None)


def write_fastq(reads: DataFrame, path: str, gzip: bool = False) -> None:
    quality = F.coalesce("quality", F.expr("repeat('I', length(seq))"))
    reads.select(F.concat(F.lit("@"), F.coalesce("comment", F.lit("")), F.lit("\n"), "seq", F.lit("\n+\n"), quality)).write.text(path, compression="gzip" if gzip else None)


def convert_bank(reads: DataFrame, path: str) -> DataFrame:
    """Write reads as Parquet, a folder a bank, and return what was written: (bank_id, seq_number,
    total_nt)."""
    reads.write.mode("overwrite").partitionBy("bank_id").parquet(path)
    return reads.sparkSession.read.parquet(path).groupBy("bank_id").agg(F.count("*").alias("seq_number"), F.sum(F.length("seq")).alias("total_nt"))


def unitig_lines(unitigs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(value): records ``>id LN:i: KC:i: km:f: L:...`` of unitigs (id, seq as digits, n_kmers, kc) and
    links (from_id, from_sign, to_id, to_sign)."""
    rows = unitigs
    tail = F.lit("")
    if links is not None:
        one = F.format_string("L:%s:%d:%s", "from_sign", "to_id", "to_sign")
        own = links.groupBy(F.col("from_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(one)), " ").alias("l"))
        rows, tail = unitigs.join(own, "id", "left"), F.coalesce(F.concat(F.lit(" "), "l"), F.lit(""))
    head = F.format_string(">%d LN:i:%d KC:i:%d km:f:%.1f", "id", F.length("seq"), "kc", F.col("kc") / F.col("n_kmers"))
    return rows.select(F.concat(head, tail, F.lit("\n"), letters(F.col("seq"))).alias("value"))


def gfa_lines(unitigs: DataFrame, links: DataFrame, k: int) -> DataFrame:
    seg = unitigs.select(F.concat_ws("\t", F.lit("S"), F.col("id").cast("string"), letters(F.col("seq"))).alias("value"))
    link = links.select(F.concat_ws("\t", F.lit("L"), F.col("from_id").cast("string"), "from_sign", F.col("to_id").cast("string"), "to_sign", F.lit(f"{k - 1}M")).alias("value"))
    return seg.unionByName(link)


def dot_lines(edges: DataFrame) -> DataFrame:
    """(value): edges (source, target) in DOT syntax."""
    return edges.select(F.format_string("%s -> %s ;", letters(F.col("source")), letters(F.col("target"))).alias("value"))


def histogram_lines(hist: DataFrame) -> DataFrame:
    return hist.select(F.format_string("%d\t%d", "idx", "abundance").alias("value"))


def write_solid(counts: DataFrame, path: str, parts: int) -> None:
    """k-mers and abundances, dealt by hash into ``parts`` folders and sorted inside."""
    counts.withColumn("part", F.pmod(F.xxhash64("kmer"), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "kmer").write.mode("overwrite").partitionBy("part").parquet(path)


def kff_sections(counts: DataFrame, k: int) -> DataFrame:
    """(block binary): k-mers packed two bits a base (A=0, C=1, T=2, G=3), each followed by its count
    in four bytes, most significant first: the data of one raw section a batch."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = (2 * k + 7) // 8
            body = b"".join(int(d, 4).to_bytes(size, "big") + struct.pack(">I", n) for d, n in zip(b["kmer"], b["abundance"], strict=True))
            yield pd.DataFrame({"block": [body]})

    return counts.select("kmer", F.col("abundance").cast("bigint").alias("abundance")).mapInPandas(pack, "block binary")


def write_album(spark: SparkSession, uris: list[str], path: str) -> None:
    spark.createDataFrame([(u,) for u in uris], "value string").coalesce(1).write.mode("overwrite").text(path)


def properties_text(tree: list[tuple[int, str, str]]) -> str:
    """An ordered tree of (depth, key, value) as indented text."""
    return "\n".join(f"{'    ' * depth}{key:<{max(34 - 4 * depth, 1)}}: {value}" for depth, key, value in tree)


def properties_xml(tree: list[tuple[int, str, str]]) -> str:
    root = ElementTree.Element("properties")
    at = [root]
    for depth, key, value in tree:
        del at[depth + 1 :]
        node = ElementTree.SubElement(at[-1], key)
        node.text = value or None
        at.append(node)
    return ElementTree.tostring(root, encoding="unicode")


def read_properties_xml(text: str) -> list[tuple[int, str, str]]:
    out: list[tuple[int, str, str]] = []

    def walk(node: ElementTree.Element, depth: int) -> None:
        for child in node:
            out.append((depth, child.tag, (child.text or "").strip()))
            walk(child, depth + 1)

    walk(ElementTree.fromstring(text), 0)
    return out
