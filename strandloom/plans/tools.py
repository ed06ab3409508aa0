"""What is done from a command line: build a graph from files, tell about a stored one, check it, and
make a bank of reads of a random reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.encoding import digits
from strandloom.operators.counting import bank_statistics
from strandloom.operators.graph import DeBruijnGraph
from strandloom.plans.options import build, parse
from strandloom.sources.readers import open_banks, random_bank, split_reference
from strandloom.sources.writers import write_fasta


def build_graph(spark: SparkSession, text: str) -> DeBruijnGraph:
    """The graph that an option string asks for, of the banks in ``-in``; stored with its properties
    and those of its reads in ``-out``, if that is given."""
    options = parse(text)
    if not options.in_:
        raise ValueError("-in names the banks to read")
    reads = open_banks(spark, options.in_).withColumn("d", digits(F.col("seq")))
    graph = build(reads, options)
    if options.out:
        s = bank_statistics(reads, options.kmer_size).first().asDict()
        graph.save(options.out, **s, abundance_min=",".join(map(str, options.abundance_min)), abundance_max=options.abundance_max, solidity_kind=options.solidity_kind)
        graph = DeBruijnGraph.load(spark, options.out)
    return graph


def check_graph(spark: SparkSession, path: str) -> DataFrame:
    """One row: nodes, edges, branching nodes, abundances and checksums of a stored graph."""
    return DeBruijnGraph.load(spark, path).digest()


def generate_bank(spark: SparkSession, path: str, length: int, read_size: int, overlap: int, coverage: int, seed: int = 1) -> DataFrame:
    """Reads of a random reference of ``length`` letters, ``coverage`` times over, written as FASTA;
    (pass, start, read) of what was written."""
    reference = random_bank(spark, 1, length, seed).select(F.col("seq").alias("d"))
    rows = split_reference(reference, read_size, overlap, coverage)
    write_fasta(rows.select(F.format_string("pass_%d_start_%d", "pass", "start").alias("comment"), F.col("read").alias("seq")), path)
    return rows
