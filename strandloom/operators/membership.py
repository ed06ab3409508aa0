"""Probabilistic membership as tables of set bits, its critical false positives, and balancing.

Exact semi joins answer membership in this library; these operators give what a Bloom filter of a
certain size would do, for sizing and comparison."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.encoding import neighbours


def bit_positions(kmer: Column, size: int, hashes: int) -> list[Column]:
    """``hashes`` (4 at most) bit positions below ``size``, from parts of one digest."""
    if not 1 <= hashes <= 4:
        raise ValueError("1 to 4 hashes")
    digest = F.md5(kmer)
    return [F.conv(F.substr(digest, F.lit(7 * j + 1), F.lit(7)), 16, 10).cast("bigint") % size for j in range(hashes)]


def bloom_bits(nodes: DataFrame, size: int, hashes: int) -> DataFrame:
    """(bit): the bits that the nodes set."""
    return nodes.select(F.explode(F.array(*bit_positions(F.col("kmer"), size, hashes))).alias("bit")).distinct()


def bloom_accepts(kmers: DataFrame, bits: DataFrame, size: int, hashes: int) -> DataFrame:
    """The k-mers all of whose bits are set: one semi join a hash."""
    out = kmers
    for p in bit_positions(F.col("kmer"), size, hashes):
        out = out.join(bits, p == F.col("bit"), "left_semi")
    return out


def critical_false_positives(graph, size: int, hashes: int) -> DataFrame:
    """(kmer): neighbours of nodes that are no nodes, but that the filter of all nodes accepts."""
    near = graph.nodes.select(F.explode(neighbours(F.col("kmer"), graph.k)).alias("x")).select("x.kmer").distinct()
    strangers = near.join(graph.nodes, "kmer", "left_anti")
    return bloom_accepts(strangers, bloom_bits(graph.nodes, size, hashes), size, hashes)


def balance(weights: dict[str, int], parts: int) -> dict[str, int]:
    """Heaviest first, each to the lightest part so far."""
    heap = [(0, p) for p in range(parts)]
    out = {}
    for key, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        load, p = heapq.heappop(heap)
        out[key] = p
        heapq.heappush(heap, (load + w, p))
    return out
