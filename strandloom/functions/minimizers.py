"""Minimizers of k-mers and the super-k-mers that they cut reads into."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.encoding import canonical, canonical_kmers, is_valid, kmers, let
from strandloom.functions.packed import packed_rows, packed_windows, read_blocks, unpacked


def mmers(kmer: Column, m: int, canon: bool = True) -> Column:
    out = kmers(kmer, m)
    return F.transform(out, canonical) if canon else out


def allowed(mmer: Column) -> Column:
    """Minimizers hold AA nowhere but as their prefix."""
    return ~F.substr(mmer, F.lit(2)).contains("00")


def default_minimizer(m: int) -> Column:
    """What a k-mer without allowed m-mer has: the greatest value."""
    return F.lit("3" * m)


def minimizer(kmer: Column, m: int, canon: bool = True) -> Column:
    """The smallest allowed m-mer of a k-mer."""
    return F.coalesce(F.array_min(F.filter(mmers(kmer, m, canon), allowed)), default_minimizer(m))


def minimizer_position(kmer: Column, m: int, canon: bool = True) -> Column:
    """Offset of the rightmost smallest allowed m-mer, -1 if there is none."""
    found = F.filter(F.transform(mmers(kmer, m, canon), lambda x, i: F.struct(x.alias("v"), (-i).alias("p"))), lambda s: allowed(s.v))
    return F.coalesce(-F.array_min(found).p, F.lit(-1))


def best_mmers(d: Column, k: int, m: int, key: Callable[[Column], Column], canon: bool = True) -> Column:
    """Array: of each k-mer of a read, the m-mer with the smallest key. Any order, such as a frequency
    or a maximum. Keys are computed once for each m-mer of the read."""
    each = F.transform((canonical_kmers if canon else kmers)(d, m), lambda x: F.struct(key(x).alias("key"), x.alias("mmer")))
    width = k - m + 1
    least = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - width + 1), lambda i: F.array_min(F.slice(a, i, F.lit(width))).mmer)
    return F.when(F.length(d) >= k, let(each, least)).otherwise(F.array().cast("array<string>"))


def rank_of(ranks: dict[str, int], m: int) -> Callable[[Column], Column]:
    """Key of an m-mer: its rank, 4**m for one that has none. A constant array of 4**m numbers, looked
    up by the m-mer's own number."""
    table = [4**m] * 4**m
    for mmer, rank in ranks.items():
        table[int(mmer, 4)] = rank
    return lambda x: F.get(F.lit(table), F.conv(x, 4, 10).cast("int"))


def frequency_ranks(reads: DataFrame, m: int, d: str = "d") -> DataFrame:
    """(mmer, rank): canonical m-mers of all reads, rarest first. 4**m rows at most, which bounds
    the window's single partition."""
    counts = packed_rows(reads, m, (), d).groupBy("w0").count().select(unpacked(m).alias("mmer"), "count")
    return counts.withColumn("rank", F.row_number().over(Window.orderBy("count", "mmer")) - 1).select("mmer", F.col("rank").cast("bigint").alias("rank"), F.col("count").alias("n"))


def tallies_by_rank(reads: DataFrame, k: int, m: int, ranks: dict[str, int], d: str = "d") -> DataFrame:
    """(minimizer, kmers): of how many valid k-mers of all reads an m-mer is the one with the smallest rank (m-mers
    without a rank come last, the smaller first). A task tallies its reads in an array of 4**m numbers."""
    table = np.full(4**m, 4**m, np.int64)
    for mmer, rank in ranks.items():
        table[int(mmer, 4)] = rank

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(4**m, np.int64)
        for part, inside in read_blocks(batches, k):
            (w,) = packed_windows(part & 3, m)
            key = table[w] << 2 * m | w
            least = key[: len(part) - k + 1]
            for j in range(1, k - m + 1):
                least = np.minimum(least, key[j : j + len(least)])
            n += np.bincount(least[inside] & (4**m - 1), minlength=4**m)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["w0", "n"])

    found = reads.select(d).mapInArrow(task, "w0 bigint, n bigint")
    return found.groupBy("w0").agg(F.sum("n").alias("kmers")).select(unpacked(m).alias("minimizer"), "kmers")


def kmer_minimizers(d: Column, k: int, m: int, canon: bool = True) -> Column:
    """Array of the minimizers of a read's k-mers, null for invalid ones. m-mers are made once a read;
    each k-mer takes the smallest of its own. An m-mer with an invalid letter is the empty text, which
    comes before all others; one that is not allowed is what a k-mer without any has."""
    one = lambda x: F.when(~is_valid(x), F.lit("")).when(allowed(x), x).otherwise(default_minimizer(m))
    each = F.transform((canonical_kmers if canon else kmers)(d, m), one)
    width = k - m + 1
    least = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - width + 1), lambda i: F.nullif(F.array_min(F.slice(a, i, F.lit(width))), F.lit("")))
    return F.when(F.length(d) >= k, let(each, least)).otherwise(F.array().cast("array<string>"))


def kmers_with_minimizers(reads: DataFrame, k: int, m: int, id_col: str = "read_id", d: str = "d", canon: bool = True) -> DataFrame:
    """(id, pos, kmer, minimizer) of every valid k-mer of every read."""
    c = F.col(d)
    both = F.arrays_zip(kmers(c, k).alias("kmer"), kmer_minimizers(c, k, m, canon).alias("minimizer"))
    rows = reads.select(id_col, F.posexplode(both).alias("pos", "x")).select(id_col, "pos", "x.kmer", "x.minimizer")
    return rows.where(F.col("minimizer").isNotNull())


def superkmers(reads: DataFrame, k: int, m: int, id_col: str = "read_id", d: str = "d", most: int | None = None, canon: bool = True) -> DataFrame:
    """(id, start, n_kmers, minimizer, seq): maximal runs of consecutive valid k-mers of a read that
    share a minimizer, cut after ``most`` k-mers. Runs are found inside of the read's array: they
    begin where the minimizer differs from the one before, and end where it differs from the next.
    Nothing is shuffled."""

    def runs(a: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(a) - 1)
        edge = lambda step: F.filter(places, lambda i: a[i].isNotNull() & ~a[i].eqNullSafe(F.get(a, i + step)))
        return F.zip_with(edge(-1), edge(1), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"), a[lo].alias("m")))

    empty = F.array().cast("array<struct<lo:int,hi:int,m:string>>")
    found = let(kmer_minimizers(F.col(d), k, m, canon), lambda a: F.when(F.size(a) > 0, runs(a)).otherwise(empty))
    rows = reads.select(id_col, F.col(d).alias("_d"), F.inline(found).alias("lo", "hi", "m"))
    if most is not None:
        rows = rows.select(id_col, "_d", F.explode(F.sequence("lo", "hi", F.lit(most))).alias("lo"), "hi", "m").withColumn("hi", F.least("hi", F.col("lo") + most - 1))
    n = F.col("hi") - F.col("lo") + 1
    return rows.select(id_col, F.col("lo").cast("bigint").alias("start"), n.cast("bigint").alias("n_kmers"), F.col("m").alias("minimizer"), F.substr("_d", F.col("lo") + 1, n + k - 1).alias("seq"))
