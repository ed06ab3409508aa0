"""k-mer counting over one or many banks, solidity, and statistics of banks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.encoding import canonical_kmers, kmers, valid_windows
from strandloom.functions.minimizers import superkmers
from strandloom.functions.packed import MOST, WORD, added_up, columns, packed_rows, packed_tallies, unpacked
from strandloom.operators.iterate import cut


#: Letters of k-mers of which a task can hold all that there are (4**12).
FEW = 12
#: Tasks that minimizers are dealt to.
BUCKETS = 256


def kmer_rows(reads: DataFrame, k: int, keep: tuple[str, ...] = (), d: str = "d", canon: bool = True) -> DataFrame:
    """One row for each valid k-mer. Reads are cut at invalid letters before k-mers are made, so no
    k-mer is looked at again; the work is linear in the read."""
    runs = reads.select(*keep, F.explode(F.split(d, "[^0-3]+")).alias("_run")).where(F.length("_run") >= k)
    return runs.select(*keep, F.explode((canonical_kmers if canon else kmers)(F.col("_run"), k)).alias("kmer"))


def count_kmers(reads: DataFrame, k: int, d: str = "d", canon: bool = True) -> DataFrame:
    """(kmer, abundance): partial counts before the only shuffle. Up to k = 93, what is shuffled are packed k-mers
    (8, 16 or 24 bytes); the digits are made from the counts, where somebody reads them."""
    if k <= MOST:
        return packed_counts(reads, k, d, canon).select(unpacked(k).alias("kmer"), "abundance")
    return kmer_rows(reads, k, (), d, canon).groupBy("kmer").agg(F.count("*").alias("abundance"))


def packed_counts(reads: DataFrame, k: int, d: str = "d", canon: bool = True) -> DataFrame:
    """(w0[, w1, w2], abundance) of packed k-mers. There are few short ones, which partial sums keep small. Of long ones
    almost all are distinct, so a table of partial sums would only fill the memory: k-mers of one word are sorted, and
    neighbours added up."""
    if FEW < k <= WORD:
        return packed_tallies(reads, k, d, canon).repartition("w0").sortWithinPartitions("w0").mapInArrow(added_up, "w0 bigint, abundance bigint")
    return packed_rows(reads, k, (), d, canon).groupBy(*columns(k)).agg(F.count("*").alias("abundance"))


def count_kmers_by_minimizer(reads: DataFrame, k: int, m: int, id_col: str = "read_id", d: str = "d", most: int = 255) -> DataFrame:
    """As ``count_kmers``, but super-k-mers are shuffled instead of k-mers: a run of n k-mers moves
    n + k - 1 letters, not n * k, and k-mers are counted where their minimizer is. Runs are small and become many
    k-mers, so they are dealt to a fixed number of tasks that are not put together by the size of what they read."""
    runs = superkmers(reads, k, m, id_col, d, most).repartition(min(4**m, BUCKETS), "minimizer")
    rows = runs.select("minimizer", F.explode(canonical_kmers(F.col("seq"), k)).alias("kmer"))
    return rows.groupBy("minimizer", "kmer").agg(F.count("*").alias("abundance")).select("kmer", "abundance")


def bank_counts(reads: DataFrame, k: int, bank: str, banks: list, d: str = "d") -> DataFrame:
    """(kmer, c0, c1, ...): abundance in each of the banks, in the order given."""
    counts = [F.count_if(F.col(bank) == b).alias(f"c{i}") for i, b in enumerate(banks)]
    if k > MOST:
        return kmer_rows(reads, k, (bank,), d).groupBy("kmer").agg(*counts)
    found = packed_rows(reads, k, (bank,), d).groupBy(*columns(k)).agg(*counts)
    return found.select(unpacked(k).alias("kmer"), *[f"c{i}" for i in range(len(banks))])


def full_ranges(ranges: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The last range holds for the banks that have none of their own; more ranges than banks are
    an error."""
    if len(ranges) > n:
        raise ValueError(f"{len(ranges)} thresholds for {n} banks")
    return [*ranges, *[ranges[-1]] * (n - len(ranges))]


def solid(kind: str, ranges: list[tuple[int, int]], n: int, bits: str | None = None, select: list[int] | None = None) -> Column:
    """Predicate over columns c0..c(n-1). Kinds: sum, min, max, all, one, custom (``bits``: which
    banks must be in their range, the others must not). One bank is always ``sum``. ``select``: the
    banks that a sum takes."""
    ranges = full_ranges(ranges, n)
    cols = [F.col(f"c{i}") for i in range(n)]
    inside = [c.between(lo, hi) for c, (lo, hi) in zip(cols, ranges, strict=True)]
    if n == 1 or kind == "sum":
        return reduce(lambda a, b: a + b, [cols[i] for i in (select or range(n))]).between(*ranges[0])
    if kind == "min":
        return F.least(*cols).between(*ranges[0])
    if kind == "max":
        return F.greatest(*cols).between(*ranges[0])
    if kind == "all":
        return reduce(lambda a, b: a & b, inside)
    if kind == "one":
        return reduce(lambda a, b: a | b, inside)
    if kind == "custom":
        if bits is None or len(bits) != n:
            raise ValueError("custom solidity takes a bit for each bank")
        return reduce(lambda a, b: a & b, [x == F.lit(b == "1") for x, b in zip(inside, bits, strict=True)])
    if kind in KINDS:
        return KINDS[kind](cols, ranges)
    raise ValueError(f"unknown solidity kind {kind}")


#: Solidity kinds by name: (columns, ranges) -> predicate. ``register_solidity`` adds to them.
KINDS: dict[str, Callable[[list[Column], list[tuple[int, int]]], Column]] = {}


def register_solidity(name: str, predicate: Callable[[list[Column], list[tuple[int, int]]], Column]) -> None:
    """A kind of one's own: a predicate over the counts of the banks and their ranges."""
    KINDS[name] = predicate


def process_counts(counts: DataFrame, *processors: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """What each of several processors makes of the same counts (kmer, c0..): any DataFrame function,
    such as a filter, a histogram or a sink. Counts are cut to a table once, so they are counted once."""
    held = cut(counts)
    return [p(held) for p in processors]


def solidity_counters(counts: DataFrame, predicate: Column) -> DataFrame:
    """Distinct, solid and weak k-mers, and the part of weak ones in hundredths of a percent."""
    out = counts.agg(F.count("*").alias("nb_distinct"), F.count_if(predicate).alias("nb_solid"))
    weak = F.col("nb_distinct") - F.col("nb_solid")
    return out.withColumn("nb_weak", weak).withColumn("weak_bp", F.floor(weak * 10000 / F.col("nb_distinct")).cast("bigint"))


def bank_statistics(reads: DataFrame, k: int, d: str = "d", by: tuple[str, ...] = ()) -> DataFrame:
    """Number of reads, lengths (smallest, greatest, mean, population deviation), letters, valid and
    invalid k-mers."""
    n = F.length(d)
    rows = reads.select(*by, n.alias("n"), F.greatest(n - k + 1, F.lit(0)).alias("windows"), valid_windows(F.col(d), k).alias("valid"))
    out = [F.count("*").alias("seq_number"), F.min("n").alias("seq_size_min"), F.max("n").alias("seq_size_max"), F.avg("n").alias("seq_size_mean"), F.stddev_pop("n").alias("seq_size_deviation"), F.sum("n").alias("total_nt"), F.sum("valid").alias("kmers_nb_valid"), F.sum(F.col("windows") - F.col("valid")).alias("kmers_nb_invalid")]
    return rows.groupBy(*by).agg(*out) if by else rows.agg(*out)


def checksum(kmers_df: DataFrame, col: str = "kmer") -> DataFrame:
    """Sum of the k-mers' numbers modulo 2**64, as text. Of a number only its last 32 digits count."""
    v = F.conv(F.when(F.length(col) > 32, F.substr(col, F.lit(-32))).otherwise(F.col(col)), 4, 10).cast("decimal(38,0)")
    return kmers_df.agg(F.pmod(F.sum(v), F.lit("18446744073709551616").cast("decimal(38,0)")).cast("string").alias("checksum"))


def checksum_words(kmers_df: DataFrame, k: int, col: str | None = "kmer") -> DataFrame:
    """Sum of the k-mers' numbers modulo 2**(64 n), n being the words of 64 bits that hold one, as hexadecimal text.
    Limbs of 32 bits (16 digits) are summed each by itself, in halves; carries go up once, in the one row of sums.
    No ``col``: k-mers are packed (``packed_counts``), and limbs are cut from their words."""
    limbs = 2 * -(-2 * k // 64)
    if col is None:
        names, bits = columns(k), 2 * WORD
        part = lambda i: reduce(lambda a, b: a.bitwiseOR(b), [_moved(F.col(c), bits * (len(names) - 1 - j) - 32 * i) for j, c in enumerate(names) if -bits < bits * (len(names) - 1 - j) - 32 * i < 32] or [F.lit(0).cast("bigint")]).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    else:
        whole = F.lpad(F.col(col), 16 * limbs, "0")
        part = lambda i: F.conv(F.substr(whole, F.lit(16 * (limbs - 1 - i) + 1), F.lit(16)), 4, 10).cast("bigint")
    sums = kmers_df.select(*[part(i).alias(f"p{i}") for i in range(limbs)])
    half = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,0)")
    out = sums.agg(*[(half(F.shiftright(f"p{i}", 16)) * F.lit(65536).cast("decimal(6,0)") + half(F.col(f"p{i}").bitwiseAND(F.lit(65535).cast("bigint")))).cast("decimal(38,0)").alias(f"s{i}") for i in range(limbs)])
    out = out.withColumn("carry", F.lit(0).cast("bigint"))
    for i in range(limbs):
        s = F.col(f"s{i}") + F.col("carry")
        out = out.withColumn(f"s{i}", s.cast("decimal(38,0)")).withColumn("carry", F.expr(f"s{i} div 4294967296")).withColumn(f"s{i}", F.expr(f"cast(s{i} % 4294967296 as bigint)"))
    return out.select(F.concat(*[F.lower(F.lpad(F.hex(f"s{i}"), 8, "0")) for i in reversed(range(limbs))]).alias("checksum"))


def _moved(w: Column, bits: int) -> Column:
    """A word that begins ``bits`` above (below, if negative) the bits that are looked at."""
    return F.shiftleft(w, bits) if bits > 0 else F.shiftrightunsigned(w, -bits) if bits else w


def shared_kmers(counts: DataFrame, n: int, lo: int, hi: int) -> DataFrame:
    """(i, j, shared), i <= j: k-mers that are in range in both banks, from one pass."""
    inside = [F.col(f"c{i}").between(lo, hi) for i in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = counts.agg(*[F.count_if(inside[i] & inside[j]).alias(f"p{i}_{j}") for i, j in pairs])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias("shared")) for i, j in pairs])).alias("x")).select("x.*")


def linear_count(kmers_df: DataFrame, buckets: int, bucket: Column) -> DataFrame:
    """Approximate distinct k-mers from the buckets that stay empty: -m ln((m - w) / m)."""
    w = F.count_distinct(bucket)
    return kmers_df.agg(w.alias("weight")).withColumn("estimate", F.round(-F.lit(float(buckets)) * F.log((F.lit(float(buckets)) - F.col("weight")) / buckets), 3))
