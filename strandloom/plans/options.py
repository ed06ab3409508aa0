"""Option strings such as ``-kmer-size 31 -abundance-min 3 -solidity-kind sum`` and the graph that
they ask for."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import counting as ct
from strandloom.operators.graph import DeBruijnGraph
from strandloom.operators.histogram import cutoffs


@dataclass(frozen=True)
class Options:
    """Defaults are the documented ones. ``abundance_min``: a number for each bank, -1 for auto."""

    kmer_size: int = 31
    abundance_min: tuple[int, ...] = (3,)
    abundance_max: int = 2147483647
    histo_max: int = 10_000
    solidity_kind: str = "sum"
    solidity_custom: str | None = None
    minimizer_type: int = 0
    minimizer_size: int = 8
    bloom: str = "neighbor"
    debloom: str = "cascading"
    debloom_impl: str = "minimizer"
    branching_type: str = "stored"
    in_: str | None = None
    out: str | None = None


def parse(text: str) -> Options:
    """Options from a string; an unknown option, or one without its value, is an error. A minimizer
    is shorter than the k-mer."""
    words, found = shlex.split(text), {}
    names = {f: f.rstrip("_").replace("_", "-") for f in Options.__dataclass_fields__}
    by = {v: k for k, v in names.items()}
    for i in range(0, len(words), 2):
        key = by.get(words[i].lstrip("-"))
        if key is None or i + 1 == len(words):
            raise ValueError(f"unknown option or no value: {words[i]}")
        value: object = words[i + 1]
        if key == "abundance_min":
            value = tuple(-1 if x == "auto" else int(x) for x in words[i + 1].split(","))
        elif isinstance(getattr(Options, key), int):
            value = int(words[i + 1])
        found[key] = value
    out = Options(**found)
    size = out.minimizer_size or 8
    return replace(out, minimizer_size=min(size, out.kmer_size - 1))


#: What each option means, by field.
MEANINGS = {
    "kmer_size": "letters of a k-mer",
    "abundance_min": "smallest abundance of a solid k-mer, one for each bank or 'auto'",
    "abundance_max": "greatest abundance of a solid k-mer",
    "histo_max": "last bin of the histogram",
    "solidity_kind": "sum, min, max, all, one, custom or a registered kind",
    "solidity_custom": "for custom: a 0 or 1 for each bank",
    "minimizer_type": "0: in order of letters, 1: rarest first",
    "minimizer_size": "letters of a minimizer",
    "bloom": "accepted; membership is exact",
    "debloom": "accepted; membership is exact",
    "debloom_impl": "accepted; membership is exact",
    "branching_type": "accepted; branching nodes are computed when asked for",
    "in_": "banks to read, separated by commas",
    "out": "folder of the stored graph",
}


def usage() -> str:
    """The options, their defaults and meanings, a line each."""
    own = Options()
    names = {f: "-" + f.rstrip("_").replace("_", "-") for f in Options.__dataclass_fields__}
    return "\n".join(f"{names[f]:<20} {MEANINGS[f]} [{getattr(own, f)}]" for f in names)


def build(reads: DataFrame, options: Options, d: str = "d", bank: str = "bank_id") -> DeBruijnGraph:
    """Count, find cutoffs where asked, filter by solidity. Filters and false positives only decide
    how membership is stored elsewhere; joins are exact here, so these options change nothing."""
    banks = [x[0] for x in reads.select(bank).distinct().orderBy(bank).collect()]  # a row a bank
    counts = ct.bank_counts(reads, options.kmer_size, bank, banks, d)
    lows = [lo for lo, _ in ct.full_ranges([(m, 0) for m in options.abundance_min], max(len(banks), 1))]
    if -1 in lows:
        counts = counts.persist()
        for i, lo in enumerate(lows):
            if lo == -1:
                hist = counts.where(F.col(f"c{i}") > 0).groupBy(F.least(F.col(f"c{i}"), F.lit(options.histo_max)).alias("idx")).agg(F.count("*").alias("abundance"))
                lows[i] = cutoffs(hist, (), options.histo_max).first().cutoff
    kept = counts.where(ct.solid(options.solidity_kind, [(lo, options.abundance_max) for lo in lows], len(banks), options.solidity_custom))
    total = sum((F.col(f"c{i}") for i in range(len(banks))), F.lit(0))
    return DeBruijnGraph(kept.select("kmer", total.cast("bigint").alias("abundance")), options.kmer_size)
