"""Sources: FASTA and FASTQ (plain or gzip), albums, in-memory, random, split and exhaustive banks,
unitig FASTA and GFA. Every reader gives reads (read_id, comment, seq, quality, bank_id)."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

READS = "read_id bigint, comment string, seq string, quality string, bank_id int"


def spread(df: DataFrame) -> DataFrame:
    """A table with fewer splits than the cluster has cores, dealt out by rows; one that has as many
    stays as it is read. Only small tables are ever moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def comment_mode(reads: DataFrame, mode: str) -> DataFrame:
    """Comments as they are (FULL), up to the first space (IDONLY), or null (NONE)."""
    if mode == "FULL":
        return reads
    c = F.substring_index("comment", " ", 1) if mode == "IDONLY" else F.lit(None).cast("string")
    return reads.withColumn("comment", c)


def fasta(spark: SparkSession, path: str, bank_id: int = 0) -> DataFrame:
    """FASTA with records over any number of lines. Records are the unit of the text split, so big
    files are read in parallel. ``read_id`` grows along the files, with gaps."""
    raw = spark.read.text(path, lineSep="\n>")
    rec = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    rows = raw.select(rec.alias("r")).where(F.length(F.trim("r")) > 0)
    return rows.select(F.monotonically_increasing_id().alias("read_id"), F.substring_index("r", "\n", 1).alias("comment"), F.regexp_replace(F.substr("r", F.length(F.substring_index("r", "\n", 1)) + 2), r"\s", "").alias("seq"), F.lit(None).cast("string").alias("quality"), F.lit(bank_id).alias("bank_id"))


def _record(text: str) -> tuple[str, str, str] | None:
    """(comment, sequence, quality) of what follows an ``@`` at the start of a line, if it is a whole
    record. The quality goes on until it is as long as the sequence, so it may hold any sign, also at
    the start of a line."""
    lines = text.split("\n")
    plus = next((i for i, x in enumerate(lines) if i and x[:1] == "+"), None)
    if plus is None:
        return None
    seq = "".join(x.strip() for x in lines[1:plus])
    quality = "".join(x.strip() for x in lines[plus + 1 :])
    return (lines[0], seq, quality[: len(seq)]) if len(quality) >= len(seq) else None


_PIECES = "file string, start bigint, comment string, seq string, quality string, rest string"


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of the pieces of splits, and what is left at a split's borders: the end of a record that
    the split before began (no piece of it has a line of ``+`` of its own), and a record that goes on
    in the next split (``comment`` is not null then)."""
    at: tuple[str, int] | None = None
    open_: str | None = None  # what may be a record already, or go on
    lead: str | None = None
    out: list[tuple] = []

    def border(first: str | None, last: str | None) -> None:
        if first is not None:
            out.append((*at, None, None, None, first))
        if last is not None:
            found = _record(last)
            out.append((*at, *found, None) if found else (*at, "", None, None, last))

    for b in batches:
        for file, start, piece in zip(b["file"], b["start"], b["value"], strict=True):
            piece = piece.replace("\r", "")
            if (file, start) != at:
                if at is not None:
                    border(lead, open_)
                at, open_, lead = (file, int(start)), None, None
                if start == 0:
                    piece = piece[piece.find("@") + 1 :] if piece[:1] != "@" and "\n@" in piece else piece.removeprefix("@")
            if open_ is None:
                if start and not any(x[:1] == "+" for x in piece.split("\n")[1:]):
                    lead = piece if lead is None else f"{lead}\n@{piece}"
                else:
                    open_ = piece
                continue
            found = _record(open_)
            if found:
                out.append((*at, *found, None))
                open_ = piece
            else:
                open_ = f"{open_}\n@{piece}"
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")])
                out = []
    if at is not None:
        border(lead, open_)
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")])


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [(i, *(_record(t) or (None, None, None))) for i, t in zip(b["read_id"], b["text"], strict=True)]
        yield pd.DataFrame([x for x in found if x[2] is not None], columns=["read_id", "comment", "seq", "quality"])


def fastq(spark: SparkSession, path: str, bank_id: int = 0) -> DataFrame:
    """FASTQ, large files in parallel: splits are cut at lines that begin with ``@``, and a record that
    is cut by such a line of its quality, or by the border of a split, is put together again. (In a file
    of several splits, a quality of several lines of which one begins with ``@`` and a later one with
    ``+`` is taken for a record where a split begins between them.) ``read_id`` grows along the files,
    with gaps."""
    raw = spark.read.text(path, lineSep="\n@").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    rows = raw.mapInPandas(_records, _PIECES).withColumn("read_id", F.monotonically_increasing_id())
    whole = rows.where("rest IS NULL").select("read_id", "comment", "seq", "quality")
    # Borders: two rows a split at most.
    w = Window.partitionBy("file").orderBy("start", F.col("comment").isNotNull())
    borders = rows.where("rest IS NOT NULL").withColumn("cut", F.sum(F.when(F.col("comment").isNotNull(), 1).otherwise(0)).over(w))
    borders = borders.groupBy("file", "cut").agg(F.min("read_id").alias("read_id"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", F.col("comment").isNotNull().alias("last"), "rest"))), lambda x: x.rest), "\n@").alias("text"))
    both = whole.unionByName(borders.select("read_id", "text").mapInPandas(_joined, "read_id bigint, comment string, seq string, quality string"))
    return both.select("read_id", "comment", "seq", "quality", F.lit(bank_id).alias("bank_id"))


def indexed(reads: DataFrame) -> DataFrame:
    """``read_id`` as the index from 0 in the order that it has now. Counts by partition of the old ids
    come to the driver, a row each."""
    part = F.shiftright("read_id", 33)
    sizes = sorted((x.p, x.n) for x in reads.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for p, n in sizes:
        before[p], total = total, total + n
    if not before:
        return reads
    offset = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in before.items() for x in pair]), part)
    place = F.row_number().over(Window.partitionBy(part).orderBy("read_id")) - 1
    return reads.withColumn("read_id", (offset + place).cast("bigint"))


def sniff(spark: SparkSession, path: str) -> str:
    """'fasta', 'fastq', 'album' or 'parquet', by the first line."""
    if re.search(r"\.parquet/?$", path):
        return "parquet"
    first = next((x.value for x in spark.read.text(path).limit(50).collect() if x.value.strip()), "")
    return {">": "fasta", "@": "fastq"}.get(first[:1], "album")


#: Readers by format, in the order in which they are tried; ``register`` adds to them.
READERS: dict[str, Callable[..., DataFrame]] = {}


def register(kind: str, reader: Callable[..., DataFrame] | None) -> None:
    """Add a reader (spark, path, bank_id) for a format, or take it away."""
    if reader is None:
        READERS.pop(kind, None)
    else:
        READERS[kind] = reader


def album(spark: SparkSession, path: str, bank_id: int = 0) -> DataFrame:
    """A text file of URIs, one a line, relative ones against the album's folder; each is a bank."""
    at = path.rsplit("/", 1)[0]
    names = [x.value.strip() for x in spark.read.text(path).collect() if x.value.strip() and not x.value.startswith("#")]
    return open_banks(spark, [n if re.match(r"[a-z0-9]+:|/", n) else f"{at}/{n}" for n in names])


def open_banks(spark: SparkSession, uris: str | list[str]) -> DataFrame:
    """One bank, a list of banks, or a comma-separated list: their union, with ``bank_id`` in order."""
    names = [u.strip() for u in uris.split(",")] if isinstance(uris, str) else uris
    parts = [READERS[sniff(spark, n)](spark, n, i) for i, n in enumerate(names)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def parquet_bank(spark: SparkSession, path: str, bank_id: int = 0) -> DataFrame:
    return spark.read.parquet(path).withColumn("bank_id", F.lit(bank_id))


READERS |= {"fasta": fasta, "fastq": fastq, "album": album, "parquet": parquet_bank}


def strings(spark: SparkSession, seqs: list[str], bank_id: int = 0) -> DataFrame:
    """A bank from strings in memory."""
    return spark.createDataFrame([(i, f"seq_{i}", s, None, bank_id) for i, s in enumerate(seqs)], READS)


def random_bank(spark: SparkSession, n: int, length: int, seed: int = 1) -> DataFrame:
    """``n`` reads of uniform letters. Letter j of read i is drawn from a hash of both, so a task that
    is repeated draws the same."""
    letter = lambda j: F.substr(F.lit("ACGT"), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), j), F.lit(4)).cast("int") + 1, F.lit(1))
    seq = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "")
    return spark.range(n).select(F.col("id").alias("read_id"), F.concat(F.lit("seq_"), "id").alias("comment"), seq.alias("seq"), F.lit(None).cast("string").alias("quality"), F.lit(0).alias("bank_id"))


class RandomBank(DataSource):
    """The same as a format: ``spark.dataSource.register(RandomBank)``, then
    ``spark.read.format("random_bank").option("reads", n).option("length", l).load()``. What a format
    of one's own looks like."""

    @classmethod
    def name(cls) -> str:
        return "random_bank"

    def schema(self) -> str:
        return "read_id bigint, comment string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _RandomReader(self.options)


class _RandomReader(DataSourceReader):
    def __init__(self, options: dict):
        self.reads, self.length, self.seed = (int(options.get(c, d)) for c, d in (("reads", 1000), ("length", 100), ("seed", 1)))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(0, self.reads, 100_000)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rng = random.Random(f"{self.seed} {partition.value}")
        for i in range(partition.value, min(partition.value + 100_000, self.reads)):
            yield i, f"seq_{i}", "".join(rng.choices("ACGT", k=self.length))


def split_reference(reference: DataFrame, read_size: int, overlap: int, coverage: int, d: str = "d") -> DataFrame:
    """(pass, start, read): windows of a reference, ``read_size`` long, each ``read_size - overlap``
    after the last, ``coverage`` times over; the last window may be shorter."""
    step = read_size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(d) - overlap - 1, F.lit(0)), F.lit(step))
    rows = reference.select(F.explode(F.sequence(F.lit(0), F.lit(coverage - 1))).alias("pass"), d).select("pass", F.explode(starts).alias("start"), d)
    return rows.select("pass", "start", F.substr(d, F.col("start") + 1, F.lit(read_size)).alias("read"))


def all_kmers(spark: SparkSession, k: int) -> DataFrame:
    """Every k-mer, as digits."""
    return spark.range(4**k).select(F.lpad(F.conv(F.col("id").cast("string"), 10, 4), k, "0").alias("kmer"))


def split_at_unknown(reads: DataFrame, least: int, seq: str = "seq") -> DataFrame:
    """(read_id, piece, seq): reads cut at runs of N; pieces shorter than ``least`` are dropped."""
    parts = F.filter(F.split(seq, "[Nn]+"), lambda x: F.length(x) >= least)
    return reads.select("read_id", F.posexplode(parts).alias("piece", "seq"))


def good_letters(seq: Column) -> Column:
    """Part of a read's letters that are A, C, G or T."""
    return F.length(F.regexp_replace(seq, "[^ACGT]", "")) / F.length(seq)


def estimate(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """(number, total_size, max_size), exactly."""
    return reads.agg(F.count("*").alias("number"), F.coalesce(F.sum(F.length(seq)), F.lit(0)).alias("total_size"), F.max(F.length(seq)).cast("bigint").alias("max_size"))


def unitigs_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq, ln, kc, km, links) from unitig FASTA headers."""
    r = fasta(spark, path)
    field = lambda p: F.regexp_extract("comment", p, 1)
    links = F.regexp_extract_all("comment", F.lit(r"(L:[+-]:\d+:[+-])"), 1)
    return r.select(field(r"^(\d+)").cast("bigint").alias("id"), "seq", field(r"LN:i:(\d+)").cast("bigint").alias("ln"), field(r"KC:i:(\d+)").cast("bigint").alias("kc"), field(r"km:f:([0-9.]+)").cast("double").alias("km"), links.alias("links"))


def unitigs_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments (id, seq), links (from_id, from_sign, to_id, to_sign, overlap)) of a GFA 1 file."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    seg = rows.where(F.col("f")[0] == "S").select(F.col("f")[1].alias("id"), F.col("f")[2].alias("seq"))
    link = rows.where(F.col("f")[0] == "L").select(*[F.col("f")[i].alias(n) for i, n in enumerate(("from_id", "from_sign", "to_id", "to_sign", "overlap"), 1)])
    return seg, link
