"""FASTA and FASTQ as formats: every split size against one pass over the file, commits, filters, errors."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from strandloom.sources import formats

ORDER = "read_id"


@pytest.fixture(scope="module")
def session(spark):
    formats.register(spark)
    return spark


def records(n, rng):
    """Qualities that look like heads and separators, empty reads, equal rows, one long read."""
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 2, 7, 30, 200 if i == 5 else 3])
        out.append((f"r{i} x" if i % 3 else "", "".join(rng.choices("ACGTN", k=size)), "".join(rng.choices("@+>I", k=size))))
    return [*out, out[1], out[1]]


@pytest.mark.parametrize("kind", ["fastq", "fasta"])
def test_splits(session, tmp_path, kind):
    rows = records(40, random.Random(3))
    lines = [f"@{c}\n{s}\n+{c}\n{q}\n" if kind == "fastq" else f">{c}\n{s[:9]}\r\n{s[9:]}\n" for c, s, q in rows]
    (tmp_path / "a.txt").write_bytes("".join(lines[:30]).encode())
    (tmp_path / "b.txt").write_bytes("".join(lines[30:]).encode()[:-1])
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"junk")
    want = [(c, s, q if kind == "fastq" else None) for c, s, q in rows]
    for split in (5, 64, 10**6):
        df = session.read.format(kind).option("splitBytes", split).load(str(tmp_path))
        assert [(x.comment, x.seq, x.quality) for x in df.orderBy(ORDER).collect()] == want, split
    some = df.where(F.col("file").endswith("a.txt"))
    assert some.count() == 30
    path = str(tmp_path / "a.txt")
    one = session.read.format(kind).option("splitBytes", 64).load(str(tmp_path)).where(F.col("file") == path)
    assert one.count() == 30 and one.rdd.getNumPartitions() == -(-os.path.getsize(path) // 64)
    ids = [x.read_id for x in df.orderBy(ORDER).collect()]
    late = session.read.format(kind).option("splitBytes", 64).load(str(tmp_path)).where(F.col("read_id") >= ids[30])
    assert late.count() == len(ids) - 30 and late.rdd.getNumPartitions() < one.rdd.getNumPartitions()
    (tmp_path / "c.gz").write_bytes(gzip.compress("".join(lines).encode()))
    packed = session.read.format(kind).option("bankId", 4).load(str(tmp_path / "c.gz"))
    assert [(x.comment, x.seq, x.quality) for x in packed.orderBy(ORDER).collect()] == want
    assert packed.select("bank_id").distinct().collect()[0].bank_id == 4


@pytest.mark.parametrize("kind,compression", [("fastq", "none"), ("fastq", "gzip"), ("fasta", "none")])
def test_written_and_read(session, tmp_path, kind, compression):
    rows = records(50, random.Random(4))
    df = session.createDataFrame([(i, *r, "other") for i, r in enumerate(rows)], "n int, comment string, seq string, quality string, file string").repartition(3)
    at = str(tmp_path / "out")
    write = lambda d, mode: d.write.format(kind).option("compression", compression).option("lineWidth", 11).mode(mode).save(at)
    write(df, "append")
    read = lambda: sorted((x.comment, x.seq, x.quality) for x in session.read.format(kind).option("splitBytes", 100).load(at).collect())
    want = sorted((c, s, q if kind == "fastq" else None) for c, s, q in rows)
    key = lambda x: (x[0], x[1], x[2] or "")
    assert read() == sorted(want, key=key)
    write(df.limit(2), "append")
    assert len(read()) == len(rows) + 2
    write(df.where("n < 5"), "overwrite")
    assert len(read()) == 5 and not [f for f in os.listdir(at) if f.startswith("_tmp")] and "_SUCCESS" in os.listdir(at)
    write(df.limit(0), "overwrite")
    assert read() == []


def test_errors(session, tmp_path):
    bad = session.createDataFrame([("a\nb", "ACG", "II"), (None, None, None)], "comment string, seq string, quality string")
    at = str(tmp_path / "out")
    with pytest.raises(Exception, match="not as long"):
        bad.write.format("fastq").mode("append").save(at)
    assert not os.path.exists(at) or not [f for f in os.listdir(at) if not f.startswith("_tmp")]
    bad.drop("quality").write.format("fastq").option("quality", "I").mode("append").save(at)
    assert sorted((x.comment, x.seq, x.quality) for x in session.read.format("fastq").load(at).collect()) == [("", "", ""), ("a b", "ACG", "III")]
    (tmp_path / "cut.fastq").write_text("@a\nACG\n+\nIII\n@b\nAC\n+\nI")
    with pytest.raises(Exception, match="at byte 13"):
        session.read.format("fastq").load(str(tmp_path / "cut.fastq")).collect()
    with pytest.raises(Exception, match="FileNotFound|missing"):
        session.read.format("fastq").load(str(tmp_path / "missing")).collect()
