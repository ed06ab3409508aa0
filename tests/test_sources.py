import random

from pyspark.sql import functions as F

from strandloom.functions import encoding as enc
from strandloom.operators import counting as ct
from strandloom.operators.graph import DeBruijnGraph
from strandloom.plans import options as opt
from strandloom.plans import tools
from strandloom.sources import readers as rd
from strandloom.streaming import counter


def test_fastq_of_many_splits(spark, tmp_path):
    rng = random.Random(1)
    want, text = [], ""
    for i in range(400):
        n = rng.randint(0, 60)
        seq = "".join(rng.choices("ACGTN", k=n))
        quality = "".join(rng.choices("@+I!", weights=[3, 1, 3, 1], k=n))
        want.append((f"r{i} x", seq, quality))
        text += f"@r{i} x\n{seq}\n+\n{quality}\n"
    (tmp_path / "a.fq").write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (300, 1000, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = rd.fastq(spark, str(tmp_path / "a.fq"))
            rows = [(x.comment, x.seq, x.quality) for x in got.collect()]
            assert sorted(rows) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    ids = sorted(x.read_id for x in rd.indexed(got).collect())
    assert ids == list(range(400))


def test_format_of_its_own(spark):
    spark.dataSource.register(rd.RandomBank)
    rows = spark.read.format("random_bank").option("reads", 50).option("length", 20).load()
    assert rows.count() == 50 and {len(x.seq) for x in rows.collect()} == {20}


def test_stored_graph_knows_its_k(spark, tmp_path):
    r = rd.strings(spark, ["CGATTCAAATGACGG", "CGATTCAAATGA"]).withColumn("d", enc.digits(F.col("seq")))
    g = DeBruijnGraph.from_reads(r, 7)
    g.save(str(tmp_path / "g"), cutoff=1)
    back = DeBruijnGraph.load(spark, str(tmp_path / "g"))
    assert back.k == 7 and back.nodes.count() == g.nodes.count()
    info = {x.key: x.value for x in DeBruijnGraph.info(spark, str(tmp_path / "g")).collect()}
    assert info["kmers_nb_solid"] == str(g.nodes.count()) and info["cutoff"] == "1" and info["abundance_most"] == "2"


def test_processors_and_kinds_of_ones_own(spark):
    r = rd.strings(spark, ["CGATTCAAATGACGG", "CGATTCAAATGA", "TTTTTTTTT"]).withColumn("d", enc.digits(F.col("seq"))).withColumn("bank", F.col("read_id"))
    counts = ct.bank_counts(r, 7, "bank", [0, 1, 2])
    ct.register_solidity("in_two", lambda cols, ranges: sum((c.between(*x).cast("int") for c, x in zip(cols, ranges, strict=True)), F.lit(0)) >= 2)
    both, n = ct.process_counts(counts, lambda c: c.where(ct.solid("in_two", [(1, 9)], 3)), lambda c: c.agg(F.count("*").alias("n")))
    assert both.count() == 6 and n.first().n == counts.count()


def test_counts_of_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = lambda: counter.keep_counts(spark.readStream.schema("d string").option("maxFilesPerTrigger", 1).json(str(folder)), 3, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (folder / "a.json").write_text('{"d": "01230"}\n')
    run()
    (folder / "b.json").write_text('{"d": "0123"}\n{"d": "4440123"}\n')
    run()
    want = ct.count_kmers(spark.createDataFrame([("01230",), ("0123",), ("4440123",)], "d string"), 3)
    assert sorted(map(tuple, counter.kept_counts(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_tools(spark, tmp_path):
    rows = tools.generate_bank(spark, str(tmp_path / "a.fa"), 300, 50, 20, 2)
    back = rd.fasta(spark, str(tmp_path / "a.fa"))
    assert sorted(x.seq for x in back.collect()) == sorted(x.read for x in rows.collect())
    g = tools.build_graph(spark, f"-in {tmp_path}/a.fa -kmer-size 15 -abundance-min 2 -out {tmp_path}/g")
    info = {x.key: x.value for x in DeBruijnGraph.info(spark, str(tmp_path / "g")).collect()}
    assert g.k == 15 and g.nodes.count() == int(info["kmers_nb_solid"]) == 286 and info["seq_number"] == "20"
    assert tools.check_graph(spark, str(tmp_path / "g")).first().nb_solids == 286
    assert all(f"-{x}" in opt.usage() for x in ("kmer-size", "in", "out"))
