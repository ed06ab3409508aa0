import pytest
from pyspark.sql import functions as F

from strandloom.functions import encoding as enc
from strandloom.functions import minimizers as mz
from strandloom.operators import counting as ct
from strandloom.operators import histogram as hg
from strandloom.operators.graph import DeBruijnGraph
from strandloom.operators.simplify import simplify
from strandloom.plans import options as opt
from strandloom.sources import readers as rd
from strandloom.sources import writers as wr
from tests import golden_sequences as gs


def reads(spark, *seqs):
    return rd.strings(spark, list(seqs)).withColumn("d", enc.digits(F.col("seq")))


def values(spark, seq, k, canon):
    arr = enc.canonical_kmers(F.col("d"), k) if canon else enc.kmers(F.col("d"), k)
    return [int(x, 4) for x in reads(spark, seq).select(arr.alias("a")).first().a]


def test_encoding(spark):
    assert values(spark, "CATTGATAGTGG", 3, False) == [18, 10, 43, 44, 50, 8, 35, 14, 59, 47]
    assert values(spark, "CATTGATAGTGG", 3, True) == [11, 2, 16, 36, 9, 8, 24, 6, 17, 20]
    assert values(spark, "ACTACGATCGATGTA", 5, True) == [0x61, 0x187, 0x21C, 0x72, 0x1C9, 0x1C9, 0x9C, 0x9C, 0x127, 0x49, 0xB8]
    assert values(spark, "AC", 3, True) == []


@pytest.mark.parametrize("copies", [1, 2, 3])
def test_counts_of_copies(spark, copies):
    r = reads(spark, *["GATCCTCCCCAGGCCCCTACACCCAAT"] * copies)
    for k, n in ((27, 1), (26, 2)):
        for least in range(1, 5):
            assert ct.count_kmers(r, k).where(F.col("abundance") >= least).count() == (n if least <= copies else 0)


def test_exhaustive_bank(spark):
    both = rd.all_kmers(spark, 7).withColumnRenamed("kmer", "d")
    got = ct.count_kmers(both.unionAll(both), 7)
    assert got.count() == 4**7 // 2 and got.where("abundance <> 4").count() == 0


def test_solidity_of_three_banks(spark):
    r = reads(spark, "CGCTATCGCTA", "CGCTATAGTTA", "CGCTAACGCTA").withColumn("bank", F.col("read_id"))
    counts = ct.bank_counts(r, 5, "bank", [0, 1, 2]).persist()
    n = lambda kind, ranges, bits=None: counts.where(ct.solid(kind, ranges, 3, bits)).count()
    rows = [tuple(x[1:]) for x in counts.collect()]
    assert n("sum", [(1, 9)]) == len(rows)
    assert n("min", [(1, 9)]) == sum(min(x) >= 1 for x in rows)
    assert n("max", [(2, 9)]) == sum(max(x) >= 2 for x in rows)
    assert n("all", [(1, 1), (1, 9)]) == sum(x[0] == 1 and x[1] >= 1 and x[2] >= 1 for x in rows)
    assert n("one", [(2, 9)]) == sum(any(c >= 2 for c in x) for x in rows)
    assert n("custom", [(1, 9)], "100") == sum(x[0] >= 1 and not x[1] and not x[2] for x in rows)
    with pytest.raises(ValueError):
        ct.full_ranges([(1, 2)] * 4, 3)


def test_superkmers_cover_valid_kmers(spark):
    r = reads(spark, "ACGTACGGTNACGTTTGACCAGTACCA" * 3, "AC", "NNNN")
    runs = mz.superkmers(r, 7, 3, most=4)
    assert runs.agg(F.max("n_kmers")).first()[0] <= 4
    again = runs.select(F.explode(enc.canonical_kmers(F.col("seq"), 7)).alias("kmer")).groupBy("kmer").count()
    assert {tuple(x) for x in again.collect()} == {tuple(x) for x in ct.count_kmers(r, 7).collect()}
    by_minimizer = ct.count_kmers_by_minimizer(r, 7, 3)
    assert {tuple(x) for x in by_minimizer.collect()} == {tuple(x) for x in again.collect()}


def test_cutoff(spark):
    found = lambda bins: hg.cutoffs(spark.createDataFrame(list(bins.items()), "idx long, abundance long")).first()
    assert found({1: 1000, 2: 300, 3: 80, 4: 20, 5: 30, 6: 90, 7: 200, 8: 210, 9: 90, 10: 20}).cutoff in (3, 4, 5)
    assert tuple(found({1: 10, 2: 5})) == (3, None, None, None)
    thr = hg.discrete_thresholds()
    assert len(thr) == 257 and thr[70] == 70 and thr[85] == 100 and thr[255] == thr[256] or thr[256] == 50000


X = ["AAAAA", "CCCCAAG", "AAACAAG", "CAAGA", "AAGAAGC", "AAGACCC"]


def test_x_shape(spark):
    g = DeBruijnGraph.from_reads(reads(spark, *X), 5)
    g = DeBruijnGraph(g.nodes.persist(), 5)
    assert g.nodes.count() == 14
    u = g.unitigs()
    assert sorted(x.n_kmers for x in u.collect()) == [1, 1, 3, 3, 3, 3]
    left = {x.kmer for x in simplify(g).nodes.select(enc.letters(F.col("kmer")).alias("kmer")).collect()}
    assert len(left) == 2 and "AAAAA" in left


def test_snp_fork(spark):
    a = "CGATTCAAATGACGGCAGCAGGCCGGGAGTCCCTGAGAGGC"
    b = a[:20] + "A" + a[21:]
    g = DeBruijnGraph.from_reads(reads(spark, a, b), 7)
    assert g.branching().where("indegree + outdegree = 3").count() == 2
    assert g.snp_bubbles().count() == 1


def test_circle(spark):
    s = "ACGGTCATTC"
    g = DeBruijnGraph.from_reads(reads(spark, s + s[:6]), 7)
    u = g.unitigs().collect()
    assert len(u) == 1 and u[0].circular and u[0].n_kmers == 10


def test_unitig_and_gfa_files(spark, tmp_path):
    g = DeBruijnGraph.from_reads(reads(spark, *X), 5)
    u = g.unitigs().select(F.xxhash64("seq").alias("id"), "seq", "n_kmers", "kc").persist()
    u = u.withColumn("id", F.pmod("id", F.lit(10**9)))
    seqs = u.select("seq")
    links = g.unitig_links(seqs)
    ids = u.select("id", "seq")
    links = links.join(ids.withColumnsRenamed({"id": "from_id", "seq": "from_seq"}), "from_seq").join(ids.withColumnsRenamed({"id": "to_id", "seq": "to_seq"}), "to_seq")
    wr.unitig_lines(u, links).write.text(str(tmp_path / "u.fa"))
    back = rd.unitigs_fasta(spark, str(tmp_path / "u.fa")).collect()
    assert {(x.id, x.ln, x.kc) for x in back} == {(x.id, len(x.seq), x.kc) for x in u.collect()}
    assert sum(len(x.links) for x in back) == links.count()
    wr.gfa_lines(u, links, 5).write.text(str(tmp_path / "u.gfa"))
    seg, link = rd.unitigs_gfa(spark, str(tmp_path / "u.gfa"))
    assert seg.count() == u.count() and link.count() == links.count()


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one two\nACGT\nAC\n>three\nGG\n\n>empty\n")
    (tmp_path / "b.fq").write_text("@q1 x\nACGT\nAC\n+\n@III\n@I\n@q2\nGG\n+\nII\n")
    (tmp_path / "album.txt").write_text("a.fa\nb.fq\n")
    assert [rd.sniff(spark, str(tmp_path / n)) for n in ("a.fa", "b.fq", "album.txt")] == ["fasta", "fastq", "album"]
    got = rd.open_banks(spark, f"{tmp_path}/a.fa,{tmp_path}/b.fq")
    want = {("one two", "ACGTAC", None, 0), ("three", "GG", None, 0), ("empty", "", None, 0), ("q1 x", "ACGTAC", "@III@I", 1), ("q2", "GG", "II", 1)}
    assert {(x.comment, x.seq, x.quality, x.bank_id) for x in got.collect()} == want
    assert rd.album(spark, str(tmp_path / "album.txt")).count() == 5
    tree = [(0, "graph", ""), (1, "kmer_size", "31"), (1, "nb", "5")]
    assert wr.read_properties_xml(wr.properties_xml(tree)) == tree
    assert "kmer_size" in wr.properties_text(tree)


def test_options(spark):
    o = opt.parse("-kmer-size 5 -abundance-min 1,2 -solidity-kind all -minimizer-size 8")
    assert (o.kmer_size, o.abundance_min, o.solidity_kind, o.minimizer_size) == (5, (1, 2), "all", 4)
    with pytest.raises(ValueError):
        opt.parse("-nothing 3")
    g = opt.build(reads(spark, *X), opt.parse("-kmer-size 5 -abundance-min 1"))
    assert g.nodes.count() == 14


def test_every_checked_query_is_registered():
    from strandloom import queries

    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_loops_that_do_not_settle(spark, monkeypatch):
    from strandloom.operators import iterate, simplify

    monkeypatch.setattr(simplify, "remove", lambda graph, seqs: (graph, 1))
    for name in ("doomed_tips", "doomed_bulges", "doomed_connections"):
        monkeypatch.setattr(simplify, name, lambda graph, limits: None)
    with pytest.raises(RuntimeError):
        simplify.simplify(None)
    path = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    with pytest.raises(RuntimeError):
        iterate.components(path, most=1)
    assert {r.component for r in iterate.components(path).collect()} == {0}


# ---------------------------------------------------------------- counting, minimizers, validity


def test_checksum_of_31mers(spark):
    r = reads(spark, "GATCGATTCTTAGCACGTCCCCCCCTACACCCAAT")
    counts = ct.count_kmers(r, 31)
    assert {int(x.kmer, 4) for x in counts.collect()} == {0x1CA68D1E55561150, 0x09CA68D1E5556115, 0x2729A34795558454, 0x32729A3479555845, 0x0AFEE3FFF1ED8309}
    assert int(ct.checksum(counts).first().checksum) == 0x8B0C176C3B43D207


DIRECT = [("AAGTGAC", p) for p in range(7, -1, -1)] + [("AACATTG", p) for p in (8, 7, 6)]
CANONICAL = [("AAGTGAC", p) for p in range(7, 0, -1)] + [("AATGTTA", 8)] + [("AACATTG", p) for p in range(8, -1, -1)] + [("AACACAC", 8)]


@pytest.mark.parametrize("seq, canon, want", [("ATGTCTGAAGTGACCTAACATTGCA", False, DIRECT), ("ATGTCTGAAGTGACCTAACATTGCAGTGTGTT", True, CANONICAL)])
def test_minimizers(spark, seq, canon, want):
    rows = reads(spark, seq).select(F.posexplode(enc.kmers(F.col("d"), 15)).alias("pos", "kmer"))
    got = rows.orderBy("pos").select(enc.letters(mz.minimizer(F.col("kmer"), 7, canon)).alias("m"), mz.minimizer_position(F.col("kmer"), 7, canon).alias("p")).collect()
    assert [(x.m, x.p) for x in got] == want
    per_read = reads(spark, seq).select(F.transform(mz.kmer_minimizers(F.col("d"), 15, 7, canon), enc.letters).alias("a")).first().a
    assert per_read == [m for m, _ in want]


def test_validity_of_windows(spark):
    seq = "ACGNCNTGCTAGCTATTTAGCTTTAGANAGTAGATGACGCNC"
    got = reads(spark, seq).select(F.transform(enc.kmers(F.col("d"), 11), enc.is_valid).alias("a")).first().a
    assert len(got) == 32 and [i for i, x in enumerate(got) if x] == [*range(6, 17), 28, 29]
    s = ct.bank_statistics(reads(spark, seq), 11).first()
    assert (s.kmers_nb_valid, s.kmers_nb_invalid) == (13, 19)


def test_counts_of_kilobases(spark):
    r = reads(spark, gs.KILOBASE_1, gs.KILOBASE_2, gs.KILOBASE_3)
    for k, want in ((9, [2540, 151, 18, 3, 2, 0]), (11, [2667, 41, 0]), (13, [2690, 12, 0]), (15, [2691, 5, 0])):
        n = ct.count_kmers(r, k).agg(*[F.count_if(F.col("abundance") >= i).alias(f"n{i}") for i in range(1, len(want) + 1)]).first()
        assert list(n) == want


def test_solidity_of_three_overlapping_banks(spark):
    r = reads(spark, "CGCTACAGCAGCTAGTT", "GCTACAGCAGCTAGTTA", "CTACAGCAGCTAGTTAC").withColumn("bank", F.col("read_id"))
    counts = ct.bank_counts(r, 15, "bank", [0, 1, 2]).persist()
    for least, want in ((1, (1, 5, 5)), (2, (0, 0, 3)), (3, (0, 0, 1))):
        assert tuple(counts.where(ct.solid(kind, [(least, 10**6)], 3)).count() for kind in ("min", "max", "sum")) == want


#: (least, greatest): solid k-mers by min, max, sum, all, one.
RANGES = {(1, 10**6): (1, 15, 15, 1, 15), (2, 10**6): (0, 2, 3, 0, 2), (3, 10**6): (0, 0, 1, 0, 0), (1, 1): (1, 13, 12, 0, 14), (1, 2): (1, 15, 14, 1, 15), (1, 3): (1, 15, 14, 1, 15), (2, 2): (0, 2, 2, 0, 2), (3, 3): (0, 0, 0, 0, 0), (3, 5): (0, 0, 1, 0, 0)}


def test_solidity_table(spark):
    r = reads(spark, "CGCTATCGCTA", "CGCTATAGTTA", "CGCTAACGCTA").withColumn("bank", F.col("read_id"))
    counts = ct.bank_counts(r, 5, "bank", [0, 1, 2]).persist()
    for bounds, want in RANGES.items():
        n = counts.agg(*[F.count_if(ct.solid(kind, [bounds], 3)).alias(kind) for kind in ("min", "max", "sum", "all", "one")]).first()
        assert tuple(n) == want, bounds


# ---------------------------------------------------------------- graphs


def ends_of(unitigs):
    """A unitig has two ends, one if it is a single k-mer."""
    return sum(1 if n == 1 else 2 for n in unitigs)


GRAPHS = {
    "tip": ([gs.LEFT, gs.TIP, gs.RIGHT], [7, 308, 309], 624, 617, 2),
    "bubble": ([gs.LEFT, *[gs.BUBBLE_STRONG] * 3, gs.BUBBLE_WEAK, gs.RIGHT_OF_BUBBLE], [21, 21, 280, 312], 634, 613, 2),
    "connection": ([*[gs.LEFT] * 5, *[gs.RIGHT] * 5, gs.TIP, *[gs.OTHER] * 5], [6, 145, 295, 308, 309], 1063, 1057, 4),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_simplified_graphs(spark, name):
    seqs, sizes, before, after, ends = GRAPHS[name]
    g = DeBruijnGraph.from_reads(reads(spark, *seqs), 21)
    g = DeBruijnGraph(g.nodes.persist(), 21)
    assert g.nodes.count() == before and sorted(x.n_kmers for x in g.unitigs().collect()) == sizes
    left = simplify(g)
    assert left.nodes.count() == after and ends_of(x.n_kmers for x in left.unitigs().collect()) == ends


def test_neighbours_of_5mers(spark):
    near = lambda seqs, node, out: {x[0] for x in (lambda g, o: (g.successors(o) if out else g.predecessors(o)).select(enc.letters(F.col("successor" if out else "predecessor"))))(DeBruijnGraph.from_reads(reads(spark, *seqs), 5), spark.createDataFrame([(node.translate(str.maketrans("ACTG", "0123")),)], "o string")).collect()}
    first = ["AGGCGA", "TTGCGA", "GCGAT", "GCGAA"]
    assert near(first, "GGCGA", True) == {"GCGAA", "GCGAT"} and near(first, "GCGAT", False) == {"GGCGA", "TGCGA"}
    more = ["AGGCGA", "TTGCGA", "GCGAT", "CGATA", "CGATT"]
    assert near(more, "GCGAT", True) == {"CGATA", "CGATT"} and near(more, "ATCGC", True) == {"TCGCC", "TCGCA"} and near(more, "ATCGC", False) == {"TATCG", "AATCG"}


def test_branching_successors(spark):
    r = reads(spark, "AGGCGCTAGGGAGAGGATGATGAAA", "AGGCGCTCGGGAGAGGATGATGAAA", "AGGCGCTTGGGAGAGGATGATGAAA")
    e = DeBruijnGraph.from_reads(r, 7).branching_edges().select(enc.letters(F.col("source")).alias("a"), enc.letters(F.col("target")).alias("b")).collect()
    assert [x.b for x in e if x.a == "AGGCGCT"] == ["GGGAGAG"] * 3


def test_queried_abundance(spark):
    r = reads(spark, *["CATTGATAGTGGACC"] * 4)
    g = DeBruijnGraph.from_reads(r, 10)
    got = g.abundance_of(spark.createDataFrame([("CATTGATAGT",), ("ACTATCAATG",)], "s string").select(enc.digits(F.col("s")).alias("q")), "q")
    assert [x.abundance for x in got.collect()] == [4, 4]
