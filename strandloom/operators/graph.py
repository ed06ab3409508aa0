"""De Bruijn graphs as tables: nodes are canonical k-mers, edges join oriented k-mers that overlap in
k - 1 letters. Nothing is stored but the nodes; edges are an equi-join on the overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import packed
from strandloom.functions.encoding import canonical, canonical_kmers, neighbours, revcomp
from strandloom.operators.counting import checksum, count_kmers
from strandloom.operators.histogram import discrete_class, discrete_value
from strandloom.operators import compaction
from strandloom.operators.iterate import components, cut, drop, ranked, smallest_on_rings


class DeBruijnGraph:
    """``nodes``: (kmer, abundance), kmer as canonical digits."""

    def __init__(self, nodes: DataFrame, k: int):
        self.nodes, self.k = nodes, k

    @classmethod
    def from_reads(cls, reads: DataFrame, k: int, abundance_min: int = 1, abundance_max: int = 2147483647, d: str = "d") -> DeBruijnGraph:
        counts = count_kmers(reads, k, d)
        return cls(counts.where(F.col("abundance").between(abundance_min, abundance_max)), k)

    @classmethod
    def load(cls, spark, path: str, k: int | None = None) -> DeBruijnGraph:
        """A stored graph; its k is among its properties."""
        if k is None:
            k = int(spark.read.parquet(f"{path}/properties").where("key = 'kmer_size'").first().value)
        return cls(spark.read.parquet(f"{path}/solid"), k)

    def save(self, path: str, **more: object) -> None:
        """Nodes, and a table (key, value) of properties: k, nodes, abundances, and what is given (such
        as the cutoff and the options of the build)."""
        kmers = cut(self.nodes, n=F.count(F.lit(1)), total=F.sum("abundance"), least=F.min("abundance"), most=F.max("abundance"))
        kmers.write.mode("overwrite").parquet(f"{path}/solid")
        m = kmers.measured
        found = {"kmer_size": self.k, "kmers_nb_solid": m["n"], "abundance_sum": m["total"] or 0, "abundance_least": m["least"], "abundance_most": m["most"], **more}
        rows = [(k, None if v is None else str(v)) for k, v in found.items()]
        kmers.sparkSession.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/properties")

    @staticmethod
    def info(spark, path: str) -> DataFrame:
        """(key, value) of a stored graph."""
        return spark.read.parquet(f"{path}/properties")

    # ------------------------------------------------------------ nodes and edges

    def oriented(self) -> DataFrame:
        """(o, kmer): both orientations of each node; one of a palindrome."""
        return self.nodes.select(F.explode(F.array_distinct(F.array("kmer", revcomp(F.col("kmer"))))).alias("o"), "kmer")

    def edges(self) -> DataFrame:
        """(source, target, nt): oriented k-mers where target continues source by one letter. Both
        mirror images of an edge are in it."""
        k, o = self.k, self.oriented().select("o")
        a = o.select(F.col("o").alias("source"), F.substr("o", F.lit(2)).alias("overlap"))
        b = o.select(F.col("o").alias("target"), F.substr("o", F.lit(1), F.lit(k - 1)).alias("overlap"))
        return a.join(b, "overlap").select("source", "target", F.substr("target", F.lit(-1)).alias("nt"))

    def incidences(self) -> DataFrame:
        """(kmer, junction, enters, side): the two ends of each node. A junction is the (k - 1)-mer at an end in the
        smaller orientation; the right end (1) enters its own, the left one (0) leaves it, the other way round
        where it is mirrored. Up to k = 31 all are packed; a node that is its own mirror image has one end."""
        k = self.k
        if k <= packed.WORD:
            w = F.col("kmer")
            rows = self.nodes.select(packed.packed(F.col("kmer"), k).alias("kmer"))
            ends, rc, own = (packed.prefix_word(w), packed.suffix_word(w, k)), (lambda j: packed.revcomp_word(j, k - 1)), packed.revcomp_word(w, k)
        else:
            w = F.col("kmer")
            rows = self.nodes.select("kmer")
            ends, rc, own = (F.substr("kmer", F.lit(1), F.lit(k - 1)), F.substr("kmer", F.lit(2))), revcomp, revcomp(w)
        end = lambda side, j: F.struct(F.lit(side).alias("side"), j.alias("j"), rc(j).alias("m"))
        both = F.when(w == own, F.array(end(1, ends[1]))).otherwise(F.array(end(0, ends[0]), end(1, ends[1])))
        x = rows.select("kmer", F.explode(both).alias("x")).select("kmer", "x.*")
        enters = F.when(F.col("j") == F.col("m"), F.lit(None)).otherwise((F.col("j") < F.col("m")) == (F.col("side") == 1))
        return x.select("kmer", F.least("j", "m").alias("junction"), enters.alias("enters"), "side")

    def degrees(self) -> DataFrame:
        """(kmer, indegree, outdegree) of each node in its canonical orientation. Nodes meet at their junctions, eight
        at most, and see there how many ways go on; a second shuffle brings both ends of a node together."""
        end = F.struct("kmer", "enters", "side")
        # at a junction that is its own mirror image (enters is null), every end comes in and goes out
        met = self.incidences().groupBy("junction").agg(F.collect_list(end).alias("x"), F.count_if("enters").alias("n_in"), F.count_if(~F.col("enters")).alias("n_out"), F.count("*").alias("n"))
        ways = F.when(F.col("e.enters").isNull(), F.col("n")).when(F.col("e.enters"), F.col("n_out")).otherwise(F.col("n_in"))
        each = met.select(F.explode("x").alias("e"), "n_in", "n_out", "n").select("e.kmer", "e.side", ways.alias("ways"))
        out = each.groupBy("kmer").agg(F.max(F.when(F.col("side") == 0, F.col("ways"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("ways"))).alias("r"))
        name = packed.unpacked(self.k) if self.k <= packed.WORD else F.col("w0")
        return out.withColumnRenamed("kmer", "w0").select(name.alias("kmer"), F.coalesce("l", "r").alias("indegree"), F.col("r").alias("outdegree"))

    def neighbours(self) -> DataFrame:
        """(kmer, direction, nt, neighbour): extensions that are nodes; direction 1 right, 2 left."""
        found = self.nodes.select("kmer", F.explode(neighbours(F.col("kmer"), self.k)).alias("x")).select("kmer", "x.direction", "x.nt", F.col("x.kmer").alias("neighbour"))
        return found.join(self.nodes.select(F.col("kmer").alias("neighbour")), "neighbour", "left_semi").select("kmer", "direction", "nt", "neighbour")

    def successors(self, oriented: DataFrame, nt: str | None = None) -> DataFrame:
        """(o, nt, successor) of oriented k-mers (column o), of one nucleotide if given."""
        if self.k <= packed.WORD:
            return self._beside(oriented, nt, True)
        ext = F.explode(F.array(*[F.lit(x) for x in ("0123" if nt is None else nt)])).alias("nt")
        found = oriented.select("o", ext).withColumn("successor", F.concat(F.substr("o", F.lit(2)), "nt"))
        return found.join(self.nodes.select(F.col("kmer").alias("_c")), canonical(F.col("successor")) == F.col("_c"), "left_semi")

    def predecessors(self, oriented: DataFrame, nt: str | None = None) -> DataFrame:
        """(o, nt, predecessor) of oriented k-mers."""
        if self.k <= packed.WORD:
            return self._beside(oriented, nt, False)
        ext = F.explode(F.array(*[F.lit(x) for x in ("0123" if nt is None else nt)])).alias("nt")
        found = oriented.select("o", ext).withColumn("predecessor", F.concat("nt", F.substr("o", F.lit(1), F.lit(self.k - 1))))
        return found.join(self.nodes.select(F.col("kmer").alias("_c")), canonical(F.col("predecessor")) == F.col("_c"), "left_semi")

    def _beside(self, oriented: DataFrame, nt: str | None, after: bool) -> DataFrame:
        """``successors`` or ``predecessors`` up to k = 31: a k-mer meets the nodes that share its k - 1 letters at their
        packed word, one row a node and orientation; the letter that is left is the nucleotide."""
        k, w = self.k, F.col("w")
        both = self.nodes.select(packed.packed(F.col("kmer"), k).alias("w")).select(F.explode(F.array_distinct(F.array(w, packed.revcomp_word(w, k)))).alias("w"))
        shared, letter = (packed.prefix_word(w), w.bitwiseAND(F.lit(3).cast("bigint"))) if after else (packed.suffix_word(w, k), F.shiftright(w, 2 * (k - 1)))
        nodes = both.select(shared.alias("_j"), letter.cast("tinyint").alias("_n"))
        if nt is not None:
            nodes = nodes.where(F.col("_n").isin([int(x) for x in nt]))
        kept = F.substr("o", F.lit(2)) if after else F.substr("o", F.lit(1), F.lit(k - 1))
        valid = (F.length(kept) == k - 1) & (F.translate(kept, "0123", "") == "")
        met = oriented.select("o").where(valid).withColumn("_j", packed.packed(kept, k - 1)).join(nodes, "_j").select("o", F.col("_n").cast("string").alias("nt"))
        return met.withColumn("successor", F.concat(kept, "nt")) if after else met.withColumn("predecessor", F.concat("nt", kept))

    def contains(self, kmers: DataFrame, col: str = "kmer") -> DataFrame:
        """The rows whose k-mer, in either orientation, is a node."""
        return kmers.join(self.nodes.select(F.col("kmer").alias("_c")), canonical(F.col(col)) == F.col("_c"), "left_semi")

    def abundance_of(self, kmers: DataFrame, col: str = "kmer", classes: bool = False) -> DataFrame:
        """The rows that are nodes, with ``abundance``; with ``classes``, also its class and the value that
        stands for the class (exact up to 70)."""
        found = kmers.join(self.nodes.select(F.col("kmer").alias("_c"), "abundance"), canonical(F.col(col)) == F.col("_c")).drop("_c")
        return found.withColumns({"class": discrete_class(F.col("abundance")), "value": discrete_value(F.col("abundance"))}) if classes else found

    def among_reads(self, reads: DataFrame, keep: tuple[str, ...], d: str = "d", pos: str | None = None, some: DataFrame | None = None) -> DataFrame:
        """(keep, [pos,] abundance): the k-mers of reads that are nodes; of ``some`` nodes (kmer) if given, then without
        abundances. Up to k = 31 both sides meet as packed words, not as texts."""
        if self.k > packed.WORD:
            raise ValueError("k-mers of reads are looked up by one word")
        rows = packed.packed_rows(reads, self.k, keep, d, pos=pos)
        named = [*keep, *([pos] if pos else [])]
        word = packed.packed(F.col("kmer"), self.k).alias("w0")
        if some is not None:
            return rows.join(some.select(word), "w0", "left_semi").select(*named)
        return rows.join(self.nodes.select(word, "abundance"), "w0").select(*named, "abundance")

    def neighbours_of(self, some: DataFrame) -> DataFrame:
        """Distinct neighbours of a set of nodes (column kmer)."""
        return self.neighbours().join(some, "kmer", "left_semi").select(F.col("neighbour").alias("kmer")).distinct()

    def around(self, some: DataFrame, levels: int) -> DataFrame:
        """(kmer, level): nodes within ``levels`` steps of a set (column kmer, level 0), each at the first
        level that reaches it. One join a level."""
        front = cut(some.select("kmer").distinct())
        seen = front.select("kmer", F.lit(0).alias("level"))
        near = self.neighbours().select("kmer", "neighbour")
        for level in range(1, levels + 1):
            found = near.join(front, "kmer", "left_semi").select(F.col("neighbour").alias("kmer")).distinct()
            front = cut(found.join(seen, "kmer", "left_anti"), n=F.count(F.lit(1)))
            seen = seen.unionByName(front.select("kmer", F.lit(level).alias("level")))
            if not front.measured["n"]:
                break
        return seen

    def without(self, doomed: DataFrame) -> DeBruijnGraph:
        """The graph without some nodes (column kmer): one anti join a batch of deletions."""
        return DeBruijnGraph(self.nodes.join(doomed, "kmer", "left_anti"), self.k)

    # ------------------------------------------------------------ topology

    def branching(self) -> DataFrame:
        """(kmer, indegree, outdegree) of the nodes that are not inside a simple path."""
        return self.degrees().where("NOT (indegree = 1 AND outdegree = 1)")

    def topology(self) -> DataFrame:
        """(indegree, outdegree, n): classes of branching nodes."""
        return self.branching().groupBy("indegree", "outdegree").agg(F.count("*").alias("n"))

    def avance(self) -> DataFrame:
        """(o, step): what a walk along a simple path finds at each oriented node: 1 the next node,
        0 no extension, -1 several, -2 one that others reach too."""
        e = self.edges()
        out = e.groupBy("source").agg(F.count("*").alias("outs"), F.min("target").alias("next"))
        into = e.groupBy("target").agg(F.count("*").alias("ins"))
        o = self.oriented().select("o").join(out, F.col("o") == F.col("source"), "left").join(into, F.col("next") == F.col("target"), "left")
        return o.select("o", F.when(F.col("outs").isNull(), 0).when(F.col("outs") > 1, -1).when(F.col("ins") > 1, -2).otherwise(1).alias("step"))

    def isolated(self) -> DataFrame:
        return self.nodes.join(self.neighbours().select("kmer").distinct(), "kmer", "left_anti").select("kmer")

    def digest(self) -> DataFrame:
        """One row: nodes, edges, branching nodes, abundances, checksums."""
        branching = self.branching().select("kmer")
        one = self.nodes.agg(F.count("*").alias("nb_solids"), F.sum("abundance").alias("sum_abundance"))
        two = self.edges().agg(F.count("*").alias("nb_edges"))
        three = branching.agg(F.count("*").alias("nb_branching"))
        sums = [checksum(x).withColumnRenamed("checksum", n) for x, n in ((self.nodes, "checksum_nodes"), (branching, "checksum_branching"))]
        return one.join(two).join(three).join(sums[0]).join(sums[1])  # one row each

    # ------------------------------------------------------------ simple paths

    def links(self) -> DataFrame:
        """(o, next) where a path goes on without a choice: one way out, one way in, and not into the
        mirror image of the same node."""
        e = self.edges()
        one_out = e.groupBy("source").agg(F.count("*").alias("n"), F.min("target").alias("next")).where("n = 1").select(F.col("source").alias("o"), "next")
        one_in = e.groupBy("target").agg(F.count("*").alias("n")).where("n = 1").select(F.col("target").alias("next"))
        both = one_out.join(one_in, "next", "left_semi")
        return both.where(canonical(F.col("o")) != canonical(F.col("next"))).select("o", "next")

    def chains(self) -> DataFrame:
        """(o, head, rank, circular): every oriented node's place on its maximal simple path, by
        pointer jumping. Cycles are cut at their smallest k-mer; of a cycle and its mirror image, the
        one that has this k-mer in its canonical orientation stays."""
        before = self.links().select(F.col("next").alias("o"), F.col("o").alias("before"))
        paths, rings = ranked(self.oriented().select("o").join(before, "o", "left"))
        out = paths.select("o", F.col("ptr").alias("head"), "rank", F.lit(False).alias("circular"))
        if rings is None:
            return out
        c = canonical(F.col("o"))
        low = smallest_on_rings(rings, F.struct(c.alias("c"), F.when(F.col("o") == c, 0).otherwise(1).alias("s")))
        first = F.col("o") == F.col("low.c")
        again, _ = ranked(low.where("low.s = 0").select("o", "low").join(rings, "o").select("o", F.when(~first, F.col("before")).alias("before")))
        drop(low)
        drop(rings)
        return out.unionByName(again.select("o", F.col("ptr").alias("head"), "rank", F.lit(True).alias("circular")))

    def unitigs(self) -> DataFrame:
        """A table (seq, n_kmers, circular, abundances, kc): maximal simple paths as canonical digits, with
        the abundances along them. For odd k, k-mers are compacted in buckets, and only pieces that cross
        buckets are put together by rounds over all tasks; for even k, where a k-mer may be its own mirror
        image, by ranks of all nodes. A unitig is gathered in one group: its rows are its pieces."""
        if self.k % 2 and self.k > 2:
            return compaction.unitigs(self.nodes, self.k)
        chain = self.chains().withColumn("kmer", canonical(F.col("o"))).join(self.nodes, "kmer")
        rows = chain.groupBy("head", "circular").agg(F.sort_array(F.collect_list(F.struct("rank", F.substr("o", F.lit(-1)).alias("nt"), "abundance"))).alias("x"))
        seq = F.concat(F.substr("head", F.lit(1), F.lit(self.k - 1)), F.array_join(F.col("x.nt"), ""))
        rows = rows.select(seq.alias("s"), "circular", F.col("x.abundance").alias("a"))
        keep = F.col("circular") | (F.col("s") <= revcomp(F.col("s")))
        return rows.where(keep).select(F.col("s").alias("seq"), F.size("a").cast("bigint").alias("n_kmers"), "circular", F.col("a").alias("abundances"), F.aggregate("a", F.lit(0).cast("bigint"), lambda p, x: p + x).alias("kc"))

    def unitig_links(self, unitigs: DataFrame, name: str = "seq") -> DataFrame:
        """(from_seq, from_sign, to_seq, to_sign): unitigs that overlap in k - 1 letters, in all
        orientations; by another column of ``unitigs`` if one is named. An overlap of fewer than three letters is an
        error."""
        k = self.k
        if k < 4:
            raise ValueError("unitigs are linked for k of 4 at least")
        first, last = F.substr("seq", F.lit(1), F.lit(k - 1)), F.substr("seq", F.lit(-(k - 1)))
        way = lambda sign, begins, ends: F.struct(F.lit(sign).alias("sign"), begins.alias("begins"), ends.alias("ends"))
        both = unitigs.select(name, F.explode(F.array(way("+", first, last), way("-", revcomp(last), revcomp(first)))).alias("x")).select(name, "x.*")
        a = both.select(F.col(name).alias(f"from_{name}"), F.col("sign").alias("from_sign"), F.col("ends").alias("overlap"))
        b = both.select(F.col(name).alias(f"to_{name}"), F.col("sign").alias("to_sign"), F.col("begins").alias("overlap"))
        return a.join(b, "overlap").select(f"from_{name}", "from_sign", f"to_{name}", "to_sign")

    def unitig_nodes(self, unitigs: DataFrame) -> DataFrame:
        """(first_node, last_node, n_kmers, mean, free_left, free_right) of unitigs: the oriented nodes at
        their ends, mean abundance, and whether nothing is linked to an end."""
        u = cut(unitigs.select("seq", "n_kmers", (F.col("kc") / F.col("n_kmers")).alias("mean")))
        sides = self.unitig_links(u).groupBy(F.col("from_seq").alias("seq")).agg(F.count_if(F.col("from_sign") == "+").alias("r"), F.count_if(F.col("from_sign") == "-").alias("l"))
        free = lambda c: (F.coalesce(c, F.lit(0)) == 0)
        return u.join(sides, "seq", "left").select(F.substr("seq", F.lit(1), F.lit(self.k)).alias("first_node"), F.substr("seq", F.lit(-self.k)).alias("last_node"), "n_kmers", "mean", free("l").alias("free_left"), free("r").alias("free_right"))

    def branching_edges(self) -> DataFrame:
        """(source, target, distance): simple paths between oriented branching nodes; distance in
        steps."""
        if self.k % 2 == 0 or self.k < 4:
            return self._branching_edges_by_node()
        k, made = self.k, self.unitigs()
        both = made.where("NOT circular").select(F.explode(F.array("seq", revcomp(F.col("seq")))).alias("s"), F.col("n_kmers").alias("n"))
        u = cut(both.select(F.substr("s", F.lit(1), F.lit(k)).alias("head"), F.substr("s", F.lit(-k)).alias("tail"), "n"))
        # inside of a unitig no node branches, and edges that are not inside of one lead from a tail to a head
        arcs = cut(u.select("tail", F.substr("tail", F.lit(2)).alias("overlap")).join(u.select("head", F.substr("head", F.lit(1), F.lit(k - 1)).alias("overlap")), "overlap").select("tail", "head"))
        count = lambda c, n: arcs.groupBy(c).agg(F.count("*").alias(n))
        ways = u.join(count("head", "ins"), "head", "left").join(count("tail", "outs"), "tail", "left")
        one_in, one_out = (F.coalesce(F.col(c), F.lit(0)) == 1 for c in ("ins", "outs"))
        alone = F.col("n") == 1
        first, last = F.when(alone, ~(one_in & one_out)).otherwise(~one_in), F.when(alone, ~(one_in & one_out)).otherwise(~one_out)
        ways = cut(ways.select("head", "tail", "n", first.alias("first"), last.alias("last")))
        forks = lambda c: ways.where("last").select(F.col("tail").alias(c))
        # what leads into a unitig's simple nodes: its own head, or a branching tail; where a simple tail leads to its
        # own mirror image, the way goes back along the unitig
        outer = ways.where("NOT first").join(arcs.join(forks("tail"), "tail").select(F.col("tail").alias("source"), "head"), "head")
        into = ways.where("first AND n > 1").withColumn("source", F.col("head")).select(*outer.columns).unionByName(outer)
        into = into.withColumn("simple", F.col("n") - F.col("first").cast("bigint") - F.col("last").cast("bigint"))
        within = into.where("last").select("source", F.col("tail").alias("target"), (F.col("simple") + 1).alias("distance"))
        onward = into.where("NOT last").join(arcs.withColumnRenamed("head", "_next"), "tail")
        mirror = F.col("_next") == revcomp(F.col("tail"))
        entered = ways.where("first").select(F.col("head").alias("_next"))
        there = onward.where(~mirror).join(entered, "_next").select("source", F.col("_next").alias("target"), (F.col("simple") + 1).alias("distance"))
        back = onward.where(mirror).select("source", revcomp(F.col("source")).alias("target"), (2 * F.col("simple") + 1).alias("distance"))
        direct = arcs.join(forks("tail"), "tail").join(entered.withColumnRenamed("_next", "head"), "head").select(F.col("tail").alias("source"), F.col("head").alias("target"), F.lit(1).cast("bigint").alias("distance"))
        if hasattr(made, "written"):
            drop(made)
        return direct.unionByName(within).unionByName(there).unionByName(back)

    def _branching_edges_by_node(self) -> DataFrame:
        """``branching_edges`` where a node may be its own mirror image."""
        branching = self.branching().select("kmer")
        simple = self.nodes.join(branching, "kmer", "left_anti").select("kmer")
        e = self.edges()
        ends = self.oriented().join(branching, "kmer", "left_semi").select("o")
        inner = self.oriented().join(simple, "kmer", "left_semi").select("o")
        direct = e.join(ends.select(F.col("o").alias("source")), "source", "left_semi").join(ends.select(F.col("o").alias("target")), "target", "left_semi").select("source", "target", F.lit(1).cast("bigint").alias("distance"))
        # simple nodes in chains among themselves: each has one way in and one way out
        within = e.join(inner.select(F.col("o").alias("source")), "source", "left_semi").join(inner.select(F.col("o").alias("target")), "target", "left_semi")
        state, _ = ranked(inner.join(within.select(F.col("target").alias("o"), F.col("source").alias("before")), "o", "left"))
        enter = e.join(ends.select(F.col("o").alias("source")), "source", "left_semi").select(F.col("source").alias("from"), F.col("target").alias("ptr"))
        leave = e.join(ends.select(F.col("o").alias("target")), "target", "left_semi").select(F.col("source").alias("o"), F.col("target").alias("to"))
        paths = state.join(enter, "ptr").join(leave, "o").select(F.col("from").alias("source"), F.col("to").alias("target"), (F.col("rank") + 2).alias("distance"))
        return direct.unionByName(paths)

    def components(self) -> DataFrame:
        """(kmer, component): connected components over all nodes."""
        e = self.neighbours().select(F.col("kmer").alias("a"), F.col("neighbour").alias("b"))
        found = components(e)
        out = self.nodes.select("kmer").join(found, F.col("kmer") == F.col("node"), "left")
        return out.select("kmer", F.coalesce("component", "kmer").alias("component"))

    def branching_classes(self) -> DataFrame:
        """(component, nodes, shortest, longest): components of the graph of branching nodes alone,
        joined where a simple path leads from one to another, with the distances of these paths."""
        e = cut(self.branching_edges())
        pairs = e.select(canonical(F.col("source")).alias("a"), canonical(F.col("target")).alias("b"), "distance")
        found = components(pairs.select("a", "b"))
        nodes = self.branching().select("kmer").join(found, F.col("kmer") == F.col("node"), "left").select("kmer", F.coalesce("component", "kmer").alias("component"))
        paths = pairs.join(nodes, F.col("a") == F.col("kmer")).groupBy("component").agg(F.min("distance").alias("shortest"), F.max("distance").alias("longest"))
        return nodes.groupBy("component").agg(F.count("*").alias("nodes")).join(paths, "component", "left").select("component", "nodes", "shortest", "longest")

    def snp_bubbles(self) -> DataFrame:
        """(source, target): oriented branching nodes with two ways out that meet again after exactly
        k + 1 steps each: two alleles of one letter."""
        e = self.branching_edges().where(F.col("distance") == self.k + 1)
        deg = self.degrees()
        o = self.oriented().join(deg, "kmer")
        outs = F.when(F.col("o") == F.col("kmer"), F.col("outdegree")).otherwise(F.col("indegree"))
        ins = F.when(F.col("o") == F.col("kmer"), F.col("indegree")).otherwise(F.col("outdegree"))
        forks = o.where((outs == 2) & (ins == 1)).select(F.col("o").alias("source"))
        pairs = e.join(forks, "source", "left_semi").groupBy("source", "target").agg(F.count("*").alias("n")).where("n = 2")
        # each bubble is there twice, once from either end
        return pairs.where(F.struct("source") <= F.struct(revcomp(F.col("target")))).select("source", "target")


def read_branching(graph: DeBruijnGraph, reads: DataFrame, id_col: str, kmers: Column | None = None, d: str = "d") -> DataFrame:
    """(n_branching, n_reads): how many k-mers of a read branch, and of how many reads. The k-mers of column ``d``,
    unless a column of arrays is given."""
    some = graph.branching().select("kmer")
    if kmers is None and graph.k <= packed.WORD:
        found = graph.among_reads(reads, (id_col,), d, some=some)
    else:
        found = reads.select(id_col, F.explode(canonical_kmers(F.col(d), graph.k) if kmers is None else kmers).alias("kmer")).join(some, "kmer", "left_semi")
    hit = found.groupBy(id_col).agg(F.count("*").alias("n"))
    every = reads.select(id_col).join(hit, id_col, "left").select(F.coalesce("n", F.lit(0)).alias("n_branching"))
    return every.groupBy("n_branching").agg(F.count("*").alias("n_reads"))


def dense_ids(nodes: DataFrame, parts: int) -> DataFrame:
    """(kmer, id): ids 0.. in the order of k-mers. Rows are range-partitioned, ranked inside their
    partition and moved by what lies before it, so no single task orders them all."""
    ranged = cut(nodes.select("kmer").repartitionByRange(parts, "kmer").withColumn("p", F.spark_partition_id()))
    sizes = {x.p: x.n for x in ranged.groupBy("p").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map()
    w = Window.partitionBy("p").orderBy("kmer")
    return ranged.select("kmer", (F.row_number().over(w) - 1 + F.element_at(offset, F.col("p"))).cast("bigint").alias("id")) if before else nodes.select("kmer", F.lit(0).cast("bigint").alias("id"))


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``id``: numbers from 0 in the order of a column. Rows are range-partitioned and sorted inside of their
    partition once, and moved by what lies before it; there are as many partitions as in any shuffle."""
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = cut(rows.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("_m", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
    before, total = [], 0
    for p, n in sorted(tuple(x) for x in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):  # a row a partition
        before += [F.lit(p).cast("bigint"), F.lit(total).cast("bigint")]
        total += n
    base = F.element_at(F.create_map(*before), part) if before else F.lit(0).cast("bigint")
    return held.withColumn("id", base + inside).drop("_m")
