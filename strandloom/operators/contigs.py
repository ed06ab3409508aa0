"""Contigs that share no node: walks across bubbles from a table of seeds in an order, each node to one contig.

The result is that of seeds taken one after the other: a seed whose unitig is marked gives nothing; another goes to
the right across bubbles as long as all unitigs of the next one (on any walk through it) are unmarked, marks
them, and then goes to the left.

All seeds go on together. Each side of a seed is a walker, with its place in the order. In a round every walker that
can go on asks for the unitigs of its next step. It gets them if of each of them it is the first in the order among
those that ask for it and its owner; an owner that comes later gives up that step and all after it. A walker that
meets an earlier owner waits until the unitig is given up. When nobody can go on, each walk ends by itself or before
a unitig of an earlier one, which is the outcome of the order: the first walker never yields, and so on by induction.
A unitig has one owner at any time, so tables are never larger than the unitig graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.encoding import kmers, revcomp
from strandloom.operators.iterate import cut, drop
from strandloom.operators.traversal import Bounds, Paths, crossings

_STEP = "walker bigint, pos bigint, fork string, next string, add string, wide boolean, items array<string>"


def by_length(paths: Paths) -> DataFrame:
    """(seed, place): all unitigs by their first node, the longest first, ties by that node; a unitig is written in the
    orientation whose first node is smaller."""
    one = paths.unitigs.where(F.col("head") == _unitig("head", "tail")).select("head", "n")
    return one.select(F.col("head").alias("seed"), F.struct((-F.col("n")).alias("n"), F.col("head")).alias("place"))


def _unitig(head: str, tail: str):
    """The name of a unitig, the same for both orientations."""
    return F.least(F.col(head), revcomp(F.col(tail)))


def steps(paths: Paths, bounds: Bounds) -> DataFrame:
    """(fork, next, add, wide, items): for each end of a unitig where a walk can go on: the end of the unitig that it
    is at then, the letters up to there, whether more than a letter was chosen among several walks, and the unitigs
    on all walks through the bubble."""
    k = paths.k
    across, texts = crossings(paths, bounds)
    good = across.where("stop IS NULL").select("fork", "text", F.col("end").alias("at"))
    on = paths.ahead(good).select("fork", F.concat("text", "more").alias("add"), (F.length("text") > 1).alias("wide"), F.col("tail").alias("next"))
    met = texts.select("fork", F.explode("texts").alias("t")).select("fork", F.explode(F.slice(kmers(F.concat("fork", "t"), k), F.lit(2), F.length("t"))).alias("o"))
    named = paths.unitigs.select("head", _unitig("head", "tail").alias("item"))
    items = met.join(paths.places.select("o", "head"), "o").join(named, "head").groupBy("fork").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = cut(on.join(items, "fork"))
    for t in (across, texts):
        drop(t)
    return out


def contigs(paths: Paths, seeds: DataFrame | None = None, bounds: Bounds | None = None) -> DataFrame:
    """(seed, text, unitigs, bubbles): contigs from unitigs named by their first node (``seed``), in the order of
    ``place`` (any orderable column; no two alike); all unitigs, longest first, unless ``seeds`` are given. ``unitigs``
    counts those that the contig marks, ``bubbles`` the places where it chose among walks. Seeds that are no first
    node of a unitig and seeds on an earlier contig give no row; an empty table gives none. ``bounds.length`` is not
    applied: a contig ends at the latest where all unitigs are marked."""
    bounds = bounds or Bounds()
    seeds = by_length(paths) if seeds is None else seeds
    way = cut(seeds.join(paths.unitigs.select(F.col("head").alias("seed"), "tail", "s"), "seed"))
    order = cut(_ranked(way.select("seed", "place")))
    first = way.join(order, "seed").select((2 * F.col("rank")).alias("walker"), "seed", "tail", "s", _unitig("seed", "tail").alias("item"))
    first = cut(first)
    every = steps(paths, bounds)
    ways = every.select(F.col("fork").alias("_fork"), "next", "add", "wide", "items")
    spark = paths.unitigs.sparkSession
    held = cut(spark.createDataFrame([], _STEP))
    # fronts: where a walker is (fork null: its seed is not its own yet), and the unitig that it waits for
    fronts = cut(first.select("walker", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("fork"), F.lit(None).cast("string").alias("waits")))
    start = first.select(F.col("walker").alias("_w"), F.col("tail").alias("next"), F.col("s").alias("add"), F.lit(False).alias("wide"), F.array("item").alias("items"))
    while True:
        owned = held.select("walker", "pos", F.explode("items").alias("item"))
        go = fronts.where("waits IS NULL")
        begin = go.where("fork IS NULL").join(start, F.col("walker") == F.col("_w")).select("walker", "pos", "fork", "next", "add", "wide", "items")
        onward = go.where("fork IS NOT NULL").join(ways, F.col("fork") == F.col("_fork")).select("walker", "pos", "fork", "next", "add", "wide", "items")
        asked = cut(begin.unionByName(onward), n=F.count(F.lit(1)))
        if not asked.measured["n"]:
            drop(asked)
            break
        want = asked.select("walker", F.explode("items").alias("item"))
        # the first in the order of those that ask for a unitig and its owner
        rival = want.groupBy("item").agg(F.min("walker").alias("best"))
        owner = owned.join(rival.select("item"), "item", "left_semi").select("item", F.col("walker").alias("owner"), F.col("pos").alias("at"))
        seen = cut(want.join(rival, "item").join(owner, "item", "left"))
        # an owner that is not later blocks (its own walk, too); the first asker's turn comes before that of others
        blocked = F.col("owner").isNotNull() & (F.col("owner") <= F.col("walker"))
        told = seen.groupBy("walker").agg(F.min(F.when(blocked, F.col("item"))).alias("waits"), F.bool_and(F.col("best") == F.col("walker")).alias("first"))
        told = cut(told.withColumn("wins", F.col("waits").isNull() & F.col("first")))
        wins = asked.join(told.where("wins").select("walker"), "walker", "left_semi")
        # steps given up: from the first that holds a unitig which an earlier walker gets; without its seed's
        # unitig neither side of a seed holds anything
        lost = seen.join(told.where("wins").select("walker"), "walker", "left_semi").where("owner IS NOT NULL").groupBy(F.col("owner").alias("loser")).agg(F.min("at").alias("since"))
        whole = lost.where("since = 0 AND loser % 2 = 0").select((F.col("loser") + 1).alias("loser"), F.lit(0).cast("bigint").alias("since"))
        lost = cut(lost.unionByName(whole).groupBy("loser").agg(F.min("since").alias("since")))
        marked = held.join(lost, F.col("walker") == F.col("loser"), "left")
        # what a walker gets in the round in which it loses an earlier step does not count
        wins = wins.join(lost.select(F.col("loser").alias("walker")), "walker", "left_anti")
        kept = marked.where("since IS NULL OR pos < since").select(*held.columns)
        given = marked.where("pos >= since").select("walker", "pos", "fork", F.explode("items").alias("item"))
        taken = wins.select(F.explode("items").alias("item"))
        free = given.select("item").distinct().join(taken, "item", "left_anti")
        # a walker that gave up is where its first lost step began, and asks again; a left side without a seed is gone
        gone = lost.where("since = 0 AND loser % 2 = 0").select((F.col("loser") + 1).alias("walker"))
        back = marked.where("pos = since").select("walker", "pos", "fork", F.lit(None).cast("string").alias("waits"))
        stay = fronts.join(lost.select(F.col("loser").alias("walker")), "walker", "left_anti").join(told.select("walker", F.col("waits").alias("_waits"), "wins"), "walker", "left")
        woken = free.select(F.col("item").alias("waits"), F.lit(True).alias("woken"))
        wait = stay.where("NOT coalesce(wins, false)").select("walker", "pos", "fork", F.coalesce("_waits", "waits").alias("waits"))
        # ends without a way on drop out: nobody asks for them again, unless the walk is cut back
        live = wait.where("fork IS NULL").unionByName(wait.where("fork IS NOT NULL").join(every.select("fork"), "fork", "left_semi").select(*wait.columns))
        live = live.join(woken, "waits", "left").select("walker", "pos", "fork", F.when(F.col("woken").isNull(), F.col("waits")).alias("waits"))
        moved = wins.select("walker", (F.col("pos") + 1).alias("pos"), F.col("next").alias("fork"), F.lit(None).cast("string").alias("waits"))
        left = wins.where("fork IS NULL").join(first.select("walker", "seed"), "walker").select((F.col("walker") + 1).alias("walker"), F.lit(0).cast("bigint").alias("pos"), revcomp(F.col("seed")).alias("fork"), F.lit(None).cast("string").alias("waits"))
        fresh = back.join(gone, "walker", "left_anti").unionByName(live).unionByName(moved).unionByName(left)
        old = (held, fronts, asked, seen, told, lost)
        held, fronts = cut(kept.unionByName(wins)), cut(fresh)
        for t in old:
            drop(t)
    side = held.where("fork IS NOT NULL").groupBy((F.col("walker") - F.col("walker") % 2).alias("walker"), (F.col("walker") % 2).alias("side")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "add"))), lambda x: x.add), "").alias("adds"), F.sum(F.size("items")).alias("marks"), F.count_if("wide").alias("wide"))
    right, left = (side.where(F.col("side") == i).select("walker", F.col("adds").alias(f"adds{i}"), F.col("marks").alias(f"marks{i}"), F.col("wide").alias(f"wide{i}")) for i in (0, 1))
    own = held.where("fork IS NULL").select("walker").join(first.select("walker", "seed", "s"), "walker")
    none, zero = F.lit(""), F.lit(0)
    rows = own.join(right, "walker", "left").join(left, "walker", "left")
    text = F.concat(revcomp(F.coalesce("adds1", none)), F.col("s"), F.coalesce("adds0", none))
    out = cut(rows.select("seed", text.alias("text"), (1 + F.coalesce("marks0", zero) + F.coalesce("marks1", zero)).alias("unitigs"), (F.coalesce("wide0", zero) + F.coalesce("wide1", zero)).alias("bubbles")))
    for t in (way, order, first, every, held, fronts):
        drop(t)
    return out


def _ranked(rows: DataFrame) -> DataFrame:
    """(seed, rank): numbers from 0 in the order of ``place``: rows are range-partitioned, numbered in their partition,
    and moved by the sizes of the partitions before (a row a partition)."""
    sorted_ = rows.repartitionByRange("place").sortWithinPartitions("place")
    held = cut(sorted_.select("seed", "place", F.spark_partition_id().alias("part")))
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("place")) - 1
    return held.withColumn("inside", inside).join(F.broadcast(before), "part").select("seed", (F.col("base") + F.col("inside")).cast("bigint").alias("rank"))
