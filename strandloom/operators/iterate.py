"""Shared tools of the iterative operators: tables that cut the lineage, components of graphs."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. A local session
    without one gets a temporary folder; on a cluster that is an error, as each machine would have
    its own."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        own = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clear() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is not None:
            try:
                delete(spark, path)
            except Exception:  # the session's JVM may be gone; the folder is the cluster's to clean then
                return


def cut(df: DataFrame, **measures: Column) -> DataFrame:
    """The rows of ``df``, written to the shared folder: the loop's next step starts from there, and
    an executor that is lost takes nothing with it. ``measures`` are aggregates of the rows, taken as
    they are written and found in ``.measured`` of the result. Tables go when the driver ends; a
    loop drops those that it no longer reads (``drop``)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/step-{uuid.uuid4().hex}"
    seen = Observation() if measures else None
    rows = df.observe(seen, *[c.alias(n) for n, c in measures.items()]) if seen is not None else df
    rows.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.measured, out.written = (seen.get if seen is not None else {}), path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table of a ``cut``."""
    delete(df.sparkSession, df.written)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) from undirected edges (a, b): the smallest node of each component, by
    alternating large-star and small-star steps until nothing changes."""
    state = {"n": F.count(F.lit(1)), "h": F.bit_xor(F.xxhash64("a", "b"))}  # rows and an order-free hash: equal for equal tables
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), **state)
    for _ in range(most if e.measured["n"] else 0):
        around = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(low, "u").where("v > u AND m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        both = F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))
        new = cut(large.join(low, "b").select(F.explode(both).alias("x")).select("x.*").where("a <> b").distinct(), **state)
        same = new.measured == e.measured
        drop(e)
        e = new
        if same:
            break
    else:
        if e.measured["n"]:
            raise RuntimeError(f"components did not settle in {most} rounds")
    low = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    roots = low.select(F.col("component").alias("node"), "component").distinct()
    return low.unionByName(roots)


#: Rows of a loop that one task takes over: some ten bytes each, so a bounded part of its memory.
ONE_TASK = 1 << 20


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rest of a loop of ``ranked`` in one task: rows (o, before, ptr, rank, settled, new); gives those that are
    ``new`` or were not settled. What is not settled in the end goes round in rings."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    o = t.column("o")
    ptr = pc.index_in(t.column("ptr"), value_set=o.combine_chunks()).to_numpy().copy()
    rank, settled = (t.column(c).to_numpy().copy() for c in ("rank", "settled"))
    asked, left = np.flatnonzero(~settled | t.column("new").to_numpy()), np.flatnonzero(~settled)
    while len(left):
        p = ptr[left]
        rank[left] += rank[p]
        end = settled[p]
        ptr[left], settled[left] = ptr[p], end
        if not end.any():
            break
        left = left[~end]
    rows = pa.array(asked)
    yield from pa.table([o.take(rows), t.column("before").take(rows), t.column("ptr").take(pa.array(ptr[asked])), pa.array(rank[asked]), pa.array(settled[asked])], names=["o", "before", "ptr", "rank", "settled"]).to_batches(10_000)


def ranked(start: DataFrame, one_task: int = ONE_TASK) -> tuple[DataFrame, DataFrame | None]:
    """From (o, before), before null at heads: tables ((o, ptr, rank): the head that leads to a node and the steps
    from it; (o, before) of what goes round in rings, or None).

    Pointers double each round. In the loop are open rows and the settled rows that one of them asks for, at
    most as many: a settled row that nobody asks for now is never asked for again. When no more than
    ``one_task`` rows are left, one task settles them. A round that settles nothing leaves rings alone: a path
    that is not settled yet always has nodes whose heads are within the next reach."""
    head, count = F.col("before").isNull(), {"n": F.count(F.lit(1)), "open": F.count_if(~F.col("settled"))}
    columns = ["o", "before", "ptr", "rank", "settled"]
    state = cut(start.select("o", "before", F.coalesce("before", "o").alias("ptr"), F.when(head, 0).otherwise(1).cast("bigint").alias("rank"), head.alias("settled")), **count)
    tables, left, size = [state], state.measured["open"], state.measured["n"]
    done, open_, pool = [state.where("settled")], state.where("NOT settled"), state.where("settled")
    rings = None
    while left:
        if size <= one_task:
            new = len(tables) == 1  # then the task also gives what is settled from the start
            last = pool.unionByName(open_).select(*columns)
            kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in last.schema)
            end = cut(last.withColumn("new", F.lit(new)).repartition(1).mapInArrow(_settle, kinds), **count)
            tables.append(end)
            done = [end.where("settled")] if new else [*done, end.where("settled")]
            if end.measured["open"]:
                rings = end.where("NOT settled")
            break
        q = pool.unionByName(open_).select(F.col("o").alias("q"), F.col("ptr").alias("qp"), F.col("rank").alias("qr"), "settled", F.col("before").alias("qb"))
        new = cut(open_.drop("settled").join(q, F.col("ptr") == F.col("q")).select("o", "before", F.col("qp").alias("ptr"), (F.col("rank") + F.col("qr")).alias("rank"), "settled", "q", "qb", "qr"), **count)
        tables.append(new)
        if new.measured["open"] == left:
            rings = open_
            break
        left, size = new.measured["open"], 2 * left
        ends = new.where("settled")
        done.append(ends)
        asked = ends.select(F.col("q").alias("o"), F.col("qb").alias("before"), "ptr", F.col("qr").alias("rank"), "settled")
        open_, pool = new.where("NOT settled").select(*columns), ends.select(*columns).unionByName(asked)
    if rings is not None:
        rings = cut(rings.select("o", "before"))
    out = reduce(DataFrame.unionByName, [d.select("o", "ptr", "rank") for d in done])
    if len(done) == 1:  # a part of the last table, which stays
        out.written = tables.pop().written
    else:
        out = cut(out)
    for t in tables:
        drop(t)
    return out, rings


def smallest_on_rings(rings: DataFrame, key: Column) -> DataFrame:
    """A table (o, low): the smallest key of each node's ring, from (o, before). Windows double until none finds
    anything smaller: then they agree all around."""
    state, count = cut(rings.select("o", F.col("before").alias("ptr"), key.alias("low"), F.lit(True).alias("fell"))), {"fell": F.count_if("fell")}
    while True:
        q = state.select(F.col("o").alias("q"), F.col("ptr").alias("qp"), F.col("low").alias("ql"))
        new = cut(state.join(q, F.col("ptr") == F.col("q")).select("o", F.col("qp").alias("ptr"), F.least("low", "ql").alias("low"), (F.col("ql") < F.col("low")).alias("fell")), **count)
        drop(state)
        state = new
        if not state.measured["fell"]:
            return state
