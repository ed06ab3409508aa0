"""What the training-data operators share: scratch tables in the shared folder, row groups
inside a task, vectorised word hashing over Arrow text, and connected components."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that a task hashes at once; arrays of 8 bytes a byte of text follow from it.
CHUNK_BYTES = 1 << 19


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Where
    that is unset (tests, a local session) a temporary folder is made and set."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    own = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def bounded_batches(spark: SparkSession, most: int = 2 << 20, rows: int = 512) -> None:
    """Rows with whole texts go to Python in batches of ``most`` bytes (or one row) instead of 10,000
    rows, and are read from Parquet ``rows`` at a time instead of 4,096, which may be any size: that
    bounds what a task holds on either side. Sets Spark's settings for the session, where they are
    larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    size = int(now[:-1] if unit else now) << unit
    if size <= 0 or size > most:
        spark.conf.set(key, str(most))
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key, "4096")) > rows:
        spark.conf.set(key, str(rows))


def own_prefix(columns: list[str]) -> str:
    """What names of internal columns begin with, so that none is among ``columns``."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


class Scratch:
    """Tables of one operator call, written under the shared folder. They cut the lineage: a lost
    executor costs the tasks that it ran, never the steps before a table. What is still there when
    the driver ends is removed then; ``drop`` removes a table of a loop that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        bounded_batches(spark)
        atexit.register(self._clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, **measures: Column) -> DataFrame:
        """``df`` as a table. ``measures`` are aggregates of its rows, taken as they are written and
        found in ``.measured`` of the result."""
        seen = Observation() if measures else None
        rows = df.observe(seen, *[c.alias(n) for n, c in measures.items()]) if seen is not None else df
        rows.write.mode("overwrite").parquet(self.path(name))
        out = self.spark.read.schema(df.schema).parquet(self.path(name))
        out.measured = seen.get if seen is not None else {}
        return out

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.root)
            except Exception as e:  # the session's JVM may be gone; the folder is the cluster's to clean then
                del e


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- rows of a task


def give_back() -> None:
    """Give what is free back to the operating system: a Python worker is used again by tasks of other
    steps, which otherwise come on top of the memory that this step held at its peak."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim is not None:
        trim(0)


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task whose caches and free memory go when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            _POWERS.clear()
            gc.collect()
            give_back()

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 16) -> Iterator[pa.Table]:
    """Cut a partition that is sorted by ``keys`` into tables of whole groups, about ``most`` rows
    each: a group is split over two tables never, many small groups share one."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            held.append(part)
            rows += part.num_rows
            if rows < most:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            new = group_starts(table, keys)
            last = int(new[-1])
            if last:
                yield table.slice(0, last)
                table = table.slice(last)
            held, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a new group begins in a table sorted by ``keys`` (without nulls)."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        col = table.column(k).to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.flatnonzero(new)


def vectors_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the usable vectors, their matrix in double precision). A vector takes no part when
    it is null, empty, zero, holds null or non-finite components, or differs in length from the
    table's most frequent length; callers filter on ``usable_vector`` first, so all agree."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.arange(n), flat.reshape(n, -1)


def usable_vector(col: str) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    c = F.col(col)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & fine & F.exists(c, lambda x: x != 0), F.lit(False))


# ---------------------------------------------------------------- words as 64-bit hashes

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        n += n >> 3
        up, down = np.full(n, _P, dtype=U64), np.full(n, _P_INV, dtype=U64)
        up[0] = down[0] = 1
        _POWERS["p"], _POWERS["q"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["p"], _POWERS["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without copying; null counts as empty."""
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8), offsets


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``most`` bytes; a
    longer text is a run of its own. Whole texts always."""
    data, offsets = text_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: (first byte, byte after the last, text)."""
    word = ~_WS[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:-1]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, A-Z taken as a-z. Equal spans have equal hashes; different
    ones differ but for a chance of 2**-64."""
    up, down = _powers(len(data) + 1)
    values = _BYTE[data]
    values *= up[: len(data)]
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(values, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, the text it is in, hash of its last two bytes)."""
    starts, ends, doc = word_spans(data, offsets)
    tail = _BYTE[data[ends - 1]]
    before = ends - starts > 1
    tail[before] += _BYTE[data[ends[before] - 2]] * _P
    return span_hashes(data, starts, ends), doc, mix(tail)


# ---------------------------------------------------------------- connected components


def connected_components(scratch: Scratch, edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach, for each node of an edge.

    Alternates a step in which every node hears of the smallest neighbour (large star: neighbours
    greater than the node move to the smallest one) and one in which it keeps the smallest (small
    star), until nothing changes: about log(nodes) rounds. Each round is two aggregations over the
    edges, cut by a table; a hot node only has one row for each of its edges, and a minimum for
    them, so nothing is gathered into a list."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    state = {"n": F.count(F.lit(1)), "h": F.bit_xor(F.xxhash64("a", "b"))}  # equal for equal tables
    e = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0", **state)
    done = not e.measured["n"]
    for i in range(1, most + 1):
        if done:
            break
        # large star: every greater neighbour of u goes to the smallest of u and its neighbours
        around = both(e)
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        new = scratch.table(small, f"{name}-{i}", **state)
        done = new.measured == e.measured
        scratch.drop(f"{name}-{i - 1}")
        e = new
    if not done:
        raise RuntimeError(f"components did not settle in {most} rounds")
    # stars remain: each node is joined to its smallest
    low = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    roots = e.select(F.col("a").alias("node")).distinct().join(low.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return scratch.table(low.unionByName(roots), f"{name}-end")


def smallest_ids(df: DataFrame, key: list[str], id_col: str, k: int) -> DataFrame:
    """The ``k`` smallest ids of each key as rows; ranks are cut in each partition before the
    shuffle, so a hot key moves ``k`` rows a partition at most."""
    w = Window.partitionBy(*key).orderBy(F.col(id_col))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
