"""Approximate nearest neighbours along shifted space-filling curves.

Every vector is projected to a few dimensions by several random rotations, each shifted, and gets
its place on a Hilbert curve through each projection. Each curve is range-partitioned into cells of
equal numbers of vectors; a query looks through its own cell and ``reach`` neighbouring cells on
either side, and the windows of all curves merge and are ranked by the true distance.

Vectors are centred on their mean first. Where a group of near copies shares one place on a curve,
its rows are dealt by hash over all cells that the place fills, so cells stay about equal; a window
that touches such a group looks through all of its cells.

A cell is a bounded group of rows, queries are copied to the cells of their windows, and only the
nearest of each cell go on. Equal vectors are one entry of the index with its smallest ids (as many
as a result can show), so a vector that a third of all rows share is one row.

How much a query looks through is 2 * reach of the rows a curve, more where near copies are. Vectors without
structure (the nearest neighbours almost as far as any other) need wide windows for a recall of
0.9; the defaults are for such vectors. Clustered vectors do with a small ``reach``.

Edge cases: vectors that are null, zero, hold null or non-finite components, have a null id or
another length than most take no part, neither as queries nor as candidates; fewer candidates than
``k`` give fewer rows; ties go to the smaller id; an empty table gives no rows; rows that repeat an
id are candidates each, under the same id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import U64, Scratch, group_starts, mix, shuffle_partitions, smallest_ids, usable_vector, whole_groups


def usable_rows(df: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and their length: the most frequent one (the smaller
    of two as frequent)."""
    rows = df.where(F.col(id_col).isNotNull() & usable_vector(vector)).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if most is None:
        return rows, 0
    return rows.where(F.size("v") == most.d), most.d


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer coordinates [row, dimension], by the transposition of
    Skilling (2004); bits * dimensions is 63 at most."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


class Curves:
    """The projections: ``curves`` random rotations to ``dims`` dimensions with random shifts."""

    def __init__(self, dim: int, mean: np.ndarray, spread: float, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean = mean
        self.bits, dims = bits, min(dims, dim)
        self.axes = [np.linalg.qr(rng.normal(size=(dim, dims)))[0] for _ in range(curves)]
        self.shifts = rng.random((curves, dims))
        self.scale = (1 << bits) / (8.0 * max(spread, 1e-300))

    def keys(self, v: np.ndarray) -> np.ndarray:
        """Places on each curve, [row, curve]."""
        v = v - self.mean
        out = np.empty((len(v), len(self.axes)), dtype=np.int64)
        for i, (axes, shift) in enumerate(zip(self.axes, self.shifts, strict=True)):
            at = np.floor(v @ axes * self.scale + shift + (1 << (self.bits - 1)))
            out[:, i] = hilbert_index(np.clip(at, 0, (1 << self.bits) - 1), self.bits)
        return out


def cells_of(cuts: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, first, last): the cell of each row on a curve, and the cells that its key fills. A key
    that is several cuts fills all cells between them, and ``ties`` (hashes of the rows) deal its
    rows over these evenly."""
    first, last = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
    last = np.where(last - first > 1, last, first)
    return first + (ties % (last - first + 1).astype(U64)).astype(np.int64), first, last


def windows_of(cuts: np.ndarray, first: np.ndarray, last: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): the cells that rows look through whose keys fill ``first`` to ``last``: ``side``
    more on either side, and all cells of a key that fills the outermost ones."""
    low, high = np.maximum(first - side, 0), np.minimum(last + side, len(cuts))
    if len(cuts):
        begin, end = np.searchsorted(cuts, cuts, "left"), np.searchsorted(cuts, cuts, "right")
        hot = end - begin > 1
        below, above = np.maximum(low - 1, 0), np.minimum(high, len(cuts) - 1)
        low = np.where((low > 0) & hot[below], begin[below], low)
        high = np.where((high < len(cuts)) & hot[above], end[above], high)
    return low, high


def nearest(vectors: DataFrame, scratch: Scratch, queries: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", curves: int = 8, dims: int = 12, bits: int = 5, cells: int = 64, rows_per_cell: int = 1 << 16, reach: float = 0.1, seed: int = 7) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest that the windows hold, by Euclidean distance.
    ``queries`` tells the query rows by the columns of ``vectors``; ``reach`` is the part of a curve
    on either side of a query's cell that is looked through. Cells are ``cells`` at least, and as
    many as it takes to hold about ``rows_per_cell`` vectors each."""
    spark = scratch.spark
    marked = vectors.select(F.col(id_col), F.col(vector), F.coalesce(queries, F.lit(False)).alias("_q"))
    rows, dim = usable_rows(marked, id_col, vector)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    asked = marked.where(F.col("_q") & F.col(id_col).isNotNull() & usable_vector(vector)).select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where(F.size("v") == dim)
    # Equal vectors once, with the ids that a result can show.
    ids = smallest_ids(rows.select("v", "id"), ["v"], "id", k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    index = ids.withColumn("rep", F.element_at("ids", 1))
    entry = [F.col("v")[i].cast("double") for i in range(dim)]
    moments = index.agg(*[f(e) for f in (F.avg, F.var_pop) for e in entry]).first()  # sums about running means: offsets do no harm
    mean, spread = np.array(moments[:dim], dtype=np.float64), float(np.sqrt(np.mean(moments[dim:])))
    shape = Curves(dim, mean, spread, curves, dims, bits, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = shape.keys(matrix(b.column(b.schema.get_field_index("v")), dim))
            at = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * curves, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, at], names=[*b.schema.names, "at"])

    placed = index.mapInArrow(place, T.StructType([*index.schema.fields, T.StructField("at", T.ArrayType(T.LongType()))]))
    placed = scratch.table(placed, "placed")
    n = placed.count()
    cells = min(max(cells, -(-n // rows_per_cell)), max(n, 1))
    side = int(np.ceil(reach * cells))
    marks = [i / cells for i in range(1, cells)]
    cuts = placed.agg(*[F.percentile_approx(placed.at[c], marks, 20 * cells).alias(f"c{c}") for c in range(curves)]).first() if marks else None
    cuts = np.array([cuts[c] for c in range(curves)], dtype=np.int64).reshape(curves, -1) if marks else np.zeros((curves, 0), np.int64)
    held = spark.sparkContext.broadcast(cuts)

    def deal(query: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column(b.schema.get_field_index("at"))
                keys = at.flatten().to_numpy().reshape(-1, curves)
                own = b.select(["rep", "v"])
                reps = own.column(0).to_numpy().astype(np.int64).view(U64)
                for c in range(curves):
                    cell, first, last = cells_of(held.value[c], keys[:, c], mix(reps + U64((c + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
                    low, high = windows_of(held.value[c], first, last, side) if query else (cell, cell)
                    for step in range(int((high - low).max(initial=-1)) + 1):
                        to = low + step
                        fits = np.flatnonzero(to <= high)
                        part = own.take(pa.array(fits))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fits), c, np.int32)), pa.array(to[fits].astype(np.int32)), pa.array(np.full(len(fits), query)), *part.columns], names=["curve", "cell", "query", "rep", "v"])

        return task

    dealt_schema = f"curve int, cell int, query boolean, rep long, v {placed.schema['v'].dataType.simpleString()}"
    q_ids = placed.join(asked.select("v").distinct(), "v", "left_semi")
    dealt = placed.mapInArrow(deal(False), dealt_schema).unionByName(q_ids.mapInArrow(deal(True), dealt_schema))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["curve", "cell"], 1 << 14):
            starts = [*group_starts(table, ["curve", "cell"]).tolist(), table.num_rows]
            is_query, reps = table.column("query").to_numpy(), table.column("rep").to_numpy()
            v = matrix(table.column("v"), dim)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                m = b - int(is_query[a:b].sum())  # queries sort behind candidates
                if m == b or m == a:
                    continue
                for q in range(m, b, 256):
                    got = best(v[q : min(q + 256, b)], reps[q : min(q + 256, b)], v[a:m], reps[a:m], k + 1, shape.mean)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query", "rep", "score"])

    part = F.pmod(F.xxhash64("curve", "cell"), F.lit(1 << 30))
    near = dealt.repartition(shuffle_partitions(spark), part).sortWithinPartitions("curve", "cell", "query").mapInArrow(look, "query long, rep long, score double")
    near = near.groupBy("query", "rep").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query").orderBy("score", "rep")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    # From entries of the index back to ids.
    members = placed.select("rep", "ids")
    out = near.join(members, "rep").select("query", "score", F.explode("ids").alias("id"))
    own = asked.select(F.col("id").alias("query_id"), "v").join(placed.select("v", F.col("rep").alias("query")), "v").select("query_id", "query")
    out = own.join(out, "query").where("id <> query_id")
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def best(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, centre: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of ``v`` to each of ``q``, ties to the smaller id, with exact distances.

    Rough squares of distances come from a matrix product of vectors minus ``centre``. Rounding moves them by
    less than ``slack``, so whatever is within twice that of the k-th rough value is compared exactly."""
    near, far = v - centre, q - centre
    size, own = np.einsum("ij,ij->i", near, near), np.sqrt(np.einsum("ij,ij->i", far, far))
    rough = size[None, :] - 2.0 * (far @ near.T)
    k = min(k, len(v))
    kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
    slack = 4 * (v.shape[1] + 8) * np.finfo(np.float64).eps * (own + np.sqrt(size.max())) ** 2
    close = ~(rough > (kth + 2 * slack)[:, None])  # what is no number is close too
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(q), 16):
        row, col = np.nonzero(close[at : at + 16])
        row += at
        exact = np.empty(len(row))
        for i in range(0, len(row), 1 << 14):
            r, c = row[i : i + (1 << 14)], col[i : i + (1 << 14)]
            exact[i : i + (1 << 14)] = np.sqrt(((v[c] - q[r]) ** 2).sum(axis=1))
        order = np.lexsort((ids[col], exact, row))
        place = np.arange(len(order)) - np.searchsorted(row, row)  # np.nonzero goes row by row
        order = order[place < k]
        out.append((q_ids[row[order]], ids[col[order]], exact[order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# ---------------------------------------------------------------- query


def op1_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = nearest(vectors, Scratch(spark, "ann"), F.col("vec_id") % 100 == 0)
    return out.withColumnRenamed("id", "vec_id")


QUERIES = {"op1_hilbert_ann": op1_hilbert_ann}
ORACLE_SQL: dict[str, str] = {}
