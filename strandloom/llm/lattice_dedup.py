"""Near-duplicate embeddings by lattice hashing.

In each of several tables a vector is projected at random to blocks of eight dimensions, each block
is decoded to the nearest point of the E8 lattice, and the points of all blocks are its cell. A
vector also probes the neighbouring cells that it lies closest to (the lattice's shortest vectors
added to one block). Two vectors meet where the cell of one is a cell or a probe of the other; the
cosine of those that meet is computed and compared.

Equal vectors are one entry with its number of rows. A cell with many entries is cut into squares
of about ``square`` entries a side, which are tasks' work one by one; pairs are counted inside the
squares and never become rows: a square tells how many links each entry has and which entries form
its components. A pair that meets in several cells counts in the first of them alone.

Edge cases: vectors that are null, zero, hold null or non-finite components, or have another length
than most (the smaller of two as frequent), and rows with a null id, link with nothing: 0 links, a
component of their own id, kept (null for a null id). Ids are expected to be unique; rows repeating
one are compared as vectors of their own. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import U64, Scratch, connected_components, group_starts, mix, shuffle_partitions, whole_groups
from strandloom.llm.hilbert_ann import matrix, usable_rows


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus
    signs."""
    pairs = [[(a if i == x else b if i == y else 0) for i in range(8)] for x in range(8) for y in range(x) for a in (-1, 1) for b in (-1, 1)]
    halves = [[0.5 - (s >> i & 1) for i in range(8)] for s in range(256) if bin(s).count("1") % 2 == 0]
    return np.array(pairs + halves, dtype=np.float64)


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer one of D8 (integers with an even sum) and D8
    moved by one half."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
        off = (y - near)[odd]
        worst = np.abs(off).argmax(axis=1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return near

    whole, half = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


class Lattice:
    """The tables: projections, and the cells and probes of vectors as 64-bit keys."""

    def __init__(self, dim: int, tables: int, blocks: int, probes: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.dim, self.tables, self.blocks, self.probes = dim, tables, blocks, probes
        self.maps = rng.normal(size=(tables, dim, 8 * blocks)) / width
        self.offsets = rng.random((tables, 8 * blocks))
        self.odd = rng.integers(1, 1 << 63, (tables, 8 * blocks), dtype=np.int64).astype(U64) | U64(1)
        self.moves = shortest_vectors()

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """[row, table, 1 + probes] for rows of length one: the cell, then the probes."""
        n = len(unit)
        out = np.empty((n, self.tables, 1 + self.probes), dtype=np.int64)
        for t in range(self.tables):
            x = unit @ self.maps[t] + self.offsets[t]
            points = np.concatenate([decode_e8(x[:, 8 * b : 8 * b + 8]) for b in range(self.blocks)], axis=1)
            left = x - points
            odd = self.odd[t]
            with np.errstate(over="ignore"):
                cell = ((2 * points).astype(np.int64).astype(U64) * odd).sum(axis=1, dtype=U64)
                gains = np.concatenate([left[:, 8 * b : 8 * b + 8] @ self.moves.T for b in range(self.blocks)], axis=1)
                shifts = np.concatenate([((2 * self.moves).astype(np.int64).astype(U64) * odd[8 * b : 8 * b + 8]).sum(axis=1, dtype=U64) for b in range(self.blocks)])
                out[:, t, 0] = mix(cell + U64(t)).view(np.int64)
                if self.probes:
                    top = np.argpartition(-gains, self.probes - 1, axis=1)[:, : self.probes]
                    out[:, t, 1:] = mix(cell[:, None] + shifts[top] + U64(t)).view(np.int64)
        return out


def meeting_chance(threshold: float, blocks: int, probes: int, width: float, pairs: int = 1 << 14) -> float:
    """Chance that two vectors with a cosine of ``threshold`` meet in one table, over many tables: by
    simulation with a fixed seed. The projections are normal, so the vectors' length plays no part."""
    rng = np.random.default_rng(5)
    a, z = rng.normal(size=(2, pairs, 8 * blocks))
    b = threshold * a + np.sqrt(max(1.0 - threshold * threshold, 0.0)) * z
    one = Lattice(8 * blocks, 1, blocks, probes, width, 5)
    one.maps[0] = np.eye(8 * blocks) / width
    one.offsets[0] = 0.0
    moved = rng.random((pairs, 8 * blocks)) * width
    x, y = one.keys(a + moved)[:, 0], one.keys(b + moved)[:, 0]
    return float(((x[:, :1] == y).any(axis=1) | (y[:, :1] == x).any(axis=1)).mean())


def tables_for(tables: int, threshold: float, blocks: int, probes: int, width: float) -> int:
    """Tables that find as large a part of the pairs at ``threshold`` with ``blocks`` blocks as
    ``tables`` do with two."""
    if blocks <= 2:
        return tables
    two, now = (meeting_chance(threshold, b, probes, width) for b in (2, blocks))
    if now == 0.0:
        raise ValueError(f"pairs at {threshold} do not meet in cells of {blocks} blocks; give fewer blocks or a larger width")
    two, now = min(two, 0.9999), min(now, 0.9999)
    return max(tables, int(np.ceil(tables * np.log1p(-two) / np.log1p(-now))))


def _pairs_first_met(a: np.ndarray, b: np.ndarray, table: int, key: int) -> np.ndarray:
    """For pairs with keys [pair, table, 1 + probes]: whether (table, key) is the first place where
    they meet."""
    first = (a[:, table, 0] == key) | (b[:, table, 0] == key)
    for t in range(table + 1):
        in_b = (a[:, t, :1] == b[:, t]).any(axis=1)
        in_a = (b[:, t, :1] == a[:, t]).any(axis=1)
        if t < table:
            first &= ~(in_b | in_a)
        else:
            first &= ~(in_b & (a[:, t, 0] < key)) & ~(in_a & (b[:, t, 0] < key))
    return first


def _components(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of ``n`` entries' components under the links (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", tables: int = 8, blocks: int | None = None, probes: int = 8, width: float = 1.5, square: int = 512, seed: int = 11) -> DataFrame:
    """(id, n_links, component, kept) of every row. ``width`` is the size of a lattice cell in
    standard deviations of a projected vector. At 1.5, vectors with a cosine of 0.95 share a block's
    cell about every other time, and unrelated ones once in about 2**10; ``blocks`` is therefore a
    tenth of the bits that number the entries unless given, so an entry meets about one unrelated
    entry a table at any size. ``tables`` are those for two blocks; with more blocks, near vectors
    meet less often in a table, and there are as many more tables as keep the part of the pairs at
    ``threshold`` that is found."""
    spark = scratch.spark
    rows, dim = usable_rows(vectors, id_col, vector)
    alone = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    if not dim:
        return alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    entries = rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    if blocks is None:
        blocks = max(2, int(np.ceil(np.log2(max(entries.count(), 2)) / 10)))
    tables = tables_for(tables, threshold, blocks, probes, width)
    lattice = Lattice(dim, tables, blocks, probes, width, seed)
    per = tables * (1 + probes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(b.schema.get_field_index("v")), dim)
            keys = lattice.keys(x / np.sqrt((x * x).sum(axis=1))[:, None]).reshape(-1)
            at = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * per, pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([*b.columns, at], names=[*b.schema.names, "keys"])

    placed = scratch.table(entries.mapInArrow(place, T.StructType([*entries.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])), "placed")
    # Cells where entries can meet: two at least, and one of them at home.
    spots = placed.select("rep", F.posexplode("keys").alias("at", "key"))
    spots = spots.select("rep", F.floor(F.col("at") / (1 + probes)).cast("int").alias("tab"), "key", (F.col("at") % (1 + probes) == 0).alias("home"))
    full = spots.groupBy("tab", "key").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 AND any_home").select("tab", "key", F.ceil(F.col("n") / square).cast("int").alias("nb"))
    met = spots.select("rep", "tab", "key").distinct().join(full, ["tab", "key"])
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    met = met.select("rep", "tab", "key", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    met = met.select("rep", "tab", "key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own")
    work = met.join(placed, "rep").select("tab", "key", "bi", "bj", "own", "rep", "weight", "v", "keys")
    names = ["tab", "key", "bi", "bj"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, names, 1 << 12):
            starts = [*group_starts(table, names).tolist(), table.num_rows]
            tab, key, bi, bj, own, rep, weight = (table.column(c).to_numpy() for c in (*names, "own", "rep", "weight"))
            x = matrix(table.column("v"), dim)
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            keys = table.column("keys").combine_chunks()
            keys = (keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys).flatten().to_numpy().reshape(-1, tables, 1 + probes)
            ids, links, roots = [], [], []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a < 2:
                    continue
                close = x[a:b] @ x[a:b].T >= threshold
                if bi[a] == bj[a]:
                    i, j = np.nonzero(np.triu(close, 1))
                else:
                    i, j = np.nonzero(close & (own[a:b, None] == bi[a]) & (own[None, a:b] == bj[a]))
                if not len(i):
                    continue
                first = np.concatenate([_pairs_first_met(keys[a + i[s : s + 65536]], keys[a + j[s : s + 65536]], int(tab[a]), int(key[a])) for s in range(0, len(i), 65536)])
                i, j = i[first], j[first]
                if not len(i):
                    continue
                n = np.bincount(i, weight[a + j], b - a) + np.bincount(j, weight[a + i], b - a)
                root = _components(i, j, b - a)
                hit = np.flatnonzero(n)
                ids.append(rep[a + hit])
                links.append(n[hit].astype(np.int64))
                roots.append(rep[a + root[hit]])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, links, roots)], names=["rep", "n", "root"])

    part = F.pmod(F.xxhash64(*names), F.lit(1 << 30))
    found = scratch.table(work.repartition(shuffle_partitions(spark), part).sortWithinPartitions(*names).mapInArrow(look, "rep long, n long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(scratch, found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "parts")
    per_entry = placed.select("v", "rep", "weight").join(links, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = alone.join(per_entry.select(F.col("v").alias("_v"), F.col("rep"), "weight", "n", F.col("component").alias("c")), (F.col("v") == F.col("_v")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("c", "rep", "id")
    return out.select("id", F.coalesce(F.coalesce("n", F.lit(0)) + F.col("weight") - 1, F.lit(0)).alias("n_links"), component.alias("component"), (F.col("id") == component).alias("kept"))


# ---------------------------------------------------------------- query


def op4_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "lattice"))
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), "kept")


QUERIES = {"op4_lattice_dedup": op4_lattice_dedup}
ORACLE_SQL = {
    "op4_lattice_dedup": """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.x = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c"""
}
