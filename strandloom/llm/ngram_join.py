"""Exact Jaccard self-join of documents on word n-grams, in the metric space of their sets.

The pivots of the first level are single shingles: the cell of a shingle holds the sets that it lies
in. Sets are ordered towards their pivots by how rare a shingle is (a sketch of counts over all
documents, then its hash), and a set goes to the cells of its first n - ceil(t*n) + 1 pivots: a set
within the threshold misses n - ceil(t*n) of its shingles at most, so it meets the set in one of
these cells. That window is what the triangle inequality leaves of the boundary; every linked pair
shares a cell, no pair is lost. Common passages come last in the order and make no large cells.

Two sets are only compared in a cell if what is left of both, from there on in the order, can hold
the overlap that they need; where they first meet, that is so for every linked pair. And only if
their signatures allow it: parities of the numbers of shingles in hash buckets, whose Hamming
distance is a lower bound of the symmetric difference. Both are conditions of the join of a cell,
so a pair that fails them never becomes a row.

Cells are then joined recursively. Each cell takes one of its sets as pivot, and the distance of all
its sets to the pivot is computed: those within the threshold link to it. The others make the next
cell; they can only link to a set of the pivot's component whose distance to the pivot differs by
the threshold at most (triangle inequality), and only need to if they are in another component yet.
Signatures bound the distance from below where it is too large to be worth measuring.
Small cells are compared pair by pair at once. So a cell of thousands of near copies costs a row
for each of its sets, not for each pair.

Equal sets are one class from the start; classes, cells, pairs and links all stay in Spark. Shingles
are 64-bit hashes, and classes 64-bit hashes of sets.

Edge cases: a null or empty text (or one of white space) has an empty set and links with nothing; a
text of fewer words than a shingle is one shingle, its whole sequence; a null id is a row with a
null component that links with nothing; repeated rows and ids are in one class or apart by their
texts; an empty table gives no rows; a very long text is hashed whole, by itself, in about 50 bytes of memory
for each of its own; columns besides id and text are not read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import U64, Scratch, connected_components, mix, released, shuffle_partitions, text_chunks, word_hashes

_Q = U64(0xD6E8FEB86659FD93)
_SKETCH_BITS, _CHUNKS = 22, 64
WORDS = 16  # of a signature
LARGE = 32 * WORDS  # shingles from which a set has a long signature too
PAIRS_A_PLACE = 64


def shingle_runs(column: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, row after the last, sorted distinct shingles of each text as 64-bit hashes) of runs
    of texts."""
    powers = [U64(pow(int(_Q), j, 1 << 64)) for j in range(size)]
    for lo, hi, data, offsets in text_chunks(column):
        words, doc, _ = word_hashes(data, offsets)
        counts = np.bincount(doc, minlength=hi - lo)
        begins = np.concatenate([[0], np.cumsum(counts)])
        n = max(len(words) - size + 1, 0)
        total = np.zeros(n, dtype=U64)
        for j in range(size):
            total += words[j : j + n] * powers[j]
        total = mix(total)
        out = []
        for a, k in zip(begins.tolist(), counts.tolist(), strict=False):
            if k >= size:
                x = np.sort(total[a : a + k - size + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif k:
                short = (words[a : a + k] * np.array(powers[:k], dtype=U64)).sum(dtype=U64) + U64(k)
                out.append(mix(np.array([short], dtype=U64)))
            else:
                out.append(np.zeros(0, dtype=U64))
        yield lo, hi, out


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct shingles) of each text."""
    for lo, _, sets in shingle_runs(column, size):
        yield from enumerate(sets, lo)


def set_key(shingles: np.ndarray) -> int:
    """One 64-bit key for a set."""
    total = mix(shingles ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64) + U64(len(shingles))
    return int(mix(np.array([total], dtype=U64)).view(np.int64)[0])


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in hash buckets, as 64-bit words. Two sets differ in as many
    shingles at least as their signatures in bits."""
    odd = np.bincount((shingles & U64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def long_signature(shingles: np.ndarray) -> bytes:
    """The same with two buckets a shingle at least, for sets that are large for the short one."""
    bits = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def long_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference; the longer signature is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def least_difference(a: Column, b: Column) -> Column:
    """A lower bound of the symmetric difference, from two signatures; in generated code."""
    return reduce(add, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WORDS)])


class Seen:
    """Keys that a task has met, sorted; no more are taken in beyond ``most``. What is met again only
    costs work, so forgetting is harmless."""

    def __init__(self, most: int = 1 << 18):
        self.most, self.keys = most, np.zeros(0, np.int64)

    def first(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys are met for the first time."""
        distinct, at = np.unique(keys, return_index=True)
        new = np.ones(len(distinct), dtype=bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            new = self.keys[place] != distinct
        if len(self.keys) < self.most:
            self.keys = np.union1d(self.keys, distinct[new])
        out = np.zeros(len(keys), dtype=bool)
        out[at[new]] = True
        return out


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _describe(documents: DataFrame, size: int) -> DataFrame:
    """Rows of kind 0: (id, n, g, signature) of each document; of kind 1: (chunk, counts) of the sketch,
    packed counts of shingles by bucket that a task has seen, equal sets once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "n", "g", "signature", "counts"]
        counts, seen = np.zeros(1 << _SKETCH_BITS, dtype=np.uint16), Seen()
        for batch in batches:
            for lo, hi, sets in shingle_runs(batch.column(1), size):
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                g = np.fromiter(map(set_key, sets), np.int64, len(sets))
                new = np.flatnonzero(seen.first(g))
                if len(new):
                    at, more = np.unique((np.concatenate([sets[i] for i in new]) >> U64(64 - _SKETCH_BITS)).astype(np.int64), return_counts=True)
                    counts[at] = np.minimum(counts[at] + more, 65535)
                marks = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * WORDS, pa.int32()), pa.array(np.concatenate([signature(x) for x in sets])))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int64)), batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(n), pa.array(g), marks, pa.nulls(len(n), pa.binary())], names=names)
        if counts.any():
            packer, none = zstandard.ZstdCompressor(level=1), np.zeros(_CHUNKS, np.int64)
            packed = [packer.compress(c.tobytes()) for c in counts.reshape(_CHUNKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(none + 1), pa.array(np.arange(_CHUNKS)), pa.array(none), pa.array(none), pa.nulls(_CHUNKS, pa.list_(pa.int64())), pa.array(packed, pa.binary())], names=names)

    return documents.mapInArrow(released(task), "kind long, id long, n long, g long, signature array<long>, counts binary")


def sketch_of(told: DataFrame) -> np.ndarray:
    """How often shingles of each bucket are, over all documents; 0 where that may be chance. The
    sketch is summed in Spark, chunk by chunk; what comes to the driver is the frequent buckets, no
    more than the sketch has. It only decides the order of pivots, so it costs work, never a pair."""
    width = (1 << _SKETCH_BITS) // _CHUNKS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(unpacker.decompress(packed), np.uint16)
                total[chunk] = total[chunk] + own if chunk in total else own.astype(np.int64)
        for chunk, counts in total.items():
            usual = np.median(counts)
            often = np.flatnonzero(counts > usual + 4 * np.sqrt(usual) + 2)
            yield _batch(["bucket", "n"], chunk * width + often, counts[often])

    sums = told.where("kind = 1").select(F.col("id").alias("chunk"), "counts").repartition(min(_CHUNKS, shuffle_partitions(told.sparkSession)), "chunk")
    sketch = np.zeros(1 << _SKETCH_BITS, dtype=np.uint16)
    for x in sums.mapInArrow(released(task), "bucket long, n long").toLocalIterator():
        sketch[x.bucket] = min(x.n, 65535)
    return sketch


def needed(n, percent: int):
    """The least overlap that a set of ``n`` has with a set that it links to."""
    return (percent * n + 99) // 100


def _cells(documents: DataFrame, size: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(x, g, n): the sets of each cell x, a set as often as it has windows; equal sets once a task.
    n holds the set's size and, in the low 32 bits, how many of its shingles come before x."""
    held = documents.sparkSession.sparkContext.broadcast(sketch)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = held.value, Seen()
        x, g, n, rows = [], [], [], 0
        for batch in batches:
            for _, _, sets in shingle_runs(batch.column(0), size):
                sets = [s for s in sets if len(s)]
                keys = np.fromiter(map(set_key, sets), np.int64, len(sets))
                for i in np.flatnonzero(seen.first(keys)):
                    s = sets[i]
                    most = len(s) - needed(len(s), percent) + 1
                    weight = sketch[(s >> U64(64 - _SKETCH_BITS)).astype(np.int64)]
                    first = s[:most] if not weight.any() else s[np.lexsort((s, weight))[:most]]
                    x.append(first)
                    g.append(np.full(most, keys[i]))
                    n.append((len(s) << 32) + np.arange(most))
                    rows += most
                if rows > 1 << 16:
                    yield _batch(["x", "g", "n"], np.concatenate(x).view(np.int64), np.concatenate(g), np.concatenate(n))
                    x, g, n, rows = [], [], [], 0
        if rows:
            yield _batch(["x", "g", "n"], np.concatenate(x).view(np.int64), np.concatenate(g), np.concatenate(n))

    return documents.mapInArrow(released(task), "x long, g long, n long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (x, g, n) sorted by x and g: each once, where x has several g. A row is held back
    until the next is known, so a cell of any size passes through."""
    last: tuple[np.ndarray, ...] | None = None  # the last row, whether it is let through already
    for batch in batches:
        x, g, n = (c.to_numpy() for c in batch.columns)
        through = np.zeros(len(x), dtype=bool)
        if last is not None:
            x, g, n = (np.concatenate([a, b]) for a, b in zip(last[:3], (x, g, n), strict=True))
            through = np.concatenate([last[3], through])
        if not len(x):
            continue
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (g[1:] != g[:-1])
        x, g, n, through = x[new], g[new], n[new], through[new]
        same = x[1:] == x[:-1]
        several = np.zeros(len(x), dtype=bool)
        several[1:] |= same
        several[:-1] |= same
        out = several & ~through
        if out.any():
            yield _batch(["x", "g", "n"], x[out], g[out], n[out])
        last = (x[-1:], g[-1:], n[-1:], several[-1:] | through[-1:])


def _sets(documents: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(g, n, s, mark): the sets, as bytes, of the classes (id, g), taken from the document with that
    id, and the long signatures of large ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            rows, held = [], 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["g", "n", "s", "mark"])  # noqa: B023

            for i, x in shingle_sets(batch.column(0), size):
                if set_key(x) == wanted[i]:
                    rows.append((wanted[i], len(x), x.tobytes(), long_signature(x) if len(x) > LARGE else None))
                    held += x.nbytes
                if held > 8 << 20:
                    yield flush()
                    rows, held = [], 0
            if rows:
                yield flush()

    return documents.join(classes.withColumnRenamed("id", "_id"), F.col("_id") == F.col("id")).select("text", "g").mapInArrow(released(task), "g long, n long, s binary, mark binary")


def _near_enough(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their long signatures leave possible; all pairs with a small set."""
    own = lambda c: sets.select(F.col("g").alias(c), F.col("n").alias(f"n{c}"), F.col("mark").alias(f"m{c}"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ma, mb = (c.to_pylist() for c in batch.columns)
            fits = [x is None or y is None or (100 + percent) * long_difference(x, y) <= (100 - percent) * (i + j) for i, j, x, y in zip(na, nb, ma, mb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(task, "a long, b long")


def _plausible(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """(a, b, ok, low) of the pairs (a, b, na, nb): whether their signatures leave it possible that
    they link, and a lower bound of their distance."""
    own = lambda c: signatures.select(F.col("g").alias(c), F.col("signature").alias(f"s{c}"))
    differ, both = least_difference(F.col("sa"), F.col("sb")), F.col("na") + F.col("nb")
    rows = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", both.alias("both"), differ.alias("differ"))
    return rows.select("a", "b", can_link(F.col("differ"), F.col("both"), percent).alias("ok"), (2 * F.col("differ") / (F.col("both") + F.col("differ"))).alias("low"))


def can_link(differ: Column, both: Column, percent: int) -> Column:
    """J >= t means a symmetric difference of (1 - t) / (1 + t) of both sizes at most."""
    return (100 + percent) * differ <= (100 - percent) * both


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, k, u): the sizes of intersection and union of the pairs (a, b). Each pair brings the
    set of b to where the set of a is; a set with many pairs is at several places."""
    places = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_PLACE).alias("m"))
    pairs = pairs.join(places, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("m")).alias("place"))
    sets = sets.select("g", "s")
    sent = pairs.join(sets, F.col("b") == F.col("g")).select("a", "b", "place", "s")
    own = places.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("place")).join(sets, F.col("a") == F.col("g")).select("a", F.lit(None).cast("long").alias("b"), "place", "s")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, np.zeros(0, U64)
        for batch in batches:
            out = []
            sets_ = batch.column(3)
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                s = np.frombuffer(sets_[i].as_buffer(), dtype=U64)
                if b is None:
                    at, mine = a, s.copy()
                    continue
                assert at == a
                both = np.concatenate([mine, s])
                both.sort(kind="stable")
                k = int((both[1:] == both[:-1]).sum())
                out.append((a, b, k, len(mine) + len(s) - k))
            if out:
                yield _batch(["a", "b", "k", "u"], *map(list, zip(*out, strict=True)))

    rows = sent.unionByName(own).repartition(shuffle_partitions(pairs.sparkSession), "a", "place")
    return rows.sortWithinPartitions("a", "place", F.asc_nulls_first("b")).mapInArrow(released(task), "a long, b long, k long, u long")


def similar_documents(documents: DataFrame, scratch: Scratch, size: int = 5, percent: int = 75, id_col: str = "doc_id", text: str = "text", small: int = 48, rounds: int = 4, few: int = 500_000) -> DataFrame:
    """(id, n_shingles, component) of every row: documents link when 100 * intersection is
    ``percent`` * union at least; a component is named by its smallest id."""
    spark = scratch.spark
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    told = scratch.table(_describe(docs, size), "documents")
    rows = told.where("kind = 0").select("id", "n", "g")
    sketch = sketch_of(told)
    cells = _cells(docs.where("id IS NOT NULL").select("text"), size, percent, sketch)
    cells = cells.repartition(shuffle_partitions(spark), "x").sortWithinPartitions("x", "g").mapInArrow(_shared, "x long, g long, n long")
    cells = cells.select("x", "g", F.shiftright("n", 32).alias("n"), F.col("n").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"))
    cells = scratch.table(cells, "cells")
    classes = scratch.table(rows.where("n > 0 AND id IS NOT NULL").groupBy("g").agg(F.min("id").alias("id")), "classes")
    signatures = told.where("kind = 0 AND n > 0").join(classes.withColumnRenamed("id", "_id"), ["g"]).where("id = _id").dropDuplicates(["g"]).select("g", "signature")
    signatures = scratch.table(signatures.join(cells.select("g").distinct(), "g", "left_semi"), "signatures")

    # Cells with the same sets are one cell: the one that comes first in the order of pivots.
    mark = cells.groupBy("x").agg(F.count("*").alias("m"), F.sum(F.xxhash64("g").cast("decimal(38,0)")).alias("h"), F.sum("pos").alias("p"))
    kept = mark.groupBy("m", "h").agg(F.min_by("x", F.struct("p", "x")).alias("x")).select("x", "m")
    open_ = scratch.table(cells.join(kept, "x").select("x", "g", "n", "pos", "m"), "open-0")

    ready = spark.createDataFrame([], "a long, b long, k long, u long")  # all pairs whose overlap is known
    links = spark.createDataFrame([], "a long, b long")
    bounds = spark.createDataFrame([], "_a long, _b long, low double")  # of the distances of this round's pivots
    stale, parts = True, None  # components of all links so far
    # Where two sets first meet, what is left of either must hold the overlap that they need.
    overlap = lambda na, nb: F.ceil((na + nb) * percent / (100 + percent))
    reach = lambda na, pa_, nb, pb: (na - pa_ >= overlap(na, nb)) & (nb - pb >= overlap(na, nb))
    near = (F.least("na", "nb") * 100) >= F.greatest("na", "nb") * percent
    eps = (100 - percent) / 100 + 1e-9

    def verify(pairs: DataFrame, name: str, pivots: bool = False) -> None:
        nonlocal ready, links, stale, bounds
        swap = F.col("a") > F.col("b")
        either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        fresh = pairs.where(near).select(either("a", "b").alias("a"), either("b", "a").alias("b"), either("na", "nb").alias("na"), either("nb", "na").alias("nb")).distinct()
        fresh = fresh.join(ready, ["a", "b"], "left_anti")
        rows = {"n": F.count(F.lit(1))}
        if pivots:  # of other pairs, signatures were compared where they met
            compared = scratch.table(_plausible(fresh, signatures, percent), f"{name}-compared", n=F.count_if("ok"))
            bounds = compared.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "low")
            maybe = compared.where("ok").select("a", "b")
        else:
            compared = maybe = scratch.table(fresh.select("a", "b"), f"{name}-compared", **rows)
        if not compared.measured["n"]:
            return
        wanted = scratch.table(maybe.select(F.explode(F.array("a", "b")).alias("g")).distinct().join(classes, "g"), f"{name}-wanted", **rows)
        if wanted.measured["n"] <= few:  # 16 bytes each; beyond that, a shuffled join
            wanted = F.broadcast(wanted)
        sets = scratch.table(_sets(docs, wanted, size), f"{name}-sets")
        linked = F.col("k") * 100 >= F.col("u") * percent
        got = scratch.table(_overlaps(_near_enough(maybe, sets, percent), sets).distinct(), name, n=F.count_if(linked))
        scratch.drop(f"{name}-sets")
        ready = ready.unionByName(got)
        if got.measured["n"]:
            links, stale = links.unionByName(got.where(linked).select("a", "b")), True

    i = 0
    while True:
        # Each cell's pivot, and its distance to all sets of the cell.
        # A pivot comes from those that the cell lies early enough for to meet sets of their own size.
        late = F.col("pos") * (100 + percent) > F.col("n") * (100 - percent)
        pivot = open_.groupBy("x").agg(F.min_by(F.struct(F.col("g").alias("p"), F.col("n").alias("np"), F.col("pos").alias("pp")), F.struct(late, F.xxhash64("g", F.lit(i)))).alias("p")).select("x", "p.*")
        star = open_.join(pivot, "x").where("g <> p").where((F.col("m") > small) | reach(F.col("n"), F.col("pos"), F.col("np"), F.col("pp")))  # of large cells, all: their distances narrow the window
        verify(star.select(F.col("p").alias("a"), F.col("g").alias("b"), F.col("np").alias("na"), F.col("n").alias("nb")), f"star-{i}", pivots=True)
        if stale:
            parts, stale = connected_components(scratch, links, f"parts-{i}"), False
        comp = lambda df, g, name: df.join(parts.select(F.col("node").alias(g), F.col("component").alias(name)), g, "left").withColumn(name, F.coalesce(name, g))  # noqa: E731, B023
        placed = comp(comp(open_.join(pivot, "x"), "g", "c"), "p", "cp")
        outer = placed.where("c <> cp").select("x").distinct()
        left = placed.join(outer, "x", "left_semi").select("x", "g", "n", "pos", "m", "c", "cp", "p", "np")
        pair = ready.select(F.col("a").alias("_a"), F.col("b").alias("_b"), (1 - F.col("k") / F.col("u")).alias("d"))
        pair = bounds.join(pair, ["_a", "_b"], "full")
        left = left.withColumn("_a", F.least("g", "p")).withColumn("_b", F.greatest("g", "p")).join(pair, ["_a", "_b"], "left").drop("_a", "_b")
        # Sets that are not measured are at least as far as their signatures and sizes say.
        left = scratch.table(left.withColumn("far", F.col("d").isNull() & (F.col("g") != F.col("p"))).withColumn("d", F.when(F.col("g") == F.col("p"), 0.0).otherwise(F.coalesce("d", F.greatest(1 - F.least("n", "np") / F.greatest("n", "np"), F.coalesce("low", F.lit(0.0)))))).drop("low").join(signatures, "g"), f"left-{i}", n=F.count(F.lit(1)))
        if not left.measured["n"]:
            break
        a, b = left.alias("a"), left.alias("b")
        last = i + 1 >= rounds
        small_cell = F.lit(True) if last else F.col("a.m") <= small
        fits = reach(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"))
        # Two sets within the threshold differ by it at most in their distance to the pivot.
        window = F.when(F.col("a.far") & F.col("b.far"), F.lit(True)).when(F.col("a.far"), F.col("a.d") - F.col("b.d") <= eps).when(F.col("b.far"), F.col("b.d") - F.col("a.d") <= eps).otherwise(F.abs(F.col("a.d") - F.col("b.d")) <= eps)
        fits &= can_link(least_difference(F.col("a.signature"), F.col("b.signature")), F.col("a.n") + F.col("b.n"), percent)
        each = a.join(b, (F.col("a.x") == F.col("b.x")) & small_cell & window & (F.col("a.g") < F.col("b.g")) & (F.col("a.c") != F.col("b.c")) & fits)
        # Of large cells: an outer set against the pivot's component, inside that window.
        cross = a.where("c <> cp").alias("a").join(b.where("c = cp").alias("b"), (F.col("a.x") == F.col("b.x")) & ~small_cell & window & fits)
        both = [F.col("a.g").alias("a"), F.col("b.g").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")]
        pairs = each.select(*both).unionByName(cross.select(*both))
        verify(pairs, f"rest-{i}")
        if last:
            break
        again = left.where(F.col("m") > small).where("c <> cp").select("x", "g", "n", "pos")
        again = again.join(again.groupBy("x").agg(F.count("*").alias("m")).where("m > 1"), "x")
        i += 1
        open_ = scratch.table(again, f"open-{i}", n=F.count(F.lit(1)))
        if not open_.measured["n"]:
            break
    if stale:
        parts = connected_components(scratch, links, "parts")
    named = classes.join(parts.withColumnRenamed("node", "g"), "g", "left").withColumn("component", F.coalesce("component", "g"))
    name = named.groupBy("component").agg(F.min("id").alias("name"))
    named = scratch.table(named.join(name, "component").select("g", F.col("name").alias("component")), "named")
    out = rows.join(named, (rows.g == named.g) & (rows.n > 0) & rows.id.isNotNull(), "left")
    return out.select(rows.id, rows.n.alias("n_shingles"), F.coalesce(named.component, rows.id).alias("component"))


# ---------------------------------------------------------------- query and SQL


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "ngrams"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


QUERIES = {"op8_ngram_join": op8_ngram_join}
#: DuckDB: words, shingles, every pair that shares a shingle, components by recursion.
ORACLE_SQL = {
    "op8_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM o WHERE 100 * k >= 75 * (na + nb - k)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.j, r.root FROM r JOIN l ON l.i = r.doc_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""
}
