"""Compaction of k-mers into unitigs, contracted: most of a path is put together inside of tasks, and only
what crosses from one task to another takes part in the loop over all tasks.

Where paths may go on is decided at a junction, the (k - 1)-mer that neighbours share, in the smaller of its two
orientations. Every junction belongs to one bucket, by its minimizer; a k-mer goes to the buckets of both its
junctions, so a bucket sees everything that meets at its junctions, and neighbours mostly share a bucket. A
task joins the k-mers of a bucket at junctions with one way in and one way out, as pointer doubling over
numpy arrays. What comes out are pieces: paths, of which an end is open if its k-mer's other junction belongs
to another bucket. There, the same k-mer is an open end of one other piece: pieces are glued at k-mers.

A minimizer that many k-mers share is not kept together: its junctions are dealt out by their own hash,
which gives shorter pieces and the same unitigs.

All of this is for odd k: of an odd k, no k-mer is its own mirror image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.encoding import revcomp
from strandloom.operators.iterate import cut, drop, ranked, smallest_on_rings

#: Rows of a bucket that is wished for, letters of a minimizer, digits of a packed word.
BUCKET, MINIMIZER, WORD = 1 << 21, 8, 31
PIECES = "pid long, seq string, abundances array<bigint>, left string, right string, circular boolean"


# ---------------------------------------------------------------- k-mers in numpy


def digit_matrix(column: pa.Array, k: int) -> np.ndarray:
    """Texts of ``k`` digits each, as numbers 0 to 3, a row a text."""
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    first = int(np.frombuffer(at, np.int64 if wide else np.int32)[column.offset])
    return np.frombuffer(data, np.uint8, len(column) * k, first).reshape(-1, k) & 3


def packed(m: np.ndarray) -> list[np.ndarray]:
    """Rows of digits as words of 31 digits, the first the most significant."""
    out = []
    for at in range(0, m.shape[1], WORD):
        word = np.zeros(len(m), np.uint64)
        for j in range(at, min(at + WORD, m.shape[1])):
            word = (word << np.uint64(2)) | m[:, j]
        out.append(word)
    return out


def lesser(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(the smaller of both, where ``a`` is smaller, where they are equal)."""
    less, same = np.zeros(len(a[0]), bool), np.ones(len(a[0]), bool)
    for x, y in zip(a, b, strict=True):
        less |= same & (x < y)
        same &= x == y
    return [np.where(less, x, y) for x, y in zip(a, b, strict=True)], less, same


def labels(words: list[np.ndarray]) -> np.ndarray:
    """Numbers from 0 that are equal where all words are."""
    if len(words) == 1:
        return np.unique(words[0], return_inverse=True)[1]
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), np.int64)
    for w in words:
        new[1:] |= w[order][1:] != w[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def junction_keys(d: np.ndarray) -> list[np.ndarray]:
    """Of k-mers: minimizers of the left and the right junction (the least hash of the m-mers inside, both
    strands alike), and hashes of both junctions, as numbers below 2**31."""
    n, k = d.shape
    m = min(MINIMIZER, k - 1)
    forward, back = (np.zeros(n, np.uint64) for _ in range(2))
    mask, top = np.uint64((1 << 2 * m) - 1), np.uint64(2 * (m - 1))
    low = [np.full(n, np.iinfo(np.uint64).max, np.uint64) for _ in range(2)]
    for j in range(k):
        x = d[:, j].astype(np.uint64)
        forward = ((forward << np.uint64(2)) | x) & mask
        back = (back >> np.uint64(2)) | ((x ^ np.uint64(2)) << top)
        if j >= m - 1:
            h = mixed(np.minimum(forward, back) + np.uint64(1))
            if j < k - 1:
                low[0] = np.minimum(low[0], h)
            if j >= m:
                low[1] = np.minimum(low[1], h)
    hashes = []
    for side in (d[:, :-1], d[:, 1:]):
        words, *_ = lesser(packed(side), packed((side ^ 2)[:, ::-1]))
        h = np.zeros(n, np.uint64)
        for w in words:
            h = mixed(h ^ w)
        hashes.append(h)
    return [(x >> np.uint64(33)).astype(np.int64) for x in (*low, *hashes)]


def settle(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, steps from it, whether it is a ring) of nodes that each have one node before them, or -1. Rings
    are cut at their smallest node."""
    n = len(before)
    head, rank = np.where(before < 0, np.arange(n), before), (before >= 0).astype(np.int64)
    settled, open_ = before < 0, np.flatnonzero(before >= 0)
    while len(open_):
        p = head[open_]
        rank[open_] += rank[p]
        head[open_], settled[open_] = head[p], settled[p]
        left = open_[~settled[open_]]
        if len(left) == len(open_):
            break
        open_ = left
    ring = np.zeros(n, bool)
    if len(open_):
        low, ahead = np.arange(n), before.copy()
        for _ in range(len(open_).bit_length()):
            p = ahead[open_]
            low[open_], ahead[open_] = np.minimum(low[open_], low[p]), ahead[p]
        again = np.full(n, -1)
        again[open_] = np.where(low[open_] == open_, -1, before[open_])
        h, r, _ = settle(again)
        head[open_], rank[open_], ring[open_] = h[open_], r[open_], True
    return head, rank, ring


def compact(d: np.ndarray, abundance: np.ndarray, owned: np.ndarray) -> pa.RecordBatch:
    """Pieces of a bucket: ``d`` k-mers, ``owned`` 1 and 2 where the left and the right junction is the bucket's.
    Side 2i is the left one of k-mer i, 2i + 1 the right one; a k-mer that is left by side s is node s."""
    n, k = d.shape
    sides = np.empty((2 * n, k - 1), np.uint8)
    sides[0::2], sides[1::2] = d[:, :-1], d[:, 1:]
    low, forward, same = lesser(packed(sides), packed((sides ^ 2)[:, ::-1]))
    at = labels(low)
    own = np.empty(2 * n, bool)
    own[0::2], own[1::2] = owned & 1, owned >> 1
    # the right side enters its junction, the left one leaves it; the other way round in the mirror image
    enters = (np.arange(2 * n) & 1 == 1) == forward
    free = own & ~same
    count = [np.bincount(at[free & (enters == e)], minlength=int(at.max()) + 1) for e in (True, False)]
    which = [np.full(len(count[0]), -1) for _ in range(2)]
    for held, e in zip(which, (True, False), strict=True):
        held[at[free & (enters == e)]] = np.flatnonzero(free & (enters == e))
    simple = (count[0] == 1) & (count[1] == 1) & (which[0] >> 1 != which[1] >> 1)
    partner = np.full(2 * n, -1)
    partner[which[0][simple]], partner[which[1][simple]] = which[1][simple], which[0][simple]
    head, rank, ring = settle(partner[np.arange(2 * n) ^ 1])
    order = np.lexsort((rank, head))
    first = np.flatnonzero(np.diff(head[order], prepend=-1))
    last = np.append(first[1:], len(order)) - 1
    heads, tails = order[first], order[last]
    # of a path and its mirror image, one
    keep = np.where(ring[heads], heads & 1 == 0, heads < tails ^ 1)
    sizes = (last - first + 1)[keep]
    nodes = order[np.repeat(keep, last - first + 1)]
    heads, tails, ring = heads[keep], tails[keep], ring[heads[keep]]
    # each node gives its last letter, a head all of its letters
    i, right = nodes >> 1, nodes & 1 == 1
    letter = np.where(right, d[i, k - 1], d[i, 0] ^ 2)
    ends = np.cumsum(sizes)
    text = np.empty(int(sizes.sum()) + len(sizes) * (k - 1), np.uint8)
    begins = ends - sizes + np.arange(len(sizes)) * (k - 1)
    text[np.arange(len(nodes)) + np.repeat((np.arange(len(sizes)) + 1) * (k - 1), sizes)] = letter
    h = heads >> 1
    whole = np.where((heads & 1 == 1)[:, None], d[h], (d[h] ^ 2)[:, ::-1])
    text[begins[:, None] + np.arange(k - 1)] = whole[:, : k - 1]
    seq = _texts(np.append(begins, len(text)), text)
    counts = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(abundance[i].astype(np.int64)))
    keys = []
    for node in (heads ^ 1, tails):  # the sides at which a piece begins and ends
        open_ = ~own[node] & ~ring
        keys.append(pc.if_else(pa.array(open_), _texts(np.arange(len(node) + 1) * k, d[node >> 1]), pa.scalar(None, pa.string())))
    return pa.RecordBatch.from_arrays([seq, counts, *keys, pa.array(ring)], names=["seq", "abundances", "left", "right", "circular"])


def _texts(offsets: np.ndarray, digits: np.ndarray) -> pa.Array:
    """Digits one after the other as texts."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer((digits + 48).astype(np.uint8).tobytes())).cast(pa.string())


def rotated(seq: str, abundances: list[int], k: int) -> tuple[str, list[int]]:
    """A ring (n + k - 1 digits) that begins with its smallest canonical k-mer, in its canonical orientation."""
    n = len(abundances)
    d = np.frombuffer(seq.encode(), np.uint8) & 3
    windows = np.lib.stride_tricks.sliding_window_view(np.resize(d[:n], n + k - 1), k)
    low, forward, _ = lesser(packed(windows), packed((windows ^ 2)[:, ::-1]))
    i = int(np.lexsort(low[::-1])[0])
    if not forward[i]:  # the mirror image's k-mer j is the mirror of k-mer n - 1 - j
        d, abundances, i = (np.resize(d[:n], n + k - 1) ^ 2)[::-1], abundances[::-1], n - 1 - i
    ring = np.roll(d[:n], -i)
    return (np.resize(ring, n + k - 1) + 48).astype(np.uint8).tobytes().decode(), [*abundances[i:], *abundances[:i]]


# ---------------------------------------------------------------- Spark


def pieces(nodes: DataFrame, k: int, bucket: int = BUCKET) -> DataFrame:
    """A table (pid, seq, abundances, left, right, circular) of what each bucket's task puts together; ``left`` and
    ``right`` are the canonical k-mers of open ends."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, junction_keys(digit_matrix(batch.column(0), k)))], names=["kmer", "abundance", "ml", "mr", "hl", "hr"])

    rows = cut(nodes.select("kmer", F.col("abundance").cast("bigint").alias("abundance")).mapInArrow(keys, "kmer string, abundance bigint, ml bigint, mr bigint, hl bigint, hr bigint"), n=F.count(F.lit(1)))
    n, spark = rows.measured["n"], nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // bucket))
    most = max(4096, 2 * n // parts)
    hot = [r.ml for r in rows.groupBy("ml").agg(F.count("*").alias("n")).where(F.col("n") > most).select("ml").collect()]  # parts / 2 at most
    place = lambda m, h: F.pmod(F.when(F.col(m).isin(hot), F.col(h)).otherwise(F.col(m)) if hot else F.col(m), F.lit(parts)).cast("int")
    one = lambda b, o: F.struct(b.alias("bucket"), F.lit(o).alias("owned"))
    both = rows.select("kmer", "abundance", place("ml", "hl").alias("l"), place("mr", "hr").alias("r"))
    to = F.when(F.col("l") == F.col("r"), F.array(one(F.col("l"), 3))).otherwise(F.array(one(F.col("l"), 1), one(F.col("r"), 2)))
    dealt = both.select("kmer", "abundance", F.explode(to).alias("x")).select("kmer", "abundance", "x.bucket", "x.owned").repartitionById(parts, F.col("bucket"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        del held
        of = t.column("bucket").to_numpy()
        for b in np.unique(of):  # one, as buckets are dealt
            part = t.filter(pa.array(of == b)).combine_chunks()
            got = compact(digit_matrix(part.column("kmer").chunk(0), k), part.column("abundance").to_numpy(), part.column("owned").to_numpy())
            pid = (int(b) << 36) + np.arange(got.num_rows)
            for at in range(0, got.num_rows, 10_000):
                rows = got.slice(at, 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(pid[at : at + 10_000]), *rows.columns], names=["pid", *got.schema.names])

    out = cut(dealt.mapInArrow(task, PIECES), open=F.count_if(F.col("left").isNotNull() | F.col("right").isNotNull()), rings=F.count_if("circular"))
    drop(rows)
    return out


def paired(parts: DataFrame) -> DataFrame:
    """(a, b): open ends with the same k-mer; an end is 2 * pid, plus 1 for the right one."""
    end = lambda side, key: F.struct(F.col(key).alias("key"), (F.col("pid") * 2 + side).alias("end"))
    ends = parts.select(F.explode(F.array(end(0, "left"), end(1, "right"))).alias("x")).select("x.*").where("key IS NOT NULL")
    return ends.groupBy("key").agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count("*").alias("n")).where("n = 2").select("a", "b")


def glued(parts: DataFrame, pairs: DataFrame, k: int, overlap: int) -> DataFrame:
    """A table (seq, abundances, circular) of what becomes of ``parts`` (pid, seq, abundances, ...) of which the ends
    in ``pairs`` (each in one pair at most) are joined; parts without such an end are not in it. ``overlap``:
    letters that joined parts share, k if they share a k-mer, else k - 1. Of a path and its mirror image, the
    one that has its part of smallest pid the right way round. Rings begin anywhere."""
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(1).cast("bigint"))
    before = pairs.select(F.explode(F.array(F.struct(flip("b").alias("o"), F.col("a").alias("before")), F.struct(flip("a").alias("o"), F.col("b").alias("before")))).alias("x")).select("x.*")
    # of a part with one joined end, the other end begins a path
    nodes = before.select(F.explode(F.array(F.struct(F.col("o"), F.col("before")), F.struct(flip("o").alias("o"), F.lit(None).cast("bigint").alias("before")))).alias("x")).select("x.*")
    paths, rings = ranked(nodes.groupBy("o").agg(F.max("before").alias("before")))
    made = paths.select("o", F.col("ptr").alias("head"), "rank", F.lit(False).alias("circular"))
    tables = [paths]
    if rings is not None:
        low = smallest_on_rings(rings, F.col("o"))
        again, _ = ranked(rings.join(low, "o").select("o", F.when(F.col("o") != F.col("low"), F.col("before")).alias("before")))
        made = made.unionByName(again.select("o", F.col("ptr").alias("head"), "rank", F.lit(True).alias("circular")))
        tables += [rings, low, again]
    keep = made.groupBy("head").agg(F.min(flip("o")).alias("m")).where("m % 2 = 0").select("head")
    along = made.join(keep, "head", "left_semi").withColumn("pid", F.shiftright("o", 1)).join(parts.select("pid", "seq", "abundances"), "pid")
    straight = F.col("o").bitwiseAND(F.lit(1).cast("bigint")) == 1
    item = F.struct("rank", F.when(straight, F.col("seq")).otherwise(revcomp(F.col("seq"))).alias("s"), F.when(straight, F.col("abundances")).otherwise(F.reverse("abundances")).alias("a"))
    rows = along.groupBy("head", "circular").agg(F.sort_array(F.collect_list(item)).alias("x"))
    shared = overlap - (k - 1)  # k-mers that joined parts have in common
    seq = F.array_join(F.transform("x", lambda e, i: F.when(i == 0, e.s).otherwise(F.substr(e.s, F.lit(overlap + 1)))), "")
    counts = F.flatten(F.transform("x", lambda e, i: F.when(i == 0, e.a).otherwise(F.slice(e.a, F.lit(1 + shared), F.size(e.a)))))
    out = rows.select(seq.alias("seq"), counts.alias("abundances"), "circular")
    if shared:  # a ring's last k-mer is its first
        out = out.select(F.when(F.col("circular"), F.substr("seq", F.lit(1), F.length("seq") - shared)).otherwise(F.col("seq")).alias("seq"), F.when(F.col("circular"), F.slice("abundances", F.lit(1), F.size("abundances") - shared)).otherwise(F.col("abundances")).alias("abundances"), "circular")
    out = cut(out, rings=F.count_if("circular"))
    for t in tables:
        drop(t)
    return out


def settled_rings(rows: DataFrame, k: int) -> DataFrame:
    """(seq, abundances, circular) of rings, each begun at its smallest k-mer."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [rotated(s, a, k) for s, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in made], pa.string()), pa.array([a for _, a in made], pa.list_(pa.int64())), pa.array([True] * len(made), pa.bool_())], names=["seq", "abundances", "circular"])

    return rows.select("seq", "abundances").mapInArrow(task, "seq string, abundances array<bigint>, circular boolean")


def oriented_rows(rows: DataFrame) -> DataFrame:
    """Paths as the smaller of both orientations."""
    smaller = F.col("seq") <= revcomp(F.col("seq"))
    return rows.select(F.when(smaller, F.col("seq")).otherwise(revcomp(F.col("seq"))).alias("seq"), F.when(smaller, F.col("abundances")).otherwise(F.reverse("abundances")).alias("abundances"), F.lit(False).alias("circular"))


def finished(plain: list[DataFrame], rings: list[DataFrame], k: int) -> DataFrame:
    """A table (seq, n_kmers, circular, abundances, kc) of paths and rings."""
    out = oriented_rows(plain[0])
    for p in plain[1:]:
        out = out.unionByName(oriented_rows(p))
    for r in rings:
        out = out.unionByName(settled_rings(r, k))
    total = F.aggregate("abundances", F.lit(0).cast("bigint"), lambda p, x: p + x)
    return cut(out.select("seq", F.size("abundances").cast("bigint").alias("n_kmers"), "circular", "abundances", total.alias("kc")))


def unitigs(nodes: DataFrame, k: int) -> DataFrame:
    """A table (seq, n_kmers, circular, abundances, kc) of the maximal simple paths of ``nodes`` (kmer, abundance)."""
    parts = pieces(nodes, k)
    closed = parts.where("left IS NULL AND right IS NULL AND NOT circular")
    plain, rings, used = [closed], [parts.where("circular")] if parts.measured["rings"] else [], [parts]
    if parts.measured["open"]:
        joined = glued(parts, paired(parts), k, k)
        plain.append(joined.where("NOT circular"))
        if joined.measured["rings"]:
            rings.append(joined.where("circular"))
        used.append(joined)
    out = finished(plain, rings, k)
    for t in used:
        drop(t)
    return out
