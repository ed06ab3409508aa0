"""Best-fit packing of token sequences, bulk-synchronous.

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut). Pieces and
gaps are then matched as best-fit decreasing would: the longest pieces first, each into the smallest
gap that holds it. Lengths are integers up to ``capacity``, so all pieces of one length are one
bulk, and gaps of one size are interchangeable: a superstep takes a bulk, finds by successor search
the smallest gap size that fits, gives the gaps of that size to the bulk by rank (as many copies as
a gap holds), returns the smaller gaps that remain to the sorted gaps, and goes on to the next size
until the bulk is placed; what finds no gap opens new sequences. Supersteps only see how many pieces
each length has (``capacity`` rows at most, whatever the corpus) and leave runs "pieces with ranks
a..b of length s go to sequences c.. at offset o". The pieces themselves stay in Spark: they are
range-sorted by length, ranked by their place in the sorted partitions, and matched to the runs.

The outcome is that of best-fit decreasing piece by piece, in one sort of the pieces.

Edge cases: a null or empty text is the piece with the end token alone; pieces of equal length and
repeated rows are told apart by their place in the sort; an empty table gives no rows; special-token
strings in a text are tokenised as the tokenizer's file says; a null id is carried along as null; a very
long text is tokenised whole, by itself, in about 50 bytes of memory for each of its own, and cut into
pieces after that; columns besides id and text are not read."""

from __future__ import annotations

import bisect
import codecs
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from strandloom.llm.common import U64, Scratch, give_back, mix, released, shuffle_partitions, span_hashes, text_chunks, word_spans

# ---------------------------------------------------------------- tokens

class KnownWords:
    """Token ids by 64-bit keys, in sorted arrays: about 25 bytes a word. New words wait in a small
    table that is merged into the large one now and then. Beyond ``most`` words, those go that were
    not met since the last time; a word that is gone is met anew, so this only bounds memory."""

    def __init__(self, most: int):
        self.most, self.flat = most, np.zeros(0, np.uint32)
        self.tables = [self._table([], [], [], []) for _ in range(2)]  # large, small

    @staticmethod
    def _table(keys, starts, sizes, met) -> tuple[np.ndarray, ...]:
        return np.asarray(keys, U64), np.asarray(starts, np.int64), np.asarray(sizes, np.int32), np.asarray(met, bool)

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in ``flat``, -1 if unknown; number of ids) of each of the sorted ``keys``."""
        start, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int32)
        for known, starts, sizes, met in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                at = at[hit]
                start[hit], size[hit] = starts[at], sizes[at]
                met[at] = True
        return start, size

    def learn(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New words with their ids one after the other."""
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        small = tuple(np.concatenate(c) for c in zip(self.tables[1], self._table(keys, starts, sizes, np.ones(len(keys), bool)), strict=True))
        order = np.argsort(small[0], kind="stable")
        self.tables[1] = tuple(c[order] for c in small)
        if len(small[0]) * 8 > len(self.tables[0][0]):
            both = tuple(np.concatenate(c) for c in zip(*self.tables, strict=True))
            order = np.argsort(both[0], kind="stable")
            self.tables = [tuple(c[order] for c in both), self._table([], [], [], [])]

    def shrink(self) -> None:
        """Forget what was not met lately; everything, if that is too much still."""
        if len(self) <= self.most:
            return
        both = tuple(np.concatenate(c) for c in zip(*self.tables, strict=True))
        kept = np.flatnonzero(both[3] if 2 * both[3].sum() <= self.most else np.zeros(len(both[3]), bool))
        kept = kept[np.argsort(both[0][kept], kind="stable")]
        starts, sizes = both[1][kept], both[2][kept].astype(np.int64)
        done = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(starts - done + sizes, sizes) + np.arange(int(done[-1]) if len(done) else 0)]
        self.tables = [self._table(both[0][kept], done - sizes, sizes, np.zeros(len(kept), bool)), self._table([], [], [], [])]


class WordTokens:
    """Token ids of many texts at once, by their distinct words: white space never ends up inside a
    token of this kind of tokenizer, so a text's ids are those of its words. Words that are one
    letter run (a-z and Latin-1 letters) with or without one comma or full stop are looked up as
    lower-cased run and mark, which is what the tokenizer's normaliser and splitter make of them;
    any other word goes through the whole tokenizer. Ids of words that were met are kept, up to
    ``most`` words."""

    def __init__(self, path: str, most: int = 600_000):
        self.whole = Tokenizer.from_file(path)
        self.runs = Tokenizer(self.whole.model)  # the same model, for runs that need no normaliser
        self.runs.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        shown = dict(zip(printable, map(chr, printable), strict=True)) | {b: chr(256 + i) for i, b in enumerate(others)} | {32: " "}
        self.shown = "".join(shown[b] for b in range(256))
        self.ends = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.marks = {m: self.whole.encode(m, add_special_tokens=False).ids for m in (".", ",")}
        self.known = KnownWords(most)

    def _plain(self, low: np.ndarray, starts: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of letter runs: spans of ``low``, one space after each."""
        sizes = stems - starts
        at = np.cumsum(sizes + 1) - sizes - 1
        text = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text[np.repeat(at, sizes) + inside] = low[np.repeat(starts, sizes) + inside]
        shown = codecs.charmap_decode(text[:-1].tobytes().lower(), "strict", self.shown)[0]
        ids = np.array(self.runs.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.uint32)
        return np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0), ids

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with ``end`` behind it; where each begins)."""
        known = self.known
        known.shrink()
        lead = np.zeros(len(data), dtype=bool)
        lead[1:] = data[:-1] == 0xC3
        letter = _ASCII_LETTER[data] | (data == 0xC3) | (lead & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7))
        low = np.where(lead & (data >= 0x80) & (data <= 0x9E), data + np.uint8(0x20), data)
        starts, ends, doc = word_spans(data, offsets)
        mark = (data[ends - 1] == 0x2E) + 2 * (data[ends - 1] == 0x2C)
        mark[ends - starts == 1] = 0
        stems = ends - (mark > 0)
        letters = np.concatenate([[0], np.cumsum(letter)])
        plain = letters[stems] - letters[starts] == stems - starts
        mark[~plain] = 0
        stems[~plain] = ends[~plain]
        raw = data.tobytes()
        other = span_hashes(data, starts, ends)
        if b"<|" in raw:  # only in special tokens do capitals matter
            other += span_hashes(((data >= 65) & (data <= 90)).astype(np.uint8), starts, ends)
        hashes = np.where(plain, span_hashes(low, starts, stems), mix(other))
        hashes = np.maximum(hashes, U64(3))
        # Units: the words, their marks, and the end of each text.
        texts = len(offsets) - 1
        per_word = 1 + (mark > 0)
        at = np.cumsum(per_word) - per_word + doc
        last = np.cumsum(np.bincount(doc, per_word, texts).astype(np.int64)) + np.arange(texts)
        units = np.zeros(int(per_word.sum()) + texts, dtype=U64)
        units[at] = hashes
        marked = mark > 0
        units[at[marked] + 1] = mark[marked].astype(U64)
        distinct, one, which = np.unique(units, return_index=True, return_inverse=True)
        begin, size = known.find(distinct)
        fresh = np.flatnonzero(begin < 0)
        if len(fresh):
            word = np.full(len(units), -1, dtype=np.int64)
            word[at] = np.arange(len(starts))
            w = word[one[fresh]]
            fixed = {0: [end], 1: self.marks["."], 2: self.marks[","]}
            for i in np.flatnonzero(w < 0):
                ids = fixed[int(distinct[fresh[i]])]
                known.learn(distinct[fresh[i : i + 1]], np.array([len(ids)]), np.array(ids))
            fresh, w = fresh[w >= 0], w[w >= 0]
            for is_plain in (True, False):
                own = plain[w] == is_plain
                keys, v = distinct[fresh[own]], w[own]
                if not len(keys):
                    continue
                if is_plain:
                    sizes, ids = self._plain(low, starts[v], stems[v])
                else:
                    got = [e.ids for e in self.whole.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts[v].tolist(), stems[v].tolist(), strict=True)], add_special_tokens=False)]
                    sizes = np.fromiter(map(len, got), np.int64, len(got))
                    ids = np.array([i for x in got for i in x], np.uint32)
                if len(sizes) != len(keys):
                    raise AssertionError("words and ids are out of step")
                known.learn(keys, sizes, ids)
            begin, size = known.find(distinct)
        sizes = size.astype(np.int64)[which]
        done = np.cumsum(sizes)
        flat = known.flat[np.repeat(begin[which] - done + sizes, sizes) + np.arange(int(done[-1]) if len(done) else 0)]
        return flat, np.concatenate([[0], done[last]])


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def tokenize_pieces(documents: DataFrame, tokenizer: str, capacity: int, end: int, id_col: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document; ``tokenizer`` is the path of
    the tokenizer's file, the same on every machine."""
    names = ["piece", "start", "length", "ids_crc32"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens(tokenizer)
        give_back()  # what reading the tokenizer's file took
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), 1 << 18):
                flat, begins = words.encode(data, offsets, end)
                row, piece, start, length, crc, parts = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                    for j, s in enumerate(range(a, b, capacity)):
                        part = flat[s : min(s + capacity, b)]
                        row.append(lo + i)
                        piece.append(j)
                        start.append(s - a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                        parts.append(part)
                cols = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                if ids:
                    cols.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["id", *names, *(["ids"] if ids else [])])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text).mapInArrow(released(task), f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if ids else ""))


# ---------------------------------------------------------------- supersteps

Run = tuple[int, int, int, int, int, int]


def best_fit_runs(bulks: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Supersteps over the bulks {length: pieces}, longest first. Returns the runs (length, first
    rank, pieces, first sequence, pieces a sequence, offset of the first) and the number of
    sequences. Gaps are runs of sequences by size, sizes kept sorted for the successor search."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: [(first sequence, sequences)]
    sizes: list[int] = []
    runs: list[Run] = []
    opened = 0

    def give_back(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for length in sorted(bulks, reverse=True):
        rank, left = 0, bulks[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[at]
            else:
                size, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = size // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - size))
                rank, left = rank + full * each, left - full * each
                give_back(size - each * length, first, full)
            if full < n:
                if left:  # fewer pieces than the next gap holds
                    runs.append((length, rank, left, first + full, left, capacity - size))
                    give_back(size - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                give_back(size, first + full, n - full)
    return runs, opened


def pack(pieces: DataFrame, scratch: Scratch, capacity: int) -> DataFrame:
    """``pieces`` (with a column ``length``, 1 to ``capacity``; a table, as it is read twice) with
    ``sequence_id`` and ``offset``."""
    spark = scratch.spark
    n = shuffle_partitions(spark)
    bulks = {x.length: x.n for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs, _ = best_fit_runs(bulks, capacity)
    # Longest first; equal lengths are cut by a hash, so a length that most pieces have is dealt out too.
    salt = F.xxhash64(*[c for c in pieces.columns if c != "ids"])
    dealt = pieces.withColumn("_salt", salt).repartitionByRange(n, F.desc("length"), "_salt").sortWithinPartitions(F.desc("length"), "_salt").withColumn("_part", F.spark_partition_id())
    dealt = scratch.table(dealt.drop("_salt"), "sorted")
    # How many pieces of each length lie in earlier partitions: lengths meet in few partitions each.
    counts = dealt.groupBy("_part", "length").agg(F.count("*").alias("n")).collect()  # partitions + capacity rows at most
    before: dict[tuple[int, int], int] = {}
    so_far: dict[int, int] = {}
    for x in sorted(counts, key=lambda x: x._part):
        before[x._part, x.length] = so_far.get(x.length, 0)
        so_far[x.length] = so_far.get(x.length, 0) + x.n
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    held = spark.sparkContext.broadcast((before, table))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, table = held.value
        seen: dict[tuple[int, int], int] = {}
        first_of = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            part = batch.column(batch.schema.get_field_index("_part")).to_numpy()
            rank = np.empty(len(length), np.int64)
            key = part.astype(np.int64) * (capacity + 1) + length
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))
            for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
                k = (int(part[order[a]]), int(length[order[a]]))
                at = seen.get(k, before[k])
                rank[order[a:b]] = at + np.arange(b - a)
                seen[k] = at + (b - a)
            run = table[np.searchsorted(first_of, length * (1 << 44) + rank, "right") - 1]
            k = rank - run[:, 1]
            cols = [pa.array(run[:, 3] + k // run[:, 4]), pa.array(run[:, 5] + k % run[:, 4] * length)]
            kept = [i for i, c in enumerate(batch.schema.names) if c != "_part"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *cols], names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    # A task counts on from what it has seen of a (partition, length), so each sorted partition
    # is brought to one task, in an order of its own: a task that is run again deals as it did before.
    same = dealt.repartition(n, "_part").sortWithinPartitions("_part", F.desc("length"), *[c for c in pieces.columns if c not in ("ids", "length")])
    return same.mapInArrow(task, dealt.drop("_part").schema.add("sequence_id", "long").add("offset", "long"))


def best_fit_packing(documents: DataFrame, scratch: Scratch, tokenizer: str | None = None, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = scratch.table(tokenize_pieces(documents, path, capacity, end, id_col, text, ids), "pieces")
    return pack(pieces, scratch, capacity)


# ---------------------------------------------------------------- query


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = best_fit_packing(docs, Scratch(spark, "packing"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
