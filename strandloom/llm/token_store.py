"""Token ids as files, entropy-coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all documents, serves all files. Documents are written in ascending
order of their ids; their tokens follow each other in blocks of ``steps * lanes * segments`` tokens at
most, and each block is coded by itself: ``lanes`` coder states are interleaved, token i of a block
belongs to lane i mod lanes, and a step codes one token in every lane as one numpy operation. A block is
cut into segments; at the start of each there is a checkpoint (the states of all lanes and the place in
the block's words), so a decoder may start at any segment, and segments decode in parallel. Every
segment has a CRC-32 of its words and one of its ids, every file's index one of its bytes.

A file: ``MAGIC``, the blocks, the index, and a tail (length of the index, its CRC-32, ``MAGIC``).
A block: uint32 words, the first read first. The index (zlib, numpy arrays one after the other, see
``_INDEX``): the table's CRC-32; for each segment its block's place and words, the checkpoint, the number
of tokens, both CRC-32; for each document its id and number of tokens. The table: ``table.bin`` in the
same folder, uint32 frequencies that sum to 2**20 (zlib).

The coder: a state is a number from 2**31 below 2**63; a token of frequency f and cumulated frequency c
turns x into (x // f << 20) + x % f + c, after the low 32 bits were moved out where x would grow
beyond; the decoder undoes it in reverse order.

Edge cases: a null or empty text is its end token alone; an empty table gives no rows and no data files;
repeated ids are kept, in an order that is fixed when the tokens are stored (``start`` follows that
order); null ids come first, and come back as null; a very long text is tokenised whole and may run over
many blocks; the strings of special tokens in a text are tokenised as the tokenizer's file says; columns
besides id and text are not read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, give_back, released, shuffle_partitions, text_chunks
from strandloom.llm.packing import WordTokens

MAGIC, SCALE, LOW = b"STRRANS1", 20, 1 << 31
LANES, STEPS, SEGMENTS = 1024, 256, 2
U64, U32 = np.uint64, np.uint32

#: Arrays of a file's index and their types.
_INDEX = {"word_at": "<i8", "words": "<i8", "entry": "<i8", "tokens": "<i8", "crc": "<u4", "word_crc": "<u4", "block": "<i8", "first": "<i8", "states": "<u8", "doc_id": "<i8", "doc_null": "u1", "doc_tokens": "<i8"}


# ---------------------------------------------------------------- the coder


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**20: one at least for what occurs, the rest in proportion, what
    rounding leaves to the largest fractions (ties: the smaller id)."""
    total, present = int(counts.sum()), counts > 0
    out = present.astype(np.int64)
    room = (1 << SCALE) - int(out.sum())
    if room < 0:
        raise ValueError("more distinct tokens than the table has places")
    if total:
        share = counts.astype(np.float64) * (room / total)
        out += np.floor(share).astype(np.int64)
        left = (1 << SCALE) - int(out.sum())
        out[np.lexsort((np.arange(len(out)), -np.where(present, share - np.floor(share), -1)))[:left]] += 1
    return out.astype(U32)


class Coder:
    """Encodes and decodes arrays of ids by one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(U64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(U64)
        self.most = self.freq << U64(63 - SCALE)  # from here on, 32 bits move out first
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._slots: np.ndarray | None = None

    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=U32), self.freq.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray, lanes: int = LANES, steps: int = STEPS) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """(words, for each segment of ``steps * lanes`` ids the (place in words, states) to start from)."""
        f, c, most = self.freq[ids], self.start[ids], self.most[ids]
        if len(ids) and not f.all():
            raise ValueError("an id that the table does not have")
        x = np.full(lanes, LOW, U64)
        chunks: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        written = 0
        last = -(-len(ids) // lanes) - 1
        for step in range(last, -1, -1):
            a = step * lanes
            fs_, cs, ms = f[a : a + lanes], c[a : a + lanes], most[a : a + lanes]
            y = x[: len(fs_)]
            out = np.flatnonzero(y >= ms)
            if len(out):
                moved = y[out]
                chunks.append((moved & U64(0xFFFFFFFF)).astype(U32))
                y[out] = moved >> U64(32)
                written += len(out)
            q = y // fs_
            y[:] = (q << U64(SCALE)) + (y - q * fs_) + cs
            if step % steps == 0:
                marks.append((written, x.copy()))
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, U32)
        return words, [(len(words) - at, s) for at, s in reversed(marks)]

    def decode(self, words: np.ndarray, entry: int, states: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids from a checkpoint on."""
        slots, lanes = self.slots(), len(states)
        x, out = states.astype(U64), np.empty(n, U32)
        mask = U64((1 << SCALE) - 1)
        for a in range(0, n, lanes):
            y = x[: min(lanes, n - a)]
            slot = y & mask
            ids = slots[slot.astype(np.int64)]
            out[a : a + len(y)] = ids
            y[:] = self.freq[ids] * (y >> U64(SCALE)) + slot - self.start[ids]
            low = np.flatnonzero(y < LOW)
            if len(low):
                y[low] = (y[low] << U64(32)) | words[entry : entry + len(low)]
                entry += len(low)
        return out


# ---------------------------------------------------------------- files


class StoreWriter:
    """Documents one after the other into one file; holds a block's ids."""

    def __init__(self, out, coder: Coder, lanes: int = LANES, steps: int = STEPS, segments: int = SEGMENTS):
        self.out, self.coder, self.lanes, self.steps, self.block = out, coder, lanes, steps, lanes * steps * segments
        self.held, self.size, self.at, self.blocks, self.tokens = [], 0, len(MAGIC), 0, 0
        self.parts: dict[str, list] = {k: [] for k in _INDEX}
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.parts["doc_id"].append(0 if doc_id is None else doc_id)
        self.parts["doc_null"].append(doc_id is None)
        self.parts["doc_tokens"].append(len(ids))
        self.held.append(ids)
        self.size += len(ids)
        while self.size >= self.block:
            every = np.concatenate(self.held)
            self._block(every[: self.block])
            self.held, self.size = [every[self.block :]], len(every) - self.block

    def _block(self, ids: np.ndarray) -> None:
        words, marks = self.coder.encode(ids, self.lanes, self.steps)
        each = self.lanes * self.steps
        ends = [*(entry for entry, _ in marks[1:]), len(words)]
        for i, (entry, states) in enumerate(marks):
            part = ids[i * each : (i + 1) * each]
            row = {"word_at": self.at, "words": len(words), "entry": entry, "tokens": len(part), "crc": zlib.crc32(part.astype("<u4").tobytes()), "word_crc": zlib.crc32(words[entry : ends[i]].astype("<u4").tobytes()), "block": self.blocks, "first": self.tokens}
            for k, v in row.items():
                self.parts[k].append(v)
            self.tokens += len(part)
            self.parts["states"].append(states)
        self.out.write(words.astype("<u4").tobytes())
        self.at += 4 * len(words)
        self.blocks += 1

    def close(self) -> None:
        if self.size:
            self._block(np.concatenate(self.held))
        self.parts["states"] = np.concatenate(self.parts["states"]) if self.parts["states"] else []
        arrays = [np.asarray(self.parts[k], t) for k, t in _INDEX.items()]
        head = np.array([self.coder.crc, self.lanes, *map(len, arrays)], "<i8")
        index = zlib.compress(head.tobytes() + b"".join(a.tobytes() for a in arrays), 1)
        self.out.write(index + len(index).to_bytes(8, "little") + zlib.crc32(index).to_bytes(4, "little") + MAGIC)
        self.out.close()


class StoreReader:
    """A file's documents and segments. Reads the tail, the index, and the segments that are asked for."""

    def __init__(self, source, coder: Coder):
        self.source, self.coder = source, coder
        source.seek(0, 2)
        end, tail = source.tell(), 12 + len(MAGIC)
        data = self._read(end - tail, tail)
        n = int.from_bytes(data[:8], "little")
        index = self._read(end - tail - n, n)
        if data[12:] != MAGIC or zlib.crc32(index) != int.from_bytes(data[8:12], "little"):
            raise ValueError("not a token file, or a damaged one")
        plain = zlib.decompress(index)
        head = np.frombuffer(plain, "<i8", 2 + len(_INDEX))
        if head[0] != coder.crc:
            raise ValueError("the file was written with another table")
        self.lanes, at = int(head[1]), head.nbytes
        for (k, t), size in zip(_INDEX.items(), head[2:].tolist(), strict=True):
            setattr(self, k, np.frombuffer(plain, t, size, at))
            at += np.dtype(t).itemsize * size
        self.states = self.states.reshape(-1, self.lanes)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def segment(self, i: int) -> np.ndarray:
        """The ids of one segment, checked; what it reads begins at its checkpoint."""
        words_to = int(self.entry[i + 1]) if i + 1 < len(self.block) and self.block[i + 1] == self.block[i] else int(self.words[i])
        first = int(self.entry[i])
        data = self._read(int(self.word_at[i]) + 4 * first, 4 * (words_to - first))
        if zlib.crc32(data) != int(self.word_crc[i]):
            raise ValueError(f"segment {i} is damaged")
        ids = self.coder.decode(np.frombuffer(data, "<u4"), 0, self.states[i], int(self.tokens[i]))
        if zlib.crc32(ids.astype("<u4").tobytes()) != int(self.crc[i]):
            raise ValueError(f"segment {i} is damaged")
        return ids

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from place ``first`` of the file on: only their segments are read."""
        lo, hi = int(np.searchsorted(self.first, first, "right")) - 1, int(np.searchsorted(self.first, first + n, "left"))
        got = [self.segment(i) for i in range(max(lo, 0), hi)]
        return np.concatenate(got)[first - int(self.first[lo]) :][:n] if n else np.zeros(0, U32)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the document, its ids) in order; holds a segment and one document."""
        held: list[np.ndarray] = []
        size, at = 0, 0
        for i, n in enumerate(self.doc_tokens.tolist()):
            while size < n:
                held.append(self.segment(at))
                size, at = size + len(held[-1]), at + 1
            every = np.concatenate(held) if len(held) != 1 else held[0]
            yield i, every[:n]
            held, size = [every[n:]], size - n


# ---------------------------------------------------------------- Spark

FILES_SCHEMA = "part int, file string, base long, tokens long, docs long, bytes long"


def token_rows(documents: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, seq, n, ids): whole texts' ids with ``end`` behind them, as little-endian uint16 (uint32 where the
    vocabulary needs it); ``seq`` tells rows of one id apart."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens(tokenizer)
        wide = "<u2" if words.whole.get_vocab_size() <= 1 << 16 else "<u4"
        give_back()
        seq = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), 1 << 19):
                flat, begins = words.encode(data, offsets, end)
                width = np.dtype(wide).itemsize
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((begins * width).astype(np.int64).tobytes()), pa.py_buffer(flat.astype(wide).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.arange(seq, seq + hi - lo)), pa.array(np.diff(begins)), ids], names=["id", "seq", "n", "ids"])
                seq += hi - lo

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text).mapInArrow(released(task), f"id {kind}, seq long, n long, ids binary")


def _ids(column: pa.Array, sizes: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each row, of two or four bytes."""
    for data, n in zip(column, sizes.to_pylist(), strict=True):
        yield np.frombuffer(data.as_buffer(), "<u2" if len(data.as_buffer()) == 2 * n else "<u4")


def token_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each of ``size`` ids occurs in all documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in _ids(batch.column(0), batch.column(1)):
                total += np.bincount(ids, minlength=size) if len(ids) > size >> 3 else 0
                if len(ids) <= size >> 3:
                    np.add.at(total, ids, 1)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["token", "n"])

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids", "n").mapInArrow(task, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # a row an id of the vocabulary
        out[r.token] = r.n
    return out


def write_store(documents: DataFrame, folder: str, scratch: Scratch, tokenizer: str | None = None, end: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the table and the files under ``folder`` (a URI of a store that all executors reach); returns
    (part, file, base, tokens, docs, bytes) of each file, ``base`` being the tokens in files before it. Names
    carry the task attempt, so what a lost task wrote is never named."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    tokens = scratch.table(token_rows(documents, path, end, id_col, text), "tokens", size=F.sum(F.octet_length("ids")))
    counts = token_counts(tokens, WordTokens(path).whole.get_vocab_size())
    table = frequencies(counts)
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/table.bin", compression=None) as f:
        f.write(zlib.compress(table.astype("<u4").tobytes(), 6))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        writer, name, part = None, "", TaskContext.get().partitionId()
        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), _ids(batch.column(1), batch.column(2)), strict=True):
                if writer is None:
                    name = f"part-{part:05d}-{TaskContext.get().taskAttemptId()}.rans"
                    writer = StoreWriter(store.open_output_stream(f"{at}/{name}", compression=None), Coder(table))
                writer.add(i, ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), *(pa.array([x], pa.int64()) for x in (writer.tokens, len(writer.parts["doc_id"]), writer.at))], names=["part", "file", "tokens", "docs", "bytes"])

    ordered = tokens.select("id", "ids", "n", "seq").repartitionByRange(shuffle_partitions(scratch.spark), F.asc_nulls_first("id"), "seq").sortWithinPartitions(F.asc_nulls_first("id"), "seq")
    files = scratch.table(ordered.mapInArrow(task, "part int, file string, tokens long, docs long, bytes long"), "files")
    scratch.drop("tokens")
    base, rows = 0, []
    for r in sorted(files.collect(), key=lambda r: r.part):  # a row a file
        rows.append((r.part, r.file, base, r.tokens, r.docs, r.bytes))
        base += r.tokens
    return scratch.spark.createDataFrame(rows, FILES_SCHEMA)


def read_table(folder: str) -> Coder:
    store, at = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{at}/table.bin", compression=None) as f:
        return Coder(np.frombuffer(zlib.decompress(f.read()), "<u4"))


def read_store(files: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of the files, decoded and checked."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, (store, at) = read_table(folder), fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{at}/{name}") as f:
                    reader = StoreReader(f, coder)
                    crc, held, size, first = [], [], 0, 0
                    starts = base + np.cumsum(reader.doc_tokens) - reader.doc_tokens
                    for i, got in reader.documents():
                        crc.append(zlib.crc32(got.astype("<u4").tobytes()))
                        if ids:
                            held.append(got.astype(np.int64))
                        size += len(got)
                        if size > 1 << 18 or i + 1 == len(starts):
                            rows = slice(first, i + 1)
                            cols = [pa.array(reader.doc_id[rows], mask=reader.doc_null[rows].astype(bool)), pa.array(starts[rows]), pa.array(reader.doc_tokens[rows]), pa.array(crc, pa.int64())]
                            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                            if ids:
                                cols, names = [*cols, pa.array(held, pa.list_(pa.int64()))], [*names, "ids"]
                            yield pa.RecordBatch.from_arrays(cols, names=names)
                            crc, held, size, first = [], [], 0, i + 1

    dealt = files.select("file", "base").repartition(shuffle_partitions(files.sparkSession))
    return dealt.mapInArrow(released(task), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


# ---------------------------------------------------------------- query


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "token_store")
    folder = scratch.path("store")
    return read_store(write_store(docs, folder, scratch), folder)


QUERIES = {"op12_token_store": op12_token_store}
#: SQL has no tokenizer; tests/llm/test_token_store.py compares with the tokenizer's own ids.
ORACLE_SQL: dict[str, str] = {}
