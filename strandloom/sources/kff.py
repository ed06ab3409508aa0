"""k-mers and counts as files of the public KFF format (version 1): a header, a section of values (k,
data size, k-mers a block), raw sections of blocks of one k-mer, and the closing signature. Every task
writes files of its own under one folder, which may be read one by one or all together; a section
holds one batch, so a task holds a batch at a time."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandloom.functions.encoding import LETTERS

# Fixed values of the format.
SIGNATURE, VERSION = b"KFF", (1, 0)
DATA_SIZE = 4


def header() -> bytes:
    """Two bits a letter, in the order A, C, G, T; each k-mer once, in its canonical form."""
    a, c, g, t = (LETTERS.index(x) for x in "ACGT")
    return SIGNATURE + bytes([*VERSION, a << 6 | c << 4 | g << 2 | t, 1, 1]) + struct.pack(">I", 0)


def values(**named: int) -> bytes:
    return b"v" + struct.pack(">Q", len(named)) + b"".join(n.encode() + b"\0" + struct.pack(">Q", x) for n, x in named.items())


def packed(kmers: list[str], k: int) -> np.ndarray:
    """Digits as bytes, two bits each, zeros in front: [k-mer, byte]."""
    size = -(-2 * k // 8)
    digits = np.frombuffer("".join(kmers).encode(), np.uint8).reshape(len(kmers), k) - ord("0")
    wide = np.zeros((len(kmers), 4 * size), np.uint8)
    wide[:, 4 * size - k :] = digits
    return (wide.reshape(len(kmers), size, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2, dtype=np.uint8)


def unpacked(data: np.ndarray, k: int) -> list[str]:
    digits = ((data[:, :, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).reshape(len(data), -1)[:, -k:] + ord("0")
    return [bytes(x).decode() for x in digits]


def write_kff(counts: DataFrame, k: int, folder: str) -> DataFrame:
    """Write (kmer, abundance) under ``folder``, a URI that all executors reach. Lazy: whoever runs the
    result (file, kmers) writes the files; the names carry the attempt, so those of a lost or repeated
    task are not in the result."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        ctx, out, n = TaskContext.get(), None, 0
        name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}.kff"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(header() + values(k=k, max=1, data_size=DATA_SIZE))
            data = np.ascontiguousarray(batch.column(1).to_numpy().astype(">u4")).view(np.uint8).reshape(-1, DATA_SIZE)
            blocks = np.concatenate([packed(batch.column(0).to_pylist(), k), data], axis=1)
            out.write(b"r" + struct.pack(">Q", len(blocks)) + blocks.tobytes())
            n += len(blocks)
        if out is not None:
            out.write(SIGNATURE)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "kmers"])

    return counts.selectExpr("kmer", "CAST(abundance AS BIGINT) AS abundance").sortWithinPartitions("kmer").mapInArrow(task, "file string, kmers long")


def read_kff(files: DataFrame, folder: str) -> DataFrame:
    """(kmer, abundance) of the files (column file) under ``folder``; a section at a time."""

    def sections(data) -> Iterator[tuple[int, np.ndarray]]:
        if data.read(3) != SIGNATURE:
            raise ValueError("not a KFF file")
        free = struct.unpack(">I", data.read(9)[5:])[0]
        data.read(free)
        now: dict[str, int] = {}
        while (kind := data.read(1)) != b"K":
            n = struct.unpack(">Q", data.read(8))[0]
            if kind == b"v":
                for _ in range(n):
                    name = b"".join(iter(lambda: data.read(1), b"\0")).decode()
                    now[name] = struct.unpack(">Q", data.read(8))[0]
            elif kind == b"r" and now["max"] == 1:
                size = -(-2 * now["k"] // 8) + now["data_size"]
                yield now["k"], np.frombuffer(data.read(n * size), np.uint8).reshape(n, size)
            else:
                raise ValueError(f"section {kind!r} is not read")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as data:
                    for k, rows in sections(data):
                        counts = np.ascontiguousarray(rows[:, -DATA_SIZE:]).view(">u4").ravel().astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(unpacked(rows[:, :-DATA_SIZE], k)), pa.array(counts)], names=["kmer", "abundance"])

    return files.select("file").mapInArrow(task, "kmer string, abundance long")
