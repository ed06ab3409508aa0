"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; after the frames a bundle holds a skippable
frame that maps record identifiers to (frame, offset in the frame, length) and, last, the seek table
of the public seekable format (sizes of every frame). A reader takes the footer, then only the
frames that it wants.

Records with equal payloads are stored once: the one with the smallest id is a ``response``, the
others are ``revisit`` records that refer to it. Which payloads repeat is found by an aggregation
over digests (partial sums before the shuffle, so a payload that a third of all pages share moves
one row a task), and pages meet their digest's first id in a broadcast of these digests where there
are few (measured), else in a join that Spark may split where one digest is hot.

Edge cases: a null payload counts as empty; a null id is written as ``null`` and read back as null,
is never the first of a group that has ids, and a group of null ids only holds responses; rows that
repeat the smallest id of a group are all responses; payloads under ``min_revisit_bytes`` are all
responses; an empty table gives an archive without bundles; other columns are not read."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, shuffle_partitions

# Fixed values of the seekable format and of the WARC format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Digests that repeat, of about 60 bytes, that are sent to every task.
MOST_BROADCAST = 500_000

INDEX_SCHEMA = "record_id string, bundle string, frame int, frame_offset long, length long"
RECORD_SCHEMA = "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"


# ---------------------------------------------------------------- one record


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit record (without payload) if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """What ``record_bytes`` wrote. The payload of a response is digested anew and compared."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    url = fields.get("WARC-Target-URI")
    url = None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    refers = fields.get("WARC-Refers-To")
    return {"record_id": fields["WARC-Record-ID"][1:-1], "record_type": fields["WARC-Type"], "url": url, "payload_bytes": size, "payload_digest": digest, "refers_to": refers and refers[1:-1], "payload": None if revisit else payload}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- one bundle


class BundleWriter:
    """Appends records to a stream, frame by frame; ``close`` writes the index and the seek table."""

    def __init__(self, out, frame_bytes: int, level: int):
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.held, self.size = [], 0
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.written = 0

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        if self.held:
            packed = self.pack.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self._frame()
        body = self.pack.compress(json.dumps(self.index).encode())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        self.frames.append((len(body) + 8, 0))
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads a bundle by its footer: ``index`` and single frames or records, never the whole file."""

    def __init__(self, file):
        self.file, size = file, file.size() if hasattr(file, "size") else len(file.getbuffer())
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        table = self._at(size - 9 - 8 * n, 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed
        self.unpack = zstandard.ZstdDecompressor()
        at, packed, _ = self.frames.pop()
        self.index = [tuple(x) for x in json.loads(self.unpack.decompress(self._at(at + 8, packed - 8)))]

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        return self.unpack.decompress(self._at(at, packed), max_output_size=plain)

    def records(self) -> Iterator[bytes]:
        held, plain = -1, b""
        for _, i, at, n in self.index:
            if i != held:
                held, plain = i, self.frame(i)
            yield plain[at : at + n]

    def record(self, record_id: str) -> bytes:
        _, i, at, n = next(x for x in self.index if x[0] == record_id)
        return self.frame(i)[at : at + n]


def open_bundle(folder: str, name: str):
    store, path = fs.FileSystem.from_uri(folder)
    return store.open_input_file(f"{path}/{name}")


# ---------------------------------------------------------------- Spark


def plan_records(pages: DataFrame, id_col: str, url: str, payload: str, min_revisit_bytes: int) -> DataFrame:
    """(id, url, payload, refers_to): refers_to is null for responses."""
    p = pages.select(F.col(id_col).alias("_id"), F.col(url).cast("string").alias("_url"), F.coalesce(F.col(payload), F.lit("")).alias("_payload"))
    p = p.withColumn("_digest", F.sha1(F.col("_payload").cast("binary")))
    size = F.octet_length("_payload")
    repeated = p.where(size >= min_revisit_bytes).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL").select("_digest", "_first")
    # Measured: digests that repeat are few enough to go to every task, so no payload moves; else a join
    # that can be split.
    repeated = Scratch(pages.sparkSession, "repeated").table(repeated, "digests")
    if repeated.count() <= MOST_BROADCAST:
        repeated = F.broadcast(repeated)
    revisit = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")) & (size >= min_revisit_bytes)
    return p.join(repeated, "_digest", "left").select("_id", "_url", "_payload", F.when(revisit, F.col("_first")).alias("_refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 64 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the bundles under ``folder`` (a URI of a store that all executors reach) and return the
    index of what was written, a row for each record. The names carry the task attempt, so a lost
    or repeated task leaves files that no index row names. The index is lazy: whoever runs it writes
    the bundles; run it once, into a table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        ctx = TaskContext.get()
        writer, name, n = None, "", 0
        for batch in batches:
            out = []
            for i, u, body, refers in zip(*(c.to_pylist() for c in batch.columns[:2]), _binary(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if writer is None:
                    name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{n:04d}.warc.zst"
                    writer, n = BundleWriter(store.open_output_stream(f"{path}/{name}", compression=None), frame_bytes, level), n + 1
                rid = _record_id(i)
                data = record_bytes(rid, u, body, sha1_base32(body), None if refers is None else _record_id(refers), date)
                writer.add(rid, data)
                out.append((rid, name, *writer.index[-1][1:]))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["record_id", "bundle", "frame", "frame_offset", "length"])
        if writer is not None:
            writer.close()

    return plan_records(pages, id_col, url, payload, min_revisit_bytes).mapInArrow(task, INDEX_SCHEMA)


def _binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _record_id(i) -> str:
    return f"urn:page:{'null' if i is None else i}"


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that the index names. Bundles are dealt to tasks; a task holds a
    frame at a time."""
    spark = index.sparkSession
    names = index.select("bundle").distinct()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open_bundle(folder, name) as f:
                    reader = BundleReader(f)
                    held, size = [], 0
                    for data in reader.records():
                        x = parse_record(data)
                        if not payloads:
                            x["payload"] = None
                        held.append(x)
                        size += len(data)
                        if size > 4 << 20 or len(held) >= 10_000:
                            yield _records(held)
                            held, size = [], 0
                    if held:
                        yield _records(held)

    return names.repartition(shuffle_partitions(spark)).mapInArrow(task, RECORD_SCHEMA)


def _records(held: list[dict]) -> pa.RecordBatch:
    kinds = {"record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in kinds.items()], names=list(kinds))


def fetch_records(index: DataFrame, folder: str, record_ids: DataFrame) -> DataFrame:
    """The records whose ids are in ``record_ids`` (column record_id): only their frames are read."""
    wanted = index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, frame, at, n in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "frame_offset", "length")), strict=True):
                with open_bundle(folder, name) as f:
                    out.append(parse_record(BundleReader(f).frame(frame)[at : at + n]))
            if out:
                yield _records(out)

    return wanted.mapInArrow(task, RECORD_SCHEMA)


# ---------------------------------------------------------------- query and SQL


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    index = scratch.table(write_archives(pages, folder), "index")
    page = lambda c: F.when(F.col(c) != "urn:page:null", F.regexp_extract(c, "urn:page:(.*)", 1)).try_cast("long")
    return read_archives(index, folder, payloads=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def _base32_sql(hexa: str) -> str:
    part = lambda j, shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr({hexa}, {5 * j + 1}, 5) AS INTEGER) >> {shift}) & 31) + 1, 1)"
    return " || ".join(part(j, s) for j in range(8) for s in (15, 10, 5, 0))


_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hexa FROM pages),
g AS (SELECT hexa, min(page_id) AS first_id, count(*) AS n FROM p GROUP BY hexa)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_base32_sql("hexa")} AS payload_digest,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN g USING (hexa)"""

QUERIES = {"op2_warc": op2_warc}
ORACLE_SQL = {"op2_warc": _SQL}
