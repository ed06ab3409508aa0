"""FASTA and FASTQ as formats of the session: ``register(spark)``, then ``spark.read.format("fastq").load(path)`` and
``df.write.format("fastq").mode("append").save(path)``.

Reading. Files are planned as byte ranges of ``splitBytes`` (a gzip file is one range). A record belongs to the range
that holds its first byte, so each is parsed once, by one task. A FASTQ record has four lines; a line that begins with
``@`` begins a record if and only if the line two below begins with ``+`` (a quality line that begins with ``@`` has a
read there, and reads have no ``+``). FASTA records may have any number of lines. Rows are (read_id, comment, seq,
quality, bank_id, file); ``read_id`` is the file's number in the order of names, shifted, plus the record's first byte
(of a gzip file, of what is in it): it grows along the files, with gaps, and is the same in every run. Filters on
``file`` and ``read_id`` leave out files and ranges before they are opened.

Writing. Tasks write files of their own in a hidden folder; the commit moves those of the tasks that succeeded into
place and adds ``_SUCCESS``; an abort removes the folder. ``mode("overwrite")`` removes what was there at the commit.

Paths are those that pyarrow opens (a folder that all machines share, ``file:``, ``hdfs:``, ``s3:``): a file, a folder
(names that begin with ``_`` or ``.`` are left out), or several with commas between them.

Edge cases: an empty file and an empty folder have no rows; empty lines between records are skipped; a record that ends
with the file may lack its last newline; ``\\r`` at the end of a line goes; a FASTQ record whose quality is not as long
as its read, or that is cut, is an error that names the file and the byte. A null or empty comment is written as empty,
line breaks in it as spaces; a null read as empty; a null quality cannot be written to FASTQ unless ``quality`` gives a
letter to repeat. Other columns are left out."""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "read_id bigint, comment string, seq string, quality string, bank_id int, file string"
SHIFT = 44  # bits of a byte's place in a file
_ROWS = pa.schema([("read_id", pa.int64()), ("comment", pa.string()), ("seq", pa.string()), ("quality", pa.string()), ("bank_id", pa.int32()), ("file", pa.string())])


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, and let it hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Fasta)
    spark.dataSource.register(Fastq)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _listed(paths: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files, by name."""
    out = []
    for path in (p.strip() for p in paths.split(",") if p.strip()):
        files, at = _open(path)
        info = files.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        inside = files.get_file_info(pafs.FileSelector(at)) if info.type == pafs.FileType.Directory else [info]
        head = path[: len(path) - len(at)] if path.endswith(at) else ""
        out += [(head + f.path, f.size) for f in inside if f.type == pafs.FileType.File and f.base_name[0] not in "_."]
    return sorted(out)


@dataclass
class Range(InputPartition):
    """Records whose first byte is from ``start`` on and before ``end``, of the file ``number``."""

    path: str
    number: int
    start: int
    end: int

    def __post_init__(self):
        super().__init__((self.path, self.start))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, quality: bool):
        self.path, self.quality = options["path"], quality
        self.split, self.bank, self.batch = int(options.get("splitBytes", 128 << 20)), int(options.get("bankId", 0)), int(options.get("batchBytes", 4 << 20))
        self.files: set[str] | None = None
        self.low, self.high = 0, (1 << 63) - 1

    def pushFilters(self, filters):
        """Filters only leave out files and ranges; Spark evaluates all of them again."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("file",) and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = names if self.files is None else self.files & names
            elif column == ("read_id",) and f.__class__ in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[Range]:
        out = []
        for number, (path, size) in enumerate(_listed(self.path)):
            if self.files is not None and path not in self.files:
                continue
            whole = path.endswith(".gz")
            for start in [0] if whole else range(0, size, self.split):
                first, end = (number << SHIFT) + start, (1 << SHIFT) if whole else min(start + self.split, size)
                if first <= self.high and (number << SHIFT) + end > self.low:
                    out.append(Range(path, number, start, end))
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, at = _open(partition.path)
        with files.open_input_file(at) as raw:
            source = gzip.GzipFile(fileobj=raw) if at.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
            records = _fastq(source, partition) if self.quality else _fasta(source, partition)
            rows, held = [], 0
            for place, comment, seq, quality in records:
                rows.append((place + (partition.number << SHIFT), comment.decode(), seq.decode(), None if quality is None else quality.decode()))
                held += len(comment) + 2 * len(seq)
                if held >= self.batch:
                    yield self._rows(rows, partition.path)
                    rows, held = [], 0
            if rows:
                yield self._rows(rows, partition.path)

    def _rows(self, rows: list, path: str) -> pa.RecordBatch:
        ids, comments, seqs, qualities = zip(*rows, strict=True)
        columns = [ids, comments, seqs, qualities, [self.bank] * len(rows), [path] * len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ROWS, strict=True)], schema=_ROWS)


def _lines(source, start: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) from the first line that begins at ``start`` or after it."""
    place = start
    if start > 0:
        source.seek(start - 1)
        place = start - 1 + len(source.readline())
    while line := source.readline():
        yield place, line.rstrip(b"\r\n")
        place += len(line)


def _fastq(source, part: Range) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    lines = _lines(source, part.start)
    window: list[tuple[int, bytes]] = []
    if part.start > 0:  # the first line that begins a record
        for x in lines:
            window.append(x)
            if len(window) == 3:
                if window[0][1][:1] == b"@" and window[2][1][:1] == b"+":
                    break
                window.pop(0)
        if len(window) < 3 or window[0][1][:1] != b"@" or window[2][1][:1] != b"+":
            return
    while True:
        while not window:
            x = next(lines, None)
            if x is None:
                return
            if x[1]:
                window.append(x)
        if window[0][0] >= part.end:
            return
        while len(window) < 4:
            x = next(lines, None)
            if x is None:
                break
            window.append(x)
        place, head = window[0]
        texts = [w for _, w in window[1:]]
        if len(texts) == 2 and not texts[0]:
            texts.append(b"")  # an empty read at the end of a file without its last newline
        if head[:1] != b"@" or len(texts) < 3 or texts[1][:1] != b"+" or len(texts[0]) != len(texts[2]):
            raise ValueError(f"{part.path}: no whole FASTQ record of four lines at byte {place}")
        yield place, head[1:], texts[0], texts[2]
        window = []


def _fasta(source, part: Range) -> Iterator[tuple[int, bytes, bytes, None]]:
    place, head, parts = None, b"", []
    for at, line in _lines(source, part.start):
        if line[:1] == b">":
            if place is not None:
                yield place, head, b"".join(parts), None
            if at >= part.end:
                return
            place, head, parts = at, line[1:], []
        elif place is not None:
            parts.append(b"".join(line.split()))
        elif at >= part.end:
            return
    if place is not None:
        yield place, head, b"".join(parts), None


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool, quality: bool):
        self.path, self.overwrite, self.quality = options["path"], overwrite, quality
        self.gz, self.width, self.letter = options.get("compression", "none") == "gzip", int(options.get("lineWidth", 0)), options.get("quality")
        self.hidden = f"_tmp-{uuid.uuid4().hex}"
        self.columns = set(schema.fieldNames())
        if "seq" not in self.columns or (quality and "quality" not in self.columns and not self.letter):
            raise ValueError("a column seq is needed, and for FASTQ a column quality or the option quality")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, at = _open(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.{'fastq' if self.quality else 'fasta'}{'.gz' if self.gz else ''}"
        files.create_dir(f"{at}/{self.hidden}", recursive=True)
        n = 0
        with files.open_output_stream(f"{at}/{self.hidden}/{name}", compression=None) as raw:
            out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.gz else raw
            for batch in iterator:
                n += batch.num_rows
                out.write(self._text(batch).encode())
            if self.gz:
                out.close()
        return _Written(name if n else None)

    def _text(self, batch: pa.RecordBatch) -> str:
        column = lambda c: batch.column(c).to_pylist() if c in self.columns else [None] * batch.num_rows
        parts = []
        for comment, seq, quality in zip(column("comment"), column("seq"), column("quality"), strict=True):
            comment, seq = " ".join((comment or "").splitlines()), seq or ""
            if self.quality:
                quality = self.letter * len(seq) if quality is None and self.letter else quality
                if quality is None or len(quality) != len(seq):
                    raise ValueError(f"the quality of {comment!r} is not as long as its read")
                parts.append(f"@{comment}\n{seq}\n+\n{quality}\n")
            else:
                width = self.width or max(len(seq), 1)
                parts.append(f">{comment}\n" + "".join(f"{seq[i : i + width]}\n" for i in range(0, len(seq), width)))
        return "".join(parts)

    def commit(self, messages: list[_Written | None]) -> None:
        files, at = _open(self.path)
        files.create_dir(at, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(pafs.FileSelector(at)):
                if f.base_name != self.hidden:
                    (files.delete_dir if f.type == pafs.FileType.Directory else files.delete_file)(f.path)
        for m in messages:
            if m is not None and m.name:
                files.move(f"{at}/{self.hidden}/{m.name}", f"{at}/{self.hidden[5:13]}-{m.name}")
        self._clear(files, at)
        files.open_output_stream(f"{at}/_SUCCESS").close()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, files: pafs.FileSystem, at: str) -> None:
        if files.get_file_info(f"{at}/{self.hidden}").type == pafs.FileType.Directory:
            files.delete_dir(f"{at}/{self.hidden}")


class Fastq(DataSource):
    quality = True

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, self.quality)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema, overwrite, self.quality)


class Fasta(Fastq):
    quality = False

    @classmethod
    def name(cls) -> str:
        return "fasta"
