"""Alignment of two tokenizers' tokens by bytes, over a dictionary of groups.

A byte-level BPE (A) encodes a space and the text, a piece model (B) the text, before which it puts a space
of its own. Where the tokens of both spell these bytes, the byte offsets at which an A and a B token end
together cut both sequences into groups, and in each group the last tokens of both sides are linked.

Neither tokenizer joins what is left and right of a single space between two visible characters: A's
splitter begins a new part there, and no piece of B goes on behind a letter with its space mark (checked
when the model is read). So texts are cut there into segments, and a task tokenises each segment that it
meets once; the groups of a text are those of its segments. Segments are told apart by their bytes.

Groups are interned: a chunk of documents names its groups by numbers of its own and lists each distinct
group once with its frequency. Spark adds the chunks' lists up to the corpus' distinct groups, expands the
link of each once, multiplies by the frequency, and takes counts of id pairs and the highest of each B id.
The figures go back to the chunks' lists by a join on the group, and from there to the documents by the
chunk: no row for an occurrence is ever made or moved. A frequent group is a row a chunk, whatever its
share of the text.

Memory: a task holds one chunk (``chunk_bytes`` of text, or one longer text) and up to ``most`` known segments.

Edge cases: null or empty texts, and texts whose bytes one of the tokenizers does not give back (such as
one with U+2581, which B reads as a space) have no tokens: zeros and an empty string; white space of any
kind is text; special tokens' strings are plain text; repeated rows and ids are rows of their own, and count
as often as they are there; an empty table gives no rows; null ids are carried along; a very long text is
a chunk by itself; columns besides id and text are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm.common import Scratch, give_back, released, span_hashes, text_chunks

_CAPITAL = np.zeros(256, np.uint8)
_CAPITAL[65:91] = 1
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER_LEAD = np.zeros(256, bool)  # two-byte characters without white space among them
_LETTER_LEAD[0xC3:0xE0] = True
SPACE_MARK = "▁"


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(self.n + len(x), self.data.dtype)])
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.data[at]


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, text) of the segments of texts that do not share bytes: a text is cut before each
    single space between two visible characters (ASCII, or of two bytes in UTF-8)."""
    n = len(data)
    cut = data == 0x20
    if n < 3:
        cut[:] = False
    else:
        lead = _LETTER_LEAD[data]
        before = _VISIBLE[data]  # a visible character ends here
        before[1:] |= (data[1:] >= 0x80) & lead[:-1]
        after = _VISIBLE[data] | lead
        cut[0] = cut[-1] = False
        cut[1:-1] &= before[:-2] & after[2:]
    inner = offsets[1:-1][offsets[1:-1] < n]
    cut[inner - 1] = False  # a text's last byte has no character behind it
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[first] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(offsets, starts, "right") - 1


class Segments:
    """What is known of segments: their groups, by number, and the tokens of each side."""

    def __init__(self, a_path: str, b_path: str, most: int):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = {**{i: chr(i) for i in (*range(33, 127), *range(161, 173), *range(174, 256))}}
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        plain = {c: b for b, c in shown.items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(plain.__getitem__, token)) if all(c in plain for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError("a piece goes on over a space: texts cannot be cut there")
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.groups: dict[str, int] = {}
        self.keys: list[str] = []  # of groups
        self.texts: list[str] = []  # of segments: their groups' keys
        self.bytes = 0
        self.n_a, self.n_b, self.good, self.first, self.size, self.flat = (Grown(t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.uint32))

    def full(self) -> bool:
        return len(self.known) > self.most or self.bytes > self.most * 64

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each segment; new ones are tokenised."""
        hashes = span_hashes(data, starts, ends) * np.uint64(3) + span_hashes(_CAPITAL[data], starts, ends)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        parts = [raw[s:e] for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        found = list(map(self.known.get, parts))
        fresh = [i for i, x in enumerate(found) if x is None]
        if fresh:
            at = len(self.known)
            self.learn([parts[i] for i in fresh])
            for k, i in enumerate(fresh):
                found[i] = at + k
        return np.array(found, np.int64)[which]

    def learn(self, parts: list[bytes]) -> None:
        strings = [p.decode() for p in parts]
        a = [e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in strings], num_threads=1)
        good = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == p == b"".join(map(self.b_bytes.__getitem__, y)) for p, x, y in zip(parts, a, b, strict=True)], np.int64)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) * good for side in (a, b))
        a_ids, b_ids = (np.array([i for x, ok in zip(side, good.tolist(), strict=True) if ok for i in x], np.int64) for side in (a, b))
        # all good segments' bytes one after the other
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_to, b_to = np.searchsorted(a_end, cuts, "right").tolist(), np.searchsorted(b_end, cuts, "right").tolist()
        total = np.cumsum(np.array([len(p) for p in parts], np.int64) * good)
        n_groups = np.diff(np.searchsorted(cuts, total, "right"), prepend=0)
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        numbers, keys, p, q = [], [], 0, 0
        for i, j in zip(a_to, b_to, strict=True):
            key = f"{','.join(a_text[p:i])}|{','.join(b_text[q:j])}"
            p, q = i, j
            number = self.groups.setdefault(key, len(self.keys))
            if number == len(self.keys):
                self.keys.append(key)
                self.bytes += len(key)
            numbers.append(number)
            keys.append(key)
        ends = np.cumsum(n_groups)
        for s, e, part in zip((ends - n_groups).tolist(), ends.tolist(), parts, strict=True):
            self.texts.append(";".join(keys[s:e]))
            self.known[part] = len(self.known)
            self.bytes += len(part) + len(self.texts[-1])
        self.first.extend(self.flat.n + ends - n_groups)
        for held, x in ((self.n_a, n_a), (self.n_b, n_b), (self.good, good), (self.size, n_groups), (self.flat, np.array(numbers, np.uint32))):
            held.extend(x)


def _per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(text, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


# ---------------------------------------------------------------- Spark


def aligned_chunks(documents: DataFrame, a_path: str, b_path: str, id_col: str, text: str, chunk_bytes: int, most: int) -> DataFrame:
    """Two kinds of rows. Documents (``key`` null): chunk, id, n_a, n_b, n_groups, sha, groups (their numbers in
    the chunk, uint32). Dictionary rows: chunk, number, key (``a1,a2|b1``), n (occurrences in the chunk)."""
    kind = documents.schema[id_col].dataType.simpleString()
    shape = f"chunk long, id {kind}, n_a long, n_b long, n_groups long, sha string, groups binary, number int, key string, n long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Segments(a_path, b_path, most)
        give_back()
        chunk, size, held = TaskContext.get().partitionId() << 24, 0, []
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), 1 << 19):
                if known.full():
                    if held:
                        yield from _chunk_rows(known, chunk, held)
                        chunk, size, held = chunk + 1, 0, []
                    known.forget()
                held.append((batch.column(0).slice(lo, hi - lo), *_texts(known, data, offsets)))
                size += len(data)
                if size >= chunk_bytes:
                    yield from _chunk_rows(known, chunk, held)
                    chunk, size, held = chunk + 1, 0, []
        if held:
            yield from _chunk_rows(known, chunk, held)

    return documents.select(id_col, text).mapInArrow(released(task), shape)


def _texts(known: Segments, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_a, n_b, n_groups, sha of texts, and the numbers of their groups one after the other."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    room = (sizes > 0).astype(np.int64)  # for the space before
    spaced = np.full(len(data) + int(room.sum()), 0x20, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.cumsum(room), sizes)] = data
    offsets = np.concatenate([[0], np.cumsum(sizes + room)])
    starts, text = segments(spaced, offsets)
    which = known.numbers(spaced, starts, np.append(starts[1:], len(spaced)))
    good = _per_text(1 - known.good[which], text, n) == 0
    kept = good[text]
    which, text = which[kept], text[kept]
    n_a, n_b, n_groups = (_per_text(x[which], text, n) for x in (known.n_a, known.n_b, known.size))
    at = np.searchsorted(text, np.arange(n + 1)).tolist()
    parts = which.tolist()
    sha = [hashlib.sha256(";".join(map(known.texts.__getitem__, parts[a:b])).encode()).hexdigest() if b > a else "" for a, b in zip(at[:-1], at[1:], strict=True)]
    each, first = known.size[which], known.first[which]
    ends = np.cumsum(each)
    flat = known.flat[np.repeat(first - ends + each, each) + np.arange(int(ends[-1]) if len(ends) else 0)]
    return n_a, n_b, n_groups, np.array(sha, object), flat


def _chunk_rows(known: Segments, chunk: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    met = np.zeros(len(known.keys), np.int64)
    for *_, flat in held:
        met += np.bincount(flat, minlength=len(met))
    used = np.flatnonzero(met)
    number = np.zeros(len(met), np.uint32)
    number[used] = np.arange(len(used))
    names = ["chunk", "id", "n_a", "n_b", "n_groups", "sha", "groups", "number", "key", "n"]
    ids_type = held[0][0].type
    for ids, n_a, n_b, n_groups, sha, flat in held:
        n = len(ids)
        ends = np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int32) * 4
        groups = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(number[flat].astype("<u4").tobytes())])
        cols = [pa.array(np.full(n, chunk)), ids, *map(pa.array, (n_a, n_b, n_groups)), pa.array(sha, pa.string()), groups]
        yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=names)
    for at in range(0, len(used), 10_000):
        part = used[at : at + 10_000]
        n = len(part)
        empty = [pa.nulls(n, t) for t in (ids_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())]
        cols = [pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array([known.keys[i] for i in part.tolist()], pa.string()), pa.array(met[part])]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), *empty, *cols], names=names)


class Alignment:
    """``groups``: (key, n, a_end, b_end) of every distinct group; ``links``: (a_end, b_end, count, best) of every
    linked id pair, ``best`` where no other A id is linked more often to its B id; ``documents``: (id, n_a,
    n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""

    def __init__(self, groups: DataFrame, links: DataFrame, documents: DataFrame):
        self.groups, self.links, self.documents = groups, links, documents


def align(documents: DataFrame, scratch: Scratch, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = 4 << 20, most: int = 300_000) -> Alignment:
    """``a_path``: a byte-level BPE of the tokenizers library; ``b_path``: a sentencepiece model. The same files on
    every machine."""
    a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
    b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    chunks = scratch.table(aligned_chunks(documents, a_path, b_path, id_col, text, chunk_bytes, most), "chunks")
    listed = chunks.where("key IS NOT NULL").select("chunk", "number", "key", "n")
    last = lambda side: F.substring_index(F.substring_index("key", "|", side), ",", -1).cast("int")
    groups = scratch.table(listed.groupBy("key").agg(F.sum("n").alias("n")).select("key", "n", last(1).alias("a_end"), last(-1).alias("b_end")), "groups")
    pairs = groups.groupBy("a_end", "b_end").agg(F.sum("n").alias("count"))
    top = pairs.groupBy("b_end").agg(F.max("count").alias("top"))
    links = scratch.table(pairs.join(top, "b_end").select("a_end", "b_end", "count", (F.col("count") == F.col("top")).alias("best")), "links")
    figures = groups.join(links, ["a_end", "b_end"]).select("key", "count", "best")
    back = listed.select("chunk", "number", "key").join(figures, "key").select(F.col("chunk").alias("of"), "number", "count", F.col("best").cast("int").alias("best"))
    docs = chunks.where("key IS NULL").select("chunk", "id", "n_a", "n_b", "n_groups", "sha", "groups")
    kind = docs.schema["id"].dataType.simpleString()

    def sums(rows: pa.Table, lists: pa.Table) -> pa.Table:
        """A chunk's documents and its dictionary."""
        count, best = (np.zeros(lists.num_rows, np.int64) for _ in range(2))
        number = lists.column("number").to_numpy()
        count[number], best[number] = lists.column("count").to_numpy(), lists.column("best").to_numpy()
        n_best, total = [], []
        for data in rows.column("groups"):
            at = np.frombuffer(data.as_buffer(), "<u4")
            n_best.append(int(best[at].sum()))
            total.append(int(count[at].sum()))
        n = rows.column("n_groups")
        cols = [rows.column("id"), rows.column("n_a"), rows.column("n_b"), n, n, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), rows.column("sha")]
        return pa.table(cols, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = docs.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(sums, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return Alignment(groups, links, out)


# ---------------------------------------------------------------- query


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, Scratch(spark, "alignment")).documents.withColumnRenamed("id", "doc_id")


QUERIES = {"op11_alignment": op11_alignment}
#: SQL has no tokenizers; tests/llm/test_alignment.py aligns whole texts token by token.
ORACLE_SQL: dict[str, str] = {}
