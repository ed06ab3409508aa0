"""k-mers packed into 64-bit integers, two bits a letter: one word up to k = 31, two words (the first k - 31 letters
and the last 31) up to k = 62, three up to k = 93. The order of the numbers is that of the digit strings.

A read becomes k-mers in one pass: windows of 1, 2, 4, ... letters are put together from two halves each, for
both strands at once, so a window of k letters takes 2 * log2(k) operations on arrays, whatever k is, and
work is linear in the read. Columns of packed k-mers are ``w0`` and, for k > 31, ``w1``, for k > 62, ``w2``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a word; letters worked on at once.
WORD, BLOCK = 31, 1 << 20

_DIGIT = np.full(256, 4, np.uint8)
_DIGIT[48:52] = range(4)


def words(k: int) -> list[str]:
    """Names of the columns of a packed k-mer."""
    if k > 2 * WORD:
        raise ValueError(f"k-mers are packed up to k = {2 * WORD}")
    return columns(k)


#: Letters that packed rows and counts can have.
MOST = 3 * WORD


def columns(k: int) -> list[str]:
    """As ``words``, up to three."""
    if k > MOST:
        raise ValueError(f"packed rows have up to {MOST} letters")
    return [f"w{i}" for i in range(-(-k // WORD))]


# ---------------------------------------------------------------- reads to words


def _windows(codes: np.ndarray, sizes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{size: (words of all windows, words of their reverse complements)}."""
    one = codes.astype(np.int64)
    power = {1: (one, one ^ 2)}
    join = lambda a, b, n, m: (a[0][: len(b[0]) - n] << 2 * m | b[0][n:], b[1][n:] << 2 * n | a[1][: len(b[1]) - n])
    size = 1
    while 2 * size <= max(sizes):
        power[2 * size] = join(power[size], power[size], size, size)
        size *= 2
    out = {}
    for k in sizes:
        made, n = None, 0
        for p in sorted(power, reverse=True):
            if k & p:
                made = power[p] if made is None else join(made, power[p], n, p)
                n += p
        out[k] = made
    return out


def packed_windows(codes: np.ndarray, k: int, canon: bool = True) -> list[np.ndarray]:
    """Words of every window of ``k`` digits, of the smaller strand if ``canon``."""
    if k <= WORD:
        ((f, r),) = _windows(codes, [k]).values()
        return [np.minimum(f, r) if canon else f]
    n, m = len(codes) - k + 1, -(-k // WORD)
    first = k - WORD * (m - 1)
    w = _windows(codes, sorted({first, WORD}))
    size = lambda i: WORD if i else first
    f = [w[size(i)][0][first + WORD * (i - 1) if i else 0 :][:n] for i in range(m)]
    if not canon:
        return f
    r = [w[size(i)][1][k - first - WORD * i :][:n] for i in range(m)]
    less, same = np.zeros(n, bool), np.ones(n, bool)
    for a, b in zip(f, r, strict=True):
        less |= same & (a < b)
        same &= a == b
    return [np.where(less, a, b) for a, b in zip(f, r, strict=True)]


def read_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(digits, windows) of blocks of reads, the only column: digits one after the other (4 where none), and where a
    valid window of ``k`` begins inside of one read."""
    for batch in batches:
        text = batch.column(0).fill_null("")
        wide = pa.types.is_large_string(text.type)
        _, at, data = text.buffers()
        if not len(text) or data is None:
            continue
        ends = np.frombuffer(at, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        codes = _DIGIT[np.frombuffer(data, np.uint8)[: ends[-1]]]
        for a in range(int(ends[0]), int(ends[-1]) - k + 1, BLOCK):
            part = codes[a : a + BLOCK + k - 1]
            n = len(part) - k + 1
            if n < 1:
                break
            bad = np.concatenate([[0], np.cumsum(part > 3)])
            row = np.searchsorted(ends, np.arange(a, a + n), "right") - 1
            yield part, np.flatnonzero((bad[k:] == bad[:-k]) & (np.arange(a, a + n) + k <= ends[row + 1]))


def packed_rows(reads: DataFrame, k: int, keep: tuple[str, ...] = (), d: str = "d", canon: bool = True, pos: str | None = None) -> DataFrame:
    """(keep, [pos,] w0[, w1, w2]): a row for each valid k-mer of a read, in the order of the read. Null reads have none.
    ``pos`` names the k-mer's place in its read, from 0."""
    names = columns(k)
    place = [pos] if pos else []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(keep)).fill_null("")
            wide = pa.types.is_large_string(text.type)
            _, at, data = text.buffers()
            if not len(text) or data is None:
                continue
            ends = np.frombuffer(at, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            codes = _DIGIT[np.frombuffer(data, np.uint8)[: ends[-1]]]
            for a in range(int(ends[0]), int(ends[-1]) - k + 1, BLOCK):
                part = codes[a : a + BLOCK + k - 1]
                n = len(part) - k + 1
                if n < 1:
                    break
                bad = np.concatenate([[0], np.cumsum(part > 3)])
                row = np.searchsorted(ends, np.arange(a, a + n), "right") - 1
                good = np.flatnonzero((bad[k:] == bad[:-k]) & (np.arange(a, a + n) + k <= ends[row + 1]))
                made = [pa.array(a + good - ends[row[good]])] if pos else []
                made += [pa.array(w[good]) for w in packed_windows(part & 3, k, canon)]
                for i in range(0, len(good), 1 << 16):
                    s = slice(i, i + (1 << 16))
                    which = pa.array(row[good[s]])
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).take(which) for j in range(len(keep))), *(w[s] for w in made)], names=[*keep, *place, *names])

    shape = ", ".join([*(f"`{c}` {reads.schema[c].dataType.simpleString()}" for c in keep), *(f"{w} bigint" for w in (*place, *names))])
    return reads.select(*keep, d).mapInArrow(task, shape)


#: k-mers of a task that are counted at once, before they are shuffled.
TALLY = 1 << 22


def packed_tallies(reads: DataFrame, k: int, d: str = "d", canon: bool = True, tally: int = TALLY) -> DataFrame:
    """(w0, n): k-mers of one word, of which a task adds up about ``tally`` at a time; a k-mer can be in several rows."""
    if k > WORD:
        raise ValueError("k-mers of one word are added up")

    def counted(words: np.ndarray) -> Iterator[pa.RecordBatch]:
        words.sort()
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        n = np.diff(np.append(first, len(words)))
        for i in range(0, len(first), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(words[first[s]]), pa.array(n[s])], names=["w0", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part, good in read_blocks(batches, k):
            held.append(packed_windows(part & 3, k, canon)[0][good])
            size += len(good)
            if size >= tally:
                yield from counted(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from counted(np.concatenate(held))

    return reads.select(d).mapInArrow(task, "w0 bigint, n bigint")


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (w0, n) in the order of w0, one row (w0, abundance) each. Only the last word is held between batches."""
    word, more = None, 0
    row = lambda w, n: pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(n, pa.int64())], names=["w0", "abundance"])
    for batch in batches:
        if not batch.num_rows:
            continue
        w, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        w, n = w[first], np.add.reduceat(n, first)
        if word is not None:
            if w[0] == word:
                n[0] += more
            else:
                yield row([word], [more])
        word, more = int(w[-1]), int(n[-1])
        if len(w) > 1:
            yield row(w[:-1], n[:-1])
    if word is not None:
        yield row([word], [more])


# ---------------------------------------------------------------- words as columns


def unpacked(k: int) -> Column:
    """The digit string of columns w0, w1, w2."""
    text = lambda c, n: F.lpad(F.conv(F.col(c).cast("string"), 10, 4), n, "0")
    names = columns(k)
    return text("w0", k) if k <= WORD else F.concat(text("w0", k - WORD * (len(names) - 1)), *[text(c, WORD) for c in names[1:]])


def packed(d: Column, k: int) -> Column:
    """The word of digit strings of k <= 31 letters."""
    if k > WORD:
        raise ValueError("one word has 31 letters")
    return F.conv(d, 4, 10).cast("bigint")


def revcomp_word(w: Column, k: int) -> Column:
    """Reverse complement of a word of ``k`` letters: complemented letters change places two by two, four by four,
    and so on."""
    x = w.bitwiseXOR(F.lit(0xAAAAAAAAAAAAAAAA - (1 << 64)).cast("bigint"))
    for n, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = F.lit(mask).cast("bigint")
        x = F.shiftrightunsigned(x, n).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), n))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def prefix_word(w: Column) -> Column:
    """A word without its last letter."""
    return F.shiftright(w, 2)


def suffix_word(w: Column, k: int) -> Column:
    """A word of ``k`` letters without its first."""
    return w.bitwiseAND(F.lit((1 << 2 * (k - 1)) - 1).cast("bigint"))
