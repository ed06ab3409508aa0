"""Column functions over k-mers as base-4 digit strings (A=0, C=1, T=2, G=3): string order is the
numeric order and the complement of a digit d is d XOR 2, for any k. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a piece of a read, without what it shares with the next.
PIECE = 128
LETTERS, DIGITS, COMPLEMENT = "ACTG", "0123", "2301"


def clean_digits(seq: Column) -> Column:
    """Digits of the letters ACGT of a text; everything else is dropped (case does not matter)."""
    return F.translate(F.upper(F.regexp_replace(seq, "[^ACGTacgt]+", "")), LETTERS, DIGITS)


def digits(seq: Column) -> Column:
    """Digits of a read; letters other than ACGT stay, upper-cased, and make k-mers invalid."""
    return F.translate(F.upper(seq), LETTERS, DIGITS)


def letters(d: Column) -> Column:
    return F.translate(d, DIGITS, LETTERS)


def complement_digits(d: Column) -> Column:
    return F.translate(d, DIGITS, COMPLEMENT)


def revcomp(d: Column) -> Column:
    """Reverse complement of a digit string."""
    return F.reverse(complement_digits(d))


def revcomp_letters(seq: Column) -> Column:
    """Reverse complement of letters, keeping their case; other letters become X."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "X"), "ACGTacgt", "TGCAtgca"))


def canonical(d: Column) -> Column:
    return F.least(d, revcomp(d))


def strand(d: Column) -> Column:
    """1 where the k-mer itself is canonical, 2 where its reverse complement is."""
    return F.when(d <= revcomp(d), 1).otherwise(2)


def is_valid(d: Column) -> Column:
    return d.rlike("^[0-3]+$")


def is_palindrome(d: Column) -> Column:
    return d == revcomp(d)


def kmer_at(d: Column, index: Column | int, k: int) -> Column:
    """The k-mer at an offset from 0."""
    return F.substr(d, F.lit(index) + 1 if isinstance(index, int) else index + 1, F.lit(k))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever and however often the body names it: the
    variable of a lambda over an array of one. Expressions that a lambda names from outside are
    computed again for every element."""
    return F.transform(F.array(value), body)[0]


def pieces(d: Column, k: int, step: int = 1) -> Column:
    """A text cut into pieces of bounded length that overlap in k - 1 letters: each k-mer (of every
    ``step``) is in one piece. The cut is linear in the text, and what is done inside of pieces does
    not depend on its length."""
    size = -(-max(PIECE, k) // step) * step
    whole = F.regexp_extract_all(d, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    with_next = lambda c: F.transform(c, lambda x, i: F.concat(x, F.coalesce(F.substr(F.get(c, i + 1), F.lit(1), F.lit(k - 1)), F.lit(""))))
    return F.filter(let(whole, with_next), lambda x: F.length(x) >= k)


def _inside(d: Column, k: int, step: int, at: Callable[[Column, Column], Column]) -> Column:
    """Array over all k-mers of a text: ``at(piece, start)``, start from 1."""
    starts = lambda p: F.sequence(F.lit(1), F.length(p) - k + 1, F.lit(step))
    out = F.flatten(F.transform(pieces(d, k, step), lambda p: F.transform(starts(p), lambda i: at(p, i))))
    return F.coalesce(out, F.array().cast("array<string>"))


def kmers(d: Column, k: int, step: int = 1) -> Column:
    """Array of the k-mers of a read from left to right, empty for reads shorter than k."""
    return _inside(d, k, step, lambda p, i: F.substr(p, i, F.lit(k)))


def canonical_kmers(d: Column, k: int) -> Column:
    """Array of canonical k-mers. The reverse complement is taken once a piece: the k-mer at i is the
    mirror of that at length - k - i of the reversed piece."""
    both = lambda p: F.struct(p.alias("p"), revcomp(p).alias("rc"), F.length(p).alias("n"))
    pair = lambda v, i: F.least(F.substr(v.p, i, F.lit(k)), F.substr(v.rc, v.n - i - k + 2, F.lit(k)))
    one = lambda v: F.transform(F.sequence(F.lit(1), v.n - k + 1), lambda i: pair(v, i))
    out = F.flatten(F.transform(F.transform(pieces(d, k), both), one))
    return F.coalesce(out, F.array().cast("array<string>"))


def valid_windows(d: Column, k: int) -> Column:
    """Number of the k-mers of a read without a letter other than ACGT."""
    runs = F.split(d, "[^0-3]+")
    return F.coalesce(F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, x: n + F.greatest(F.length(x) - k + 1, F.lit(0))), F.lit(0).cast("bigint"))


def nucleotide(d: Column, i: int) -> Column:
    """Digit i from the right."""
    return F.substr(d, F.lit(-(i + 1)), F.lit(1))


def append_right(d: Column, nt: Column) -> Column:
    """The next k-mer after one more nucleotide on the right."""
    return F.concat(F.substr(d, F.lit(2)), nt)


def append_left(d: Column, nt: Column, k: int) -> Column:
    return F.concat(nt, F.substr(d, F.lit(1), F.lit(k - 1)))


def neighbours(d: Column, k: int) -> Column:
    """The eight one-base extensions as structs (direction, nt, kmer), canonical: 1 right, 2 left."""
    out = []
    for nt in DIGITS:
        out.append(F.struct(F.lit(1).alias("direction"), F.lit(nt).alias("nt"), canonical(append_right(d, F.lit(nt))).alias("kmer")))
        out.append(F.struct(F.lit(2).alias("direction"), F.lit(nt).alias("nt"), canonical(append_left(d, F.lit(nt), k)).alias("kmer")))
    return F.array(*out)


def value(d: Column) -> Column:
    """The number that a k-mer of k <= 31 stands for."""
    return F.conv(d, 4, 10).cast("bigint")
