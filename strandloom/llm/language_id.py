"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the
longest phrases that the automaton knows; the language whose automaton needs the fewest bits a
letter (phrases times the logarithm of the automaton's text length) wins.

Training takes a bounded sample of whole labelled texts: ``docs_per_language`` of each language at
most, with ``chars_per_language`` characters together, and ``max_languages`` languages at most (more
are an error). Letters are folded to ``symbols`` classes, and runs of anything else are one
separator. Whole texts are parsed, all texts of a run in step.

Edge cases: a null text, or one without letters, is ``und`` with score 0; a null label or a null text
is not learned from; ties go to the language that sorts first; without any label every text with
letters is ``und`` too; an empty table gives no rows; a very long text is parsed whole, by itself, in
about 50 bytes of memory for each of its letters; repeated rows each give a row; a null id counts as not held out and is not
learned from."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, released, text_chunks

UNDETERMINED = "und"
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _LETTER[0]


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class SuffixAutomaton:
    """All substrings of one symbol sequence, as transitions from state to state."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _new(self, moves: dict[int, int], link: int, longest: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        state = self._new({}, 0, self.longest[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.longest[q] == self.longest[p] + 1:
                self.link[state] = q
            else:
                copy = self._new(dict(self.next[q]), self.link[q], self.longest[p] + 1)
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = copy
                    p = self.link[p]
                self.link[q] = self.link[state] = copy
        return state


class LanguageModel:
    """Automata of all languages in one transition table; small enough to broadcast, as its size
    follows from the training bounds alone."""

    def __init__(self, samples: dict[str, list[str]], symbols: int = 48, block: int = 256):
        self.languages, self.symbols, self.block = sorted(samples), symbols, block
        self._classes = None
        own = max(symbols - 10, 1)
        points = code_points([t.lower() for lang in self.languages for t in samples[lang]])
        points = points[letters()[points]]
        seen, counts = np.unique(points, return_counts=True)
        self.common = np.sort(seen[np.lexsort((seen, -counts))][:own])
        self.tables, self.bits = [], []
        for lang in self.languages:
            stream = np.concatenate([np.zeros(1, np.int64), *(np.append(self.fold([t])[0], 0) for t in samples[lang])])
            automaton = SuffixAutomaton([int(x) for x in stream])
            table = np.full((len(automaton.next), symbols), -1, dtype=np.int32)
            for s, moves in enumerate(automaton.next):
                for c, to in moves.items():
                    table[s, c] = to * symbols
            self.tables.append(table.ravel())
            self.bits.append(float(np.log2(max(len(stream), 2))))

    def classes(self) -> np.ndarray:
        """Symbol of each code point: 0 for what is no letter, 1.. for common letters, the last ones
        for the rest."""
        if self._classes is None:
            n = sys.maxunicode + 1
            rest = self.symbols - 1 - len(self.common)
            out = (1 + len(self.common) + np.arange(n) % max(rest, 1)).astype(np.int16)
            out[self.common] = 1 + np.arange(len(self.common))
            out[~letters()] = 0
            self._classes = out
        return self._classes

    def __getstate__(self):
        return self.__dict__ | {"_classes": None}  # each worker makes its own

    def fold(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts one after the other, text of each symbol), separators merged."""
        lowered = [t.lower() for t in texts]
        sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
        sym = self.classes()[code_points(lowered)]
        doc = np.repeat(np.arange(len(texts)), sizes)
        keep = np.ones(len(sym), dtype=bool)
        keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (doc[1:] != doc[:-1])
        return sym[keep].astype(np.int64), doc[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases [language, text], symbols of each text, letters of each text). The greedy parse of
        whole texts: longest match after longest match, from the first symbol to the last.

        Blocks of all texts are parsed in step, as if a phrase began with each. A block's parse then
        is done again from where the block before it ends, until it is in the same state as the first
        one at the same symbol: from there on both are the same. So blocks change nothing."""
        sym, doc = self.fold(texts)
        n, size = len(texts), self.block
        lengths = np.bincount(doc, minlength=n)
        n_letters = np.bincount(doc[sym != 0], minlength=n)
        blocks = -(-lengths // size)
        first = np.concatenate([[0], np.cumsum(blocks)])
        at = np.arange(len(sym)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
        total = int(first[-1])
        # The last block of a text may be short: longer blocks first, so those that go on are a prefix.
        block_sizes = np.full(total, size)
        block_sizes[first[1:][blocks > 0] - 1] = lengths[blocks > 0] - (blocks[blocks > 0] - 1) * size
        order = np.argsort(-block_sizes, kind="stable")
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        grid = np.zeros((size, total), dtype=np.int16)
        grid[at % size, place[first[doc] + at // size]] = sym
        alive = np.searchsorted(-block_sizes[order], -np.arange(size), "left")  # blocks with more symbols than that
        owner = np.repeat(np.arange(n), blocks)
        later = np.ones(total, dtype=bool)
        later[first[:-1][blocks > 0]] = False
        later = np.flatnonzero(later)
        here, before = place[later], place[later - 1]
        out = np.zeros((len(self.languages), n), dtype=np.int64)
        for k, table in enumerate(self.tables):
            root = np.maximum(table[: self.symbols], 0)
            states = np.zeros((size, total), dtype=np.int32)
            misses = np.zeros((size, total), dtype=bool)
            state = np.zeros(total, dtype=np.int32)
            for i, m in enumerate(alive):
                if not m:
                    break
                c = grid[i, :m]
                to = table[state[:m] + c]
                misses[i, :m] = to < 0
                state[:m] = states[i, :m] = np.where(to < 0, root[c], to)
            count = misses.sum(axis=0, dtype=np.int64)
            todo, source = here, before
            start = np.zeros(total, dtype=np.int32)  # what each block was begun from
            while len(todo):
                begun = state[source]
                new = np.flatnonzero(begun != start[todo])
                todo, source, begun = todo[new], source[new], begun[new]
                if not len(todo):
                    break
                start[todo] = begun
                open_, now = np.arange(len(todo)), begun.copy()
                for i in range(size):
                    open_ = open_[alive[i] > todo[open_]]
                    if not len(open_):
                        break
                    b = todo[open_]
                    c = grid[i, b]
                    to = table[now[open_] + c]
                    miss = to < 0
                    to = np.where(miss, root[c], to)
                    count[b] += miss.astype(np.int64) - misses[i, b]
                    same = states[i, b] == to
                    now[open_] = states[i, b] = to
                    misses[i, b] = miss
                    if i + 1 == size:
                        state[b] = to
                    open_ = open_[~same]
                # a block that never met its first parse ends in another state: its successor is begun anew
                todo, source = here, before
            out[k] = np.bincount(owner, weights=count[place], minlength=n).astype(np.int64) + (lengths > 0)
        return out, lengths, n_letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        phrases, _, n_letters = self.phrases(texts)
        cost = phrases * np.array(self.bits)[:, None]
        best = np.argmin(cost, axis=0)
        odds = np.exp2(-(cost - cost.min(axis=0)) / np.array(self.bits).mean()).sum(axis=0)
        none = n_letters == 0
        langs = [UNDETERMINED if bad else self.languages[b] for b, bad in zip(best, none, strict=True)]
        return langs, np.where(none, 0.0, 1.0 / odds)


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def train(documents: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = 64, chars_per_language: int = 32_000, max_languages: int = 64, symbols: int = 48, block: int = 256) -> LanguageModel:
    """Learn from a bounded sample of the rows given: of each language whole texts, in the order of a
    hash of their ids, ``docs_per_language`` at most and as long as they are no more than
    ``chars_per_language`` characters together (a text of more than an eighth of that is passed over;
    where a language has none that is shorter, its shortest text is taken). Ranks are cut in
    each partition before the shuffle, so a language of most rows moves ``docs_per_language`` rows a
    partition."""
    bounded_batches(documents.sparkSession)
    rows = documents.where(F.col(id_col).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    size = F.length("t")
    w = Window.partitionBy("l").orderBy(F.when(size * 8 <= chars_per_language, 0).otherwise(size), "h", "t")
    picked = rows.withColumn("r", F.row_number().over(w)).where((F.col("r") <= docs_per_language) & ((size * 8 <= chars_per_language) | (F.col("r") == 1)))
    picked = picked.orderBy("l", "r").limit((max_languages + 1) * docs_per_language)
    samples: dict[str, list[str]] = {}
    for x in picked.collect():
        have = samples.setdefault(x.l, [])
        if not have or sum(map(len, have)) + len(x.t) <= chars_per_language:
            have.append(x.t)
    if len(samples) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    return LanguageModel({k: v for k, v in samples.items() if any(c.isalpha() for t in v for c in t)}, symbols, block)


def identify(documents: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of the input (all, unless given) with ``lang_pred`` and ``score`` (0 to
    1); they replace columns of the same names. Whole texts, about a megabyte at a time."""
    spark = documents.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)
    keep = [c for c in (keep if keep is not None else documents.columns) if c not in ("lang_pred", "score")]
    rest = documents.select(*keep, *([] if text in keep else [text]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            langs: list[str] = []
            scores = [np.zeros(0)]
            for lo, hi, _, _ in text_chunks(column):
                got, score = held.value.predict([x or "" for x in column.slice(lo, hi - lo).to_pylist()])
                langs += got
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = documents.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return rest.mapInArrow(released(task), schema)


# ---------------------------------------------------------------- query


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held_out))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return identify(rows, model, keep=["doc_id", "held_out"])


QUERIES = {"op5_language_id": op5_language_id}
ORACLE_SQL: dict[str, str] = {}
