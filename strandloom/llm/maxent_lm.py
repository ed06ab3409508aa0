"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is P(class | context) * P(member | class, context) * P(word | member). Classes
and members are softmaxes of 16 over weights that hashed features of the context look up: the word
before, the one before that (a skip), and both together. A member is one of the most frequent words
or all other words with the same two last letters (hashed); within a member words have their
smoothed share of its counts, and each member of many words keeps one share for words never seen.

Training is stochastic gradient ascent in large steps, distributed: in each round every task sums, over
its documents, how often features and outcomes met and how often the model expected them to; the sums
of all tasks make the gradient, and each weight moves by it, scaled by the expectation. Rounds take
disjoint shares of the documents: every document is used in one step, and one pass over the training
data is made in all. Counts of all training words stay in Spark; the
weights have a size set by parameters and are the only thing that is broadcast, with the counts of
the ``head`` most frequent words. Tokens outside of these meet their counts in a join.

Words are 64-bit hashes of ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z; each text ends with an end token.

Edge cases: a null or empty text is the end token alone; a null id is not held out; repeated rows
each give a row with the same scores; without training rows every count is zero; an empty table
gives no rows; a very long text is scored whole, by itself, in some 500 bytes of memory for each of its
words; columns besides id and text are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import U64, Scratch, mix, released, text_chunks, word_hashes
from strandloom.llm.language_id import fold_of

WIDE = 16  # outcomes of each softmax
LEAVES = WIDE * WIDE
HEADS = LEAVES // 2  # members that are one word; the end token is the first
END, START = U64(0x0E4D), U64(0x57A7)
_SALTS = [U64(0x9AE16A3B2F90404F), U64(0xC949D7C7509E6557), U64(0x8CB92BA72F3D8DD7)]
FEATURES = len(_SALTS)


@dataclass
class Shape:
    """Sizes of the hashed weights: 2**class_bits rows for classes, 2**member_bits for members."""

    class_bits: int = 13
    member_bits: int = 14

    @property
    def rows(self) -> int:
        return (1 << self.class_bits) + (1 << self.member_bits)


@dataclass
class Tokens:
    """The tokens of a run of texts, each text's end included."""

    words: np.ndarray
    tails: np.ndarray
    doc: np.ndarray
    before: np.ndarray
    before2: np.ndarray
    texts: int


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    words, doc, tails = word_hashes(data, offsets)
    texts = len(offsets) - 1
    counts = np.bincount(doc, minlength=texts)
    at = np.arange(len(words)) + doc
    out = np.full(len(words) + texts, END, dtype=U64)
    out[at] = np.maximum(words, U64(1 << 20))
    tail = np.zeros(len(out), dtype=U64)
    tail[at] = tails
    own = np.repeat(np.arange(texts), counts + 1)
    begins = np.cumsum(counts + 1) - counts - 1
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[begins] = START
    before2 = np.empty_like(out)
    before2[1:] = before[:-1]
    before2[begins] = START
    return Tokens(out, tail, own, before, before2, texts)


def own_leaf(tails: np.ndarray) -> np.ndarray:
    """Members of words that have none of their own."""
    return HEADS + (tails % U64(LEAVES - HEADS)).astype(np.int64)


@dataclass
class Model:
    """Everything that scoring needs in a task; its size does not depend on the corpus."""

    shape: Shape
    words: np.ndarray  # the most frequent words, sorted
    counts: np.ndarray
    leaves: np.ndarray  # of these words
    log_class: np.ndarray  # what softmaxes start from
    log_member: np.ndarray
    log_share: np.ndarray  # log10 of the counts of each member
    weights: np.ndarray

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        return at, self.words[at] == words if len(self.words) else np.zeros(len(words), bool)

    def leaf(self, t: Tokens) -> np.ndarray:
        at, hit = self.look_up(t.words)
        out = own_leaf(t.tails)
        out[t.words == END] = 0
        if hit.any():
            out[hit] = self.leaves[at[hit]]
        return out

    def rows_of(self, t: Tokens, cls: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows of weights that the features of each token hash to, for class and member."""
        contexts = (t.before, t.before2, t.before * U64(0xD6E8FEB86659FD93) + t.before2)
        class_rows, member_rows = [], []
        for context, salt in zip(contexts, _SALTS, strict=True):
            h = mix(context ^ salt)
            class_rows.append((h >> U64(64 - self.shape.class_bits)).astype(np.int32))
            h = mix(h + (cls + 1).astype(U64) * salt)
            member_rows.append((h >> U64(64 - self.shape.member_bits)).astype(np.int32) + np.int32(1 << self.shape.class_bits))
        return class_rows, member_rows

    def softmax(self, start: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        z = start + self.weights[rows[0]]
        for r in rows[1:]:
            z += self.weights[r]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def predict(self, t: Tokens) -> tuple[np.ndarray, ...]:
        """(leaf, rows of classes, P of each class, rows of members, P of each member)."""
        leaf = self.leaf(t)
        cls = leaf // WIDE
        class_rows, member_rows = self.rows_of(t, cls)
        return leaf, class_rows, self.softmax(self.log_class, class_rows), member_rows, self.softmax(self.log_member[cls], member_rows)


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Tokens]]:
    for lo, hi, data, offsets in text_chunks(batch.column(column), 1 << 20):
        yield lo, hi, tokens_of(data, offsets)


# ---------------------------------------------------------------- counts


def count_words(documents: DataFrame, text: str = "text", most: int = 1 << 21) -> DataFrame:
    """(h, leaf, c): every word of the texts and its count. Tasks add up about ``most`` tokens at a
    time before anything is shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tails, n = [], [], 0

        def flush() -> pa.RecordBatch:
            w = np.concatenate(words)
            h, first, c = np.unique(w, return_index=True, return_counts=True)
            leaf = np.where(h == END, 0, own_leaf(np.concatenate(tails)[first]))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(leaf.astype(np.int32)), pa.array(c.astype(np.int64))], names=["h", "leaf", "c"])

        for batch in batches:
            for _, _, t in _runs(batch, 0):
                words.append(t.words)
                tails.append(t.tails)
                n += len(t.words)
                if n > most:
                    yield flush()
                    words, tails, n = [], [], 0
        if n:
            yield flush()

    found = documents.select(text).mapInArrow(released(task), "h long, leaf int, c long")
    return found.groupBy("h").agg(F.min("leaf").alias("leaf"), F.sum("c").alias("c"))


def frequent(counts: DataFrame, head: int) -> list:
    """The most frequent words, ``head`` at most, by (falling count, hash). Counts are binned first (a few
    hundred rows), so only the words of the bins that fit come to the driver, whatever the number of
    partitions."""
    bins = counts.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 16).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("b")).collect()
    have, least = 0, None
    for x in bins:
        have += x.n
        if have > head:
            break
        least = x.least
    if least is None:
        return []
    return sorted(counts.where(F.col("c") >= least).collect(), key=lambda x: (-x.c, x.h))


def start_model(counts: DataFrame, head: int, shape: Shape) -> tuple[Model, int, int]:
    """(model without weights, all tokens, distinct tokens)."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = frequent(counts, head)
    words = np.array([x.h for x in top], dtype=np.int64).view(U64)
    leaves = np.array([x.leaf for x in top], dtype=np.int64)
    own = [i for i, w in enumerate(words) if w != END][: HEADS - 1]
    leaves[own] = 1 + np.arange(len(own))
    mass = np.zeros(LEAVES)
    for x in counts.groupBy("leaf").agg(F.sum(F.col("c") + 1).alias("m")).collect():  # a row for each member
        mass[x.leaf] = x.m
    for i in own:  # these left the members that their endings put them in
        mass[top[i].leaf] -= top[i].c + 1
        mass[leaves[i]] = top[i].c + 1
    mass[HEADS:] += 1  # for words never seen
    mass[0] = max(mass[0], 1)
    safe = np.maximum(mass, 1e-3).reshape(WIDE, WIDE)
    # Words of about the same frequency are neighbours in rank; members are dealt to classes in turn.
    order = np.argsort(words, kind="stable")
    model = Model(shape, words[order], np.array([x.c for x in top], dtype=np.int64)[order], leaves[order], np.log(safe.sum(axis=1) / safe.sum()).astype(np.float32), np.log(safe / safe.sum(axis=1, keepdims=True)).astype(np.float32), np.log10(np.maximum(mass, 1)), np.zeros((shape.rows, WIDE), dtype=np.float32))
    return model, int(total.n), int(total.v)


# ---------------------------------------------------------------- training


def gradient_round(documents: DataFrame, model: Model, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(seen, expected) [row of weights, outcome], summed over all documents in Spark."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    names = ["row", *(f"o{i}" for i in range(WIDE)), *(f"e{i}" for i in range(WIDE))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        n = model.shape.rows
        seen, expected = np.zeros(n * WIDE), np.zeros((WIDE, n))
        for batch in batches:
            for _, _, t in _runs(batch, 0):
                leaf, class_rows, p_class, member_rows, p_member = model.predict(t)
                for rows, p, y in ((class_rows, p_class, leaf // WIDE), (member_rows, p_member, leaf % WIDE)):
                    p = np.ascontiguousarray(p.T, dtype=np.float64)
                    for r in rows:
                        seen += np.bincount(r * WIDE + y, minlength=n * WIDE)
                        for k in range(WIDE):
                            expected[k] += np.bincount(r, p[k], n)
        seen = seen.reshape(n, WIDE)
        used = np.flatnonzero(seen.any(axis=1)).astype(np.int32)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(seen[used, k]) for k in range(WIDE)), *(pa.array(expected[k][used]) for k in range(WIDE))], names=names)

    got = documents.select(text).mapInArrow(released(task), "row int, " + ", ".join(f"{c} double" for c in names[1:]))
    seen, expected = np.zeros((model.shape.rows, WIDE)), np.zeros((model.shape.rows, WIDE))
    for x in got.groupBy("row").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect():  # a row for each row of weights
        seen[x.row], expected[x.row] = x[1 : WIDE + 1], x[WIDE + 1 :]
    held.unpersist()
    return seen, expected


def train(documents: DataFrame, counts: DataFrame, id_col: str = "doc_id", text: str = "text", head: int = 1 << 17, shape: Shape | None = None, rounds: int = 3, rate: float = 0.6, prior: float = 4.0) -> tuple[Model, int, int]:
    """Learn from all of ``documents``; (model, all tokens, distinct tokens)."""
    model, n, v = start_model(counts, head, shape or Shape())
    share = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("share")), F.lit(rounds))
    for i in range(rounds):
        seen, expected = gradient_round(documents.where(share == i), model, text)
        step = rate * (seen - expected) / (expected + prior)
        model.weights += np.clip(step, -1.5, 1.5).astype(np.float32)
    return model, n, v


# ---------------------------------------------------------------- scores


def score(documents: DataFrame, model: Model, counts: DataFrame, n: int, v: int, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with n_tokens, n_known, base_score and score. Texts are read once; a document's
    words that the model does not hold itself are kept as hashes, and meet their counts in a join. The
    table of the first pass numbers its rows, so rows that repeat are apart."""
    scratch = Scratch(documents.sparkSession, "scores")
    held = documents.sparkSession.sparkContext.broadcast(model)
    names = ["_n", "_known", "_raw", "_gain", "_missed"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        log_counts = np.log10(model.counts + 1.0)
        for batch in batches:
            for lo, hi, t in _runs(batch, batch.num_columns - 1):
                leaf, _, p_class, _, p_member = model.predict(t)
                every = np.arange(len(leaf))
                gain = np.log10(p_class[every, leaf // WIDE]).astype(np.float64) + np.log10(p_member[every, leaf % WIDE]) - model.log_share[leaf]
                at, hit = model.look_up(t.words)
                raw = np.where(hit, log_counts[at], 0.0) if len(log_counts) else np.zeros(len(leaf))
                miss = np.flatnonzero(~hit)
                ends = np.concatenate([[0], np.cumsum(np.bincount(t.doc[miss], minlength=t.texts))])
                missed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(t.words[miss].view(np.int64)))
                sums = [np.bincount(t.doc, minlength=t.texts), np.bincount(t.doc, hit, t.texts).astype(np.int64), np.bincount(t.doc, raw, t.texts), np.bincount(t.doc, gain, t.texts)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), *map(pa.array, sums), missed], names=[*keep, *names])

    schema = documents.select(*keep).schema.add("_n", "long").add("_known", "long").add("_raw", "double").add("_gain", "double").add("_missed", T.ArrayType(T.LongType()))
    scored = scratch.table(documents.select(*keep, text).mapInArrow(released(parts), schema).withColumn("_k", F.monotonically_increasing_id()), "first")
    rare = scored.select("_k", F.explode("_missed").alias("h")).join(counts.select("h", "c"), "h", "left")
    rare = rare.groupBy("_k").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more"), F.count("c").alias("more_known"))
    raw = F.col("_raw") + F.coalesce("more", F.lit(0.0))
    out = scored.drop("_missed").join(rare, "_k", "left")
    return out.select(*keep, F.col("_n").alias("n_tokens"), (F.col("_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (raw - F.col("_n") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), (raw + F.col("_gain")).alias("score"))


# ---------------------------------------------------------------- query


def op3_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", F.coalesce(fold_of("doc_id", 7) == 2, F.lit(False)))
    scratch = Scratch(spark, "maxent")
    learn = docs.where(~F.col("held_out"))
    counts = scratch.table(count_words(learn), "counts")
    model, n, v = train(learn, counts)
    out = score(docs, model, counts, n, v, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op3_maxent_lm": op3_maxent_lm}
ORACLE_SQL: dict[str, str] = {}
