import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandloom.llm import packing
from strandloom.llm.common import Scratch, text_buffers

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "A.", "..", "it's", "don't,", "x1y", "Straße", "ÉCOLE,", "×÷", "é", "İ", "a b", "a b c", "\x1c\x1d", "<|endoftext|>", "<|EndOfText|>", "a<|endoftext|>b", "日本語", "𝒳 y", "tab\tnew\nline", "the, the. THE", "ΑΣ Σ", "a" * 300, "é" * 50, "µ ª", "w|x", "\x01 b"]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_tokenizer(whole):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choices(ODD, k=rng.randint(1, 9))) for _ in range(300)] + [ODD[-1]]
    words = packing.WordTokens(PATH, most=50)
    for part in (texts[:40], texts[40:], texts):
        flat, begins = words.encode(*text_buffers(pa.array(part)), 1)
        for i, t in enumerate(part):
            assert flat[begins[i] : begins[i + 1]].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1], t


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 400))]
    bulks = defaultdict(int)
    for n in lengths:
        bulks[n] += 1
    runs, opened = packing.best_fit_runs(dict(bulks), capacity)
    room = [capacity] * opened
    placed = defaultdict(set)
    for length, rank, n, first, each, offset in runs:
        for k in range(n):
            seq, at = first + k // each, offset + k % each * length
            assert capacity - room[seq] == at
            room[seq] -= length
            assert rank + k not in placed[length]
            placed[length].add(rank + k)
    assert {k: len(v) for k, v in placed.items()} == dict(bulks)
    assert sorted(room) == brute_best_fit(lengths, capacity)


def test_packing_is_gapless_and_whole(spark, whole):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["the", "Andreingorble", "x1,"], k=rng.choice([0, 1, 5, 40])))) for i in range(60)] + [(7, None), (None, "a b"), (3, "a b"), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.best_fit_packing(df, Scratch(spark, "t"), capacity=16, ids=True).collect()
    by = defaultdict(list)
    for x in got:
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, dtype="<u4").tobytes()) and len(x.ids) == x.length <= 16
        by[x.sequence_id].append((x.offset, x.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 16
    want = sorted((str(i), [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    assert sum(len(ids) for _, ids in want) == sum(x.length for x in got)
    single = {i: ids for i, ids in want if i not in ("3", "7")}
    for i, ids in single.items():
        parts = sorted((x for x in got if str(x.id) == i), key=lambda x: x.piece)
        assert [y for x in parts for y in x.ids] == ids and [x.start for x in parts] == list(range(0, len(ids), 16))
    assert len(by) == len(brute_best_fit([x.length for x in got], 16))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.best_fit_packing(df, Scratch(spark, "t")).count() == 0
