"""Token files against the tokenizer's own ids, exact round trips, damaged files."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm.common import Scratch
from strandloom.llm.token_store import SCALE, Coder, StoreReader, StoreWriter, frequencies, op12_token_store, read_store, write_store


class Kept(io.BytesIO):
    def close(self):
        pass


def test_frequencies():
    f = frequencies(np.array([10**12, 1, 0, 5]))
    assert f.sum() == 1 << SCALE and f[2] == 0 and f[1] >= 1
    assert frequencies(np.zeros(3, np.int64)).sum() == 0
    assert (frequencies(np.ones(4, np.int64)) == 1 << (SCALE - 2)).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300), st.integers(1, 9), st.integers(1, 5))
def test_coder_round_trip(ids, lanes, steps):
    ids = np.array(ids, np.int64)
    coder = Coder(frequencies(np.bincount(ids, minlength=41)))
    words, marks = coder.encode(ids, lanes, steps)
    if len(ids):
        assert (coder.decode(words, *marks[0], len(ids)) == ids).all()
    for i, (entry, states) in enumerate(marks):  # from each checkpoint on
        at = i * lanes * steps
        assert (coder.decode(words, entry, states, len(ids) - at) == ids[at:]).all()


def test_size_is_near_the_entropy():
    ids = np.random.default_rng(1).geometric(0.05, 200_000) - 1
    counts = np.bincount(ids)
    words, _ = Coder(frequencies(counts)).encode(ids)
    p = counts[counts > 0] / counts.sum()
    assert 4 * len(words) < 1.01 * -(p * np.log2(p)).sum() * len(ids) / 8


def test_file():
    rng = np.random.default_rng(2)
    docs = [(i if i else None, rng.integers(0, 50, n).astype(np.uint32)) for i, n in enumerate([1, 0, 700, 3, 64, 5000, 1])]
    coder = Coder(frequencies(np.ones(50, np.int64)))
    out = Kept()
    w = StoreWriter(out, coder, lanes=8, steps=4, segments=3)
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    r = StoreReader(out, coder)
    assert [x.tolist() for _, x in r.documents()] == [ids.tolist() for _, ids in docs]
    every = np.concatenate([ids for _, ids in docs])
    assert (r.ids(690, 200) == every[690:890]).all() and (r.ids(0, 1) == every[:1]).all() and len(r.ids(5, 0)) == 0
    assert r.doc_null.tolist() == [1, 0, 0, 0, 0, 0, 0]
    data = bytearray(out.getvalue())
    data[12] ^= 1  # a word that is read early
    with pytest.raises(ValueError, match="damaged"):
        list(StoreReader(io.BytesIO(bytes(data)), coder).documents())
    data[-30] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        StoreReader(io.BytesIO(bytes(data)), coder)
    with pytest.raises(ValueError, match="another table"):
        StoreReader(out, Coder(frequencies(np.arange(50))))
    with pytest.raises(ValueError, match="does not have"):
        Coder(frequencies(np.array([1, 0]))).encode(np.array([1]))


def brute(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_documents(spark):
    texts = ["Hello, world", None, "", "x" * 3000, "word " * 40_000, "Ünïcode ﬁ 中文   <|endoftext|>", "same", "same", "a\tb\nc"]
    ids = [5, 3, None, 9, 1, 7, 2, 2, -4]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("id", F.lit("z")).repartition(3)
    s = Scratch(spark, "t")
    got = read_store(write_store(df, s.path("store"), s), s.path("store"), ids=True).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -4, 1, 2, 2, 3, 5, 7, 9]
    want = dict(zip(ids, brute(texts), strict=True))
    at = 0
    for r in got:
        assert r.ids == want[r.doc_id] and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens


def test_empty_table(spark):
    s = Scratch(spark, "t")
    df = spark.createDataFrame([], "doc_id long, text string")
    assert read_store(write_store(df, s.path("store"), s), s.path("store")).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = sorted(op12_token_store(spark, "/root/testdata/sf0.001").collect())
    at = 0
    for r, d, ids in zip(got, docs, brute([d.text for d in docs]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
