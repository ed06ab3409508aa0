"""Alignment against a plain one of whole texts, token by token."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm.alignment import align, op11_alignment
from strandloom.llm.common import Scratch

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SHOWN = [i for i in range(256) if 33 <= i < 127 or 161 <= i < 173 or i > 173]
BYTE = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


def a_bytes(i):
    return bytes(BYTE[c] for c in A.id_to_token(i))


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each text, from occurrences."""
    docs = []
    for t in texts:
        whole = " " + (t or "")
        a = A.encode(whole, add_special_tokens=False).ids if t else []
        b = B.encode(t) if t else []
        if not t or b"".join(map(a_bytes, a)) != whole.encode() or b"".join(map(b_bytes, b)) != whole.encode():
            docs.append(([], [], [], []))
            continue
        ends = []
        for ids, size in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, {}
            for i in ids:
                at += len(size(i))
                out[at] = i
            ends.append(out)
        groups, links, last = [], [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for at, i in side.items() if last < at <= cut) for side in ends))
            links.append((ends[0][cut], ends[1][cut]))
            last = cut
        docs.append((a, b, groups, links))
    counts = Counter(x for *_, links in docs for x in links)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(len(a), len(b), len(g), len(x), sum(counts[y] == top[y[1]] for y in x), sum(counts[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, x in docs]


def check(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("chunk", F.lit("c")).repartition(3)
    found = align(df, Scratch(spark, "t"), **more)
    got = {r.id: tuple(r)[1:] for r in found.documents.collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (texts[i][:80] if texts[i] else texts[i], got[i], w)
    return found


def test_texts(spark):
    words = ["the", "House", "it's", "x1y2", "don't", "zürich", "naïve", "ß", "Ärger", "中文", "—", "...", "(a)", "'s", " ", "\u0085", " ", "　", "ﬁ", "é", "👍🏽", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "$5.00", "a_b", "▁", "\t", "\n", "\n\n", "", "ĉ", "Ω", "\x7f", "\x1f", "​", "'", "!", "1234567"]
    rng = random.Random(4)
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "x" * 2000, "  a", "the the the", "the the the"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "", "  ", "\n"]) for _ in range(rng.randrange(1, 60))) for _ in range(250)]
    found = check(spark, texts)
    assert found.links.where("NOT best").count() > 0
    check(spark, texts, chunk_bytes=300, most=50)  # many chunks, segments forgotten now and then


def test_very_long_and_hot(spark):
    check(spark, ["same old words"] * 300 + ["word " * 3_000, "other words of old"])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align(df, Scratch(spark, "t")).documents.count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")
    assert sorted(r.n_a for r in align(nulls, Scratch(spark, "t")).documents.collect()) == [0, 1]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = op11_alignment(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r)[1:] for r in sorted(got.collect())] == brute([d.text for d in docs])
