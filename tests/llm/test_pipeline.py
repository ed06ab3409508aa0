"""Every stage on its own input: nulls, empty texts, repeated rows, ties, extra columns, no rows."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from strandloom.llm.common import Scratch
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import brute_best_fit

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _text string, _level0 int, _passes int, epoch int"
WORDS = {"en": "the cat and dog with this house that was over there by some river".split(), "de": "der hund und die katze mit dem haus das war auf dort bei einem fluss".split()}


def table(spark):
    rng = random.Random(6)
    rows = []

    def add(i, text, lang, source="web1"):
        rows.append((i, text, lang, source, len(text or ""), "x", 1, 2, 3))

    texts = [" ".join(rng.choices(WORDS[lang], k=rng.choice([3, 20, 60]))) for lang in ("en", "de") for _ in range(25)]
    for i, t in enumerate(texts):
        add(i, t, "en" if i < 25 else "de", rng.choice(["web1", "web2", "news1"]))
    add(100, texts[2], "en")  # an exact copy
    add(101, texts[30] + " zugabe", "de")  # a near copy, if the text is long
    add(102, "   ", "en")
    add(103, None, None)
    add(104, "12345 !!", "de", None)
    add(105, texts[5] + " more words follow here", None, None)
    add(3, texts[3], "en", "web1")  # a repeated id and text
    add(None, texts[7], "en")
    add(None, None, None)
    return spark.createDataFrame(rows, COLUMNS)


def key(rows):
    return Counter(str(tuple(x)) for x in rows)


def test_stages_against_brute_force(spark):
    docs = table(spark)
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "near_duplicates", "source_mix", "best_fit_packing"]
    scratch = Scratch(spark, "t")
    kept = scratch.table(cp.known_language(spark, docs, ""), "a")
    assert kept.columns == docs.columns
    want = [x for x in docs.collect() if x.text and any(c.isalpha() for c in x.text)]
    got = kept.collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter((x.doc_id, x.text) for x in want)
    assert all(x.lang in ("en", "de") for x in got) and all(x.lang == y.lang for x in got for y in want if y.doc_id == x.doc_id and y.lang)

    single = scratch.table(cp.without_near_duplicates(spark, kept, ""), "b")
    rows = single.collect()
    parts = brute([(x.doc_id, x.text) for x in got])
    firsts = {i for i, _, c in parts if i is not None and i == c}
    assert {x.doc_id for x in rows} == firsts | {None} and single.columns == docs.columns
    assert len(rows) == len({(x.doc_id, x.text) for x in rows})

    mixed = scratch.table(cp.mixed(spark, single, ""), "c")
    assert set(mixed.columns) == set(docs.columns)
    have = {(x.doc_id, x.text) for x in rows}
    assert {(x.doc_id, x.text) for x in mixed.collect()} <= have
    assert max(Counter((x.doc_id, x.text) for x in mixed.collect()).values()) <= 3

    packed = cp.packed(spark, mixed, "").collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = [len(whole.encode(x.text, add_special_tokens=False).ids) + 1 for x in mixed.collect()]
    assert sorted(x.length for x in packed) == sorted(sizes)
    assert len({x.sequence_id for x in packed}) == len(brute_best_fit(sizes, 4096))


@pytest.mark.parametrize("stage", cp.STAGES, ids=[n for n, _ in cp.STAGES])
def test_empty_table(spark, stage):
    assert stage[1](spark, table(spark).limit(0), "").count() == 0


def test_run_on_a_folder(spark, tmp_path):
    docs = table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 20 and key(out.collect())
