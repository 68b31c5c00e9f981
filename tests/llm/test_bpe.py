import random

import pytest

from tilewright.llm.bpe import count_tokens, decode_ids, encode_texts
from tilewright.llm.queries import BPE

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def ids_of(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = encode_texts(df, BPE)
    got = {r.doc_id: list(r.ids) for r in out.collect()}
    back = {r.doc_id: r.text for r in decode_ids(out, BPE).collect()}
    sizes = {r.doc_id: r.n_tokens for r in count_tokens(df, BPE).collect()}
    assert all(len(got[i]) == sizes[i] for i in got)
    return [got[i] for i in range(len(texts))], [back[i] for i in range(len(texts))]


def test_random_texts_against_the_public_library(spark, public):
    rng = random.Random(1)
    parts = ["a", "aaaa", "the", " the", "ing", "0", "007", "é", "日本語", "😀", " ", "   ", "\n", "\r\n", "\t", ".", "...", "==", "--", "ACGT", "GATTACA", "'s", "'LL", "م", "नमस्ते", "½", "\x00", "\x85", " ", "​", "<|endoftext|>", "don't", "ﬁ", "é", "﻿", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(800)]
    got, back = ids_of(spark, texts)
    assert got == [public.encode(t, add_special_tokens=False).ids for t in texts]
    assert back == texts


def test_empty_null_and_very_long(spark, public):
    long = ["A" * 50_000, "ACGTTGCA" * 20_000, " " * 30_000 + "x", "é" * 20_000, "no space" * 5_000]
    got, back = ids_of(spark, ["", None, *long])
    assert got[:2] == [[], []] and back[:2] == ["", ""] and back[2:] == long
    assert got[2:] == [public.encode(t, add_special_tokens=False).ids for t in long]


def test_whole_documents(spark, public, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    want = {r.doc_id: public.encode(r.text, add_special_tokens=False).ids if r.text else [] for r in df.select("doc_id", "text").collect()}
    assert {r.doc_id: list(r.ids) for r in encode_texts(df, BPE).collect()} == want


def test_empty_table(spark):
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0
