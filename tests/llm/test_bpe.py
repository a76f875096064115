import hashlib
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwright.llm.bpe import Bpe, encode_decode, portions

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = Bpe(PATH, cached=500)
OWN_LARGE = Bpe(PATH)
HARD = ["", " ", "it's we'll 'S", "á é É", "ΑΣ ΣΑΣ σ", "İstanbul ǅ ß ẞ", "x\x1cy\x1f z\x85w\xa0v", "１２ ½ ² Ⅷ ٣", "日本語テキスト 😀👍🏽", "a" * 3000,
        "ab" * 40 + "cd" * 900, "<|endoftext|>x <|startoftext|> y<|endoftext|><|end|>", "​‍﻿", "é" * 50, "!!!???...---", "̀ x", "!" * 500]


def ids(x):
    return np.frombuffer(x, "<u4").tolist()


def check(texts):
    for t, got in zip(texts, OWN.encode_batch(texts)):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert ids(got) == want, t[:80]
        assert OWN.decode(got).decode() == LIBRARY.decode(want, skip_special_tokens=False)


def test_hard_texts():
    check(HARD)


@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn")), max_size=40), max_size=4))
@settings(max_examples=400, deadline=None)
def test_any_text(texts):
    check(texts)


def test_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check([r.text for r in rows])


def test_long_word_path_is_the_short_one():
    a, b = Bpe(PATH, short=4), Bpe(PATH, short=10_000)
    words = ["thonre", "x" * 300, "ofthewherethe" * 20, "éèà" * 30]
    assert a.encode_words(words) == b.encode_words(words)


def test_query_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (3, "The " * 50_000)], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = encode_decode(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 0), (1, 0), (3, 50_000)]
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.ids_sha256 == r.decoded_sha256 == empty for r in got if r.doc_id == 1)
    assert encode_decode(df.limit(0), PATH).count() == 0


def test_many_words_take_few_steps():
    words = sorted({f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}the" for i in range(17_000)})
    text, calls = " ".join(words), []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        got = OWN_LARGE.encode_batch([text])
    finally:
        sys.setprofile(None)
    assert ids(got[0]) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(calls) < len(words) / 2  # words go through in arrays, not one by one


def test_columns_are_the_long_words():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinhrsé߀�"), n)) for n in rng.integers(1, 20, 500).tolist()]
    got = OWN.encode_words(list(dict.fromkeys(words)))
    assert all(got[w] == OWN.merge_long(w.encode()).astype("<u4").tobytes() for w in words)


def test_portions_and_groups_of_texts():
    texts = ["a b", None, "", "<|endoftext|>", "c " * 400, "d<|endoftext|><|endoftext|>e f", " ", "g h " * 300, "i"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    cut = list(portions([batch, batch.slice(0, 0)], most=500))
    assert pa.Table.from_batches(cut).column(1).to_pylist() == texts and len(cut) > 3
    for held in (1, 5, 500, 10_000):
        assert [ids(x) for x in Bpe(PATH, cached=held).encode_batch(texts)] == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert OWN.encode_batch([]) == []
