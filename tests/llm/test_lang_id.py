import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwright.llm.lang_id import SEGMENT, Languages, automaton, keep_known, learn_languages, points, predict_language


def greedy(text, training):
    """Phrases by brute force: the longest prefix that is a substring of a training text, one character at least."""
    phrases = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and any(text[at:at + n + 1] in t for t in training):
            n += 1
        at, phrases = at + n, phrases + 1
    return phrases


@given(st.lists(st.text("abc", max_size=30), min_size=1, max_size=4), st.text("abcd", min_size=1, max_size=60))
@settings(max_examples=300, deadline=None)
def test_phrases_as_brute_force(training, text):
    model = Languages((("x", tuple(training)),))
    coded = [model.code[points(text)], model.code[points("abc")]]
    known = [t for t in training if t]
    assert model.phrases(coded)[:, 0].tolist() == [greedy(text, known), greedy("abc", known)]


def test_automaton_accepts_exactly_the_substrings():
    texts = ["abcbc", "bcab", "aab"]
    table = automaton([np.array([ord(c) - 97 for c in t]) for t in texts], 3)

    def accepted(w):
        s = 0
        for c in w:
            s = table[s * 3 + ord(c) - 97]
            if s < 0:
                return False
        return True

    import itertools
    for n in range(1, 6):
        for w in map("".join, itertools.product("abc", repeat=n)):
            assert accepted(w) == any(w in t for t in texts)


def test_long_texts_are_parsed_whole():
    model = Languages((("x", ("ab" * 400,)), ("y", ("cd" * 400,))))
    names, score = model.predict(["ab" * SEGMENT + "cd" * (3 * SEGMENT), "cd"])
    assert names == ["y", "y"] and 0 < score[0] < 1


def test_held_out_accuracy_and_no_other_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sample = learn_languages(docs)
    assert sample == learn_languages(docs.repartition(7))
    got = predict_language(docs, sample).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for r in held) and sum(r.held_out for r in got) == len(held)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise(F.col("lang")))
    assert learn_languages(swapped) == sample  # held-out labels are never read


def test_null_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (None, "the of and", "en"), (4, "the of", "en"), (4, "the of", "en")],
                               "doc_id long, text string, lang string").withColumn("id", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    sample = (("de", ("der die das",)), ("en", ("the of and",)))
    got = sorted((r.doc_id or 0, r.lang_pred, r.held_out) for r in predict_language(df, sample).collect())
    assert [g[:2] for g in got] == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")] and not got[0][2]
    assert keep_known(df, sample).count() == 3 and keep_known(df, sample).columns == df.columns
    assert predict_language(df.limit(0), sample).count() == 0
    assert learn_languages(df.limit(0)) == () and predict_language(df, ()).where("lang_pred = 'und'").count() == 6


def test_rare_languages_are_learned(spark):
    rare = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == rare, "der die das").otherwise("the of and").alias("text"),
                                    F.when(F.col("id") == rare, "de").otherwise("en").alias("lang"))
    assert [name for name, _ in learn_languages(df)] == ["de", "en"]


def test_the_body_of_a_text_is_learned_and_copies_count_once(spark):
    head = "shared header of every page in the archive. " * 10
    body = {"de": "der die das und nicht ", "en": "the of and with from "}
    rows = [(i, head + (w := body[lang]) * 200 + str(i) * (i % 2), lang) for lang in body for i in range(40)]
    rows += [(100 + i, "copy copy", "en") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = learn_languages(df, rows=10)
    parts = dict(sample)
    assert all(any(body[lang][:-1] in t for t in parts[lang]) for lang in body)
    assert sum(t.startswith("copy") for t in parts["en"]) <= 1
    assert Languages(sample).predict(["und nicht der", "with from the"])[0] == ["de", "en"]


def test_transitions_need_no_room_for_missing_codes():
    texts = [np.arange(5_000), np.arange(5_000)[::-1]]
    table = automaton(texts, 5_000)
    assert len(table.owner) < 200_000
    assert table[0 * 5_000 + 7] >= 0 and table[table[0 * 5_000 + 7] * 5_000 + 9] == ~table[0 * 5_000 + 9]


def test_without_any_label_texts_with_a_letter_stay(spark):
    df = spark.createDataFrame([(i, f"text {i}", None) for i in range(60)] + [(90, "12 !", None), (91, None, None)], "doc_id long, text string, lang string")
    sample = learn_languages(df)
    assert sample == () and {r.doc_id for r in keep_known(df, sample).collect()} == set(range(60))


def test_texts_are_learned_whole_and_long_ones_last(spark):
    rows = [(i, f"short number {'x' * i}", "en") for i in range(0, 300, 3)] + [(1_002, "long " * 5_000, "en"), (1_005, "lang " * 5_000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").where("crc32(cast(doc_id as string)) % 3 != 1")
    texts = {r.text for r in df.collect()}
    sample = dict(learn_languages(df, rows=5))
    assert len(sample["en"]) == 5 and all(t in texts and len(t) < 1_000 for t in sample["en"])
    assert all(t in texts for t in sample.get("de", ()))
