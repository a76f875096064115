import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwright.llm.packing import COLUMNS, non_negative_least_squares, pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def verify(rows, docs, window):
    """Every id in exactly one piece, offsets without gaps, checksums as the library's ids say."""
    wanted = defaultdict(int)
    for doc, text in docs:
        wanted[(doc, tuple(LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]))] += 1
    ids = {doc: k for doc, k in wanted}
    starts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.array(ids[r.doc_id], "<u4")
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes()) and r.length > 0
        starts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for (doc, own), times in wanted.items():
        covered = np.zeros(len(own), int)
        for s, n in starts[doc]:
            covered[s:s + n] += 1
        assert (covered == times).all()
    full = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
        full += at == window
    assert full >= len(sequences) - 1  # only the last is short
    assert sorted(sequences) == list(range(len(sequences)))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verify(pack(docs, PATH).collect(), docs.select("doc_id", "text").collect(), 2048)


@pytest.mark.parametrize("window", [4, 16, 64])
def test_small_windows_null_empty_long_and_repeated(spark, window):
    docs = [(i, "the of " * (i % 40)) for i in range(150)] + [(200, None), (201, ""), (202, "a " * 5_000), (None, "x y z"), (7, "the of " * 7), (7, "the of " * 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("length", F.lit(None).cast("int"))
    got = pack(df, PATH, window=window)
    assert got.columns == COLUMNS
    verify(got.collect(), docs, window)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_least_squares_meets_an_exact_solution():
    a, m, b = np.array([2, 3, 1]), np.array([1, 2, 4]), np.array([6, 2, 4])
    x = np.array([5.0, 0.0, 2.0])
    wanted = np.bincount(a, m * x, 8) + np.bincount(b, x, 8)
    assert np.allclose(non_negative_least_squares(a, m, b, wanted, 3000), x, atol=0.05)


def test_plan_uses_no_more_than_there_is_and_cuts_little():
    rng = np.random.default_rng(5)
    h = np.bincount(rng.integers(1, 256, 20_000), minlength=256)
    p = plan(h, 256)
    assert (p.planned <= h).all() and (p.planned * np.arange(256)).sum() == p.sequences * 256
    assert p.planned.sum() > 0.9 * h.sum()
