import glob
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwright.llm.training_order import in_order, number_of, read_in_order, slot_of, write_in_order

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("count", [1, 2, 3, 7, 64, 1000, 4097])
def test_slots_are_a_keyed_permutation(count):
    numbers = np.arange(count)
    slots = slot_of(numbers, count, 11)
    assert sorted(slots.tolist()) == numbers.tolist()
    assert (number_of(slots, count, 11) == numbers).all()
    if count >= 64:
        assert (slot_of(numbers, count, 12) != slots).any()
        assert abs(np.corrcoef(numbers, slots)[0, 1]) < 0.35


def test_every_id_is_written_once_and_read_from_any_slot(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = str(tmp_path / "o")
    order = write_in_order(docs, path, PATH, key=3, length=256, per_shard=50)
    rows = read_in_order(spark, path).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(order.sequences))
    assert sorted(r.sequence_id for r in rows) == list(range(order.sequences))
    stream = np.concatenate([np.frombuffer(r.ids, "<u2") for r in sorted(rows, key=lambda r: r.sequence_id)]).tolist()
    want = [i for d in docs.select("text").collect() for i in LIBRARY.encode(d.text or "", add_special_tokens=False).ids + [1]]
    assert stream == want
    assert all(r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for r in rows)
    for shard in range(-(-order.sequences // 50)):
        (file,) = glob.glob(f"{path}/shards/shard={shard}/part-*")
        raw = open(file, "rb").read()
        assert len(raw) == order.stride * min(50, order.sequences - 50 * shard)
    part = read_in_order(spark, path, 73, 140).orderBy("slot").collect()
    assert part == rows[73:140]
    assert part[0].byte == (73 - 50) * order.stride
    for r in rows:  # the first document and token of a sequence are where it says
        if r.doc_id is not None and r.n_tokens:
            own = LIBRARY.encode(docs.where(F.col("doc_id") == r.doc_id).first().text or "", add_special_tokens=False).ids + [1] if r.slot < 8 else None
            assert own is None or own[r.start:r.start + 5] == np.frombuffer(r.ids, "<u2").tolist()[:5][:len(own) - r.start]


def test_null_empty_long_repeated_and_clashing_columns(spark):
    docs = [(None, "a b"), (1, None), (1, None), (2, ""), (3, "the " * 9_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("ids", F.lit("x")).coalesce(1)
    rows = in_order(df, PATH, length=512, per_shard=4).collect()
    assert sum(r.n_tokens for r in rows) == 2 + 9_000 + 5
    assert min((r.sequence_id, r.doc_id) for r in rows)[1] is None
    assert in_order(df.limit(0), PATH).count() == 0
