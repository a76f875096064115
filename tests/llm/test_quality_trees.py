import zlib

import numpy as np
from pyspark.sql import functions as F

from tabwright.llm.quality_trees import FEATURES, grow, keep_good, learn_quality, score_quality, statistics


def test_traversal_as_one_row_at_a_time():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = grow(x, y, trees=30, depth=3)
    score = model.score(x)
    for i in range(0, 600, 37):
        z = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (x[i, f[k]] > t[k])
            z += leaf[k - len(f)]
        assert abs(1 / (1 + np.exp(-z)) - score[i]) < 1e-12
    assert np.mean((score > 0.5) == y) > 0.97


def test_one_label_or_no_rows():
    assert np.allclose(grow(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))), 0.5)
    assert np.allclose(grow(np.zeros((8, 3)), np.ones(8)).score(np.zeros((2, 3))), 0.9)


def test_statistics_of_plain_texts():
    x = dict(zip(FEATURES, statistics(["Ab c1.\nAb c1.\n|é"])[0]))
    assert x["distinct_lines"] == 2 / 3 and x["distinct_words"] == 3 / 5 and x["longest_word"] == 3
    assert np.isclose(x["pipes"], 1 / 17) and np.isclose(x["wide_bytes"], 2 / 17)
    assert not statistics([None, ""]).any()


def test_held_out_accuracy(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = learn_quality(docs, labels)
    got = score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.97
    again = learn_quality(docs.repartition(5), labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(again.leaf, model.leaf)  # held-out labels and partitions don't matter


def test_null_empty_long_and_clashing(spark, sf):
    model = learn_quality(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))
    df = spark.createDataFrame([(1, None), (2, ""), (None, "The of and."), (3, "the of and.\n" * 40_000), (3, "x"), (3, "x")], "doc_id long, text string")
    df = df.withColumn("score", F.lit("a")).withColumn("id", F.lit(1)).withColumn("y", F.lit(1))
    got = score_quality(df, model)
    assert got.count() == 6 and got.where("score between 0 and 1").count() == 6 and got.where("doc_id is null and not held_out").count() == 1
    assert got.where("doc_id in (1, 2)").select("score").distinct().count() == 1
    assert keep_good(df, model).columns == df.columns and keep_good(df, model, cut=0.0).count() == 6
    assert score_quality(df.limit(0), model).count() == 0 and keep_good(df.limit(0), model).count() == 0
    empty = learn_quality(df.limit(0).select("doc_id", "text"), df.limit(0).select("doc_id", F.lit(1).alias("quality")))
    assert score_quality(df, empty).where("score = 0.5").count() == 6
