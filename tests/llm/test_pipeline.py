import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabwright.llm import lang_id, quality_trees
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import verify

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What goes into each stage and comes out."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, sf).cache()
        out[name] = (docs, done)
        docs = done
    return out


def test_order_and_columns(spark, sf, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "exact_dedup", "near_dedup", "packing"]
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0 and 0 < after.count() <= before.count()


def test_quality_keeps_what_the_model_does(spark, sf, stages):
    before, after = stages["quality"]
    model = quality_trees.learn_quality(before, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = before.collect()
    want = {r.doc_id for r, s in zip(rows, model.score(quality_trees.statistics([r.text for r in rows]))) if s >= 0.3}
    assert {r.doc_id for r in after.collect()} == want
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q and i in {r.doc_id for r in rows}]
    assert len(want & set(good)) >= 0.99 * len(good)


def test_language_drops_texts_without_letters(spark, stages):
    before, after = stages["language"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")}
    extra = before.limit(1).withColumn("text", F.lit("12 34 !!")).unionByName(before)
    assert lang_id.keep_known(extra, lang_id.learn_languages(before)).count() == after.count()


def test_exact_dedup_by_brute_force(stages):
    before, after = stages["exact_dedup"]
    least = {}
    for r in before.collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(least.values())


def test_near_dedup_by_brute_force(stages):
    before, after = stages["near_dedup"]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c, _ in brute([(r.doc_id, r.text) for r in before.collect()])})


def test_packing_by_brute_force(stages):
    before, after = stages["packing"]
    verify(after.collect(), before.select("doc_id", "text").collect(), 2048)


def test_run_is_the_stages_one_after_the_other(spark, sf, stages):
    got, want = corpus_pipeline.run(spark, sf), stages["packing"][1]
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert got.columns == want.columns
    assert got.groupBy("doc_id").agg(F.sum("length")).exceptAll(want.groupBy("doc_id").agg(F.sum("length"))).count() == 0
    assert got.select(key).agg(F.sum("length")).first() == want.select(key).agg(F.sum("length")).first()


@pytest.mark.parametrize("kind", ["empty", "null ids and clashing columns"])
def test_stages_on_hard_tables(spark, sf, kind):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if kind == "empty":
        docs = docs.limit(0)
    else:
        some = docs.orderBy("doc_id").limit(30)
        null = F.lit(None)
        hard = spark.createDataFrame([(None, None), (None, ""), (None, "clean words of a text without an id"), (None, "clean words of a text without an id"), (None, "7 8 9")], "doc_id long, text string")
        hard = hard.select("doc_id", "text", null.cast("string").alias("lang"), null.cast("string").alias("source"), null.cast("int").alias("n_chars")).select(*docs.columns)
        docs = some.unionByName(hard).unionByName(some.limit(3)).withColumns({c: F.lit(1) for c in ("row", "record", "_kept_id", "rep", "label", "keep_id", "sequence")})
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    if kind == "empty":
        assert sizes == [0] * 5 and packed.count() == 0
    else:
        assert sizes == sorted(sizes, reverse=True) and docs.where("doc_id is null and text like 'clean words%'").count() <= 1
        assert docs.where("doc_id is not null").count() == docs.select("doc_id").where("doc_id is not null").distinct().count()
        assert packed.agg(F.sum("length")).first()[0] > 0
