"""Topic model and co-training on planted structure."""

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.sql import functions as F

from tabwright.operators import semi, topics


def texts():
    rng = np.random.default_rng(1)
    pools = [[f"{n}{c}" for c in "abcdefgh"] for n in ("sea", "sky", "oak")]
    rows = [(i, " ".join(rng.choice(pools[i % 3], 30)) + " the") for i in range(240)]
    return rows + [(900, None), (901, ""), (902, "the 12 the")], pools


def test_planted_topics_shares_and_likelihood(spark):
    rows, pools = texts()
    df = spark.createDataFrame(rows, "id long, text string").withColumn("_words", F.lit(1)).withColumn("features", F.lit("f"))
    names = topics.vocabulary(df, "text")
    assert set(names) == {w for p in pools for w in p} and topics.vocabulary(df, "text", words=5) == names[:5]
    model = topics.fit_topics(df, "text", k=3)
    found = {}
    for r in model.top_words(8).collect():
        found.setdefault(r.topic, set()).add(r.word)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, pools))
    scored = model.shares(df)
    assert scored.columns == [*df.columns, "shares"] and scored.count() == len(rows)
    got = {r.id: r.shares for r in scored.collect()}
    assert all(abs(sum(s) - 1) < 1e-9 and len(s) == 3 for s in got.values())
    assert all(max(got[i]) > 0.8 for i in range(240)) and got[900] == got[902] == [pytest.approx(1 / 3)] * 3
    few = topics.fit_topics(df, "text", k=3, rounds=1)
    assert model.log_likelihood(df) > few.log_likelihood(df)


def test_no_word_fits(spark):
    with pytest.raises(ValueError):
        topics.fit_topics(spark.createDataFrame([(1, "a"), (2, None)], "id long, text string"), "text")


def views(spark, n=600):
    """Two views, each of which tells the label of one half of the rows only."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        y, half = i % 2, (i // 2) % 2
        a, b = [(4.0 * y - 2 if half == k else 0.0) + rng.normal() / 2 for k in (0, 1)]
        rows.append((i, a, b, y))
    return spark.createDataFrame(rows, "id long, a double, b double, y int")


def test_co_training_beats_one_view(spark):
    df = views(spark)
    model, handed = semi.co_train(df.filter("id < 12"), df.filter("id >= 12").drop("y"), "logistic", (["a"], ["b"]), "y", ["id"], per_class=15, rounds=4)
    right = lambda c: model.transform(df).agg(F.avg((F.col(c).cast("int") == F.col("y")).cast("double"))).first()[0]
    alone = model.transform(df).agg(F.avg(((F.col("p_first") > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert right("pred") > 0.9 and alone < 0.85
    sizes = {(r["round"], r["view"], r["y"]): r["n"] for r in handed.groupBy("round", "view", "y").agg(F.count("*").alias("n")).collect()}
    assert max(k[0] for k in sizes) == 4 and all(n <= 15 for n in sizes.values())
    per_row = handed.groupBy("id").agg(F.count_distinct("y").alias("labels"), F.count_distinct("round").alias("rounds")).agg(F.max("labels"), F.max("rounds")).first()
    assert tuple(per_row) == (1, 1) and handed.filter("id < 12").count() == 0


def test_nothing_sure_ends_it(spark):
    df = views(spark, 60)
    _, handed = semi.co_train(df.filter("id < 12"), df.filter("id >= 12").drop("y"), "logistic", (["a"], ["b"]), "y", ["id"], confidence=1.1)
    assert handed.count() == 0 and handed.columns == ["id", "y", "view", "round"]


def test_inference_and_fit_follow_sparks(spark):
    """The same draws weigh the same; shares of one model differ by no more than where an inference may stop."""
    rows, _ = texts()
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    model = topics.fit_topics(df, "text", k=3, rounds=5)
    counts = model.counts(df.select("text")).select(F.col("_counts").alias("features"))
    plain = LDA(k=3, maxIter=5, seed=topics.SEED, optimizer="online", subsamplingRate=1.0, learningOffset=1.0, optimizeDocConcentration=False)
    theirs = plain.fit(counts)
    assert model.log_likelihood(df) == pytest.approx(float(theirs.logLikelihood(counts)), rel=0.1) and model.model.getMaxIter() == 5
    assert model.model.topicsMatrix().toArray().sum() == pytest.approx(theirs.topicsMatrix().toArray().sum(), rel=0.01)
    by_ours = np.array([r[0] for r in model.shares(df).orderBy("id").select("shares").collect()])
    scored = model.model.transform(model.counts(df).withColumnRenamed("_counts", "features"))
    by_theirs = np.array([r[0].toArray() for r in scored.orderBy("id").select("topicDistribution").collect()])
    by_theirs[by_theirs.sum(axis=1) == 0] = 1 / 3
    assert np.abs(by_ours - by_theirs).max() < 1e-3


def test_inference_ends_where_a_step_changes_nothing():
    rng = np.random.default_rng(3)
    beta = np.vstack([topics.expected(rng.gamma(1.0, 1.0, (4, 60))).T, np.zeros(4)])
    prior, lengths = np.full(4, 0.25), rng.integers(0, 50, 500)
    lengths[0] = 0
    words = np.concatenate([rng.choice(60, n, replace=False) for n in lengths]).astype(np.int32)
    counts, starts = rng.integers(1, 9, len(words)).astype(float), np.cumsum(lengths) - lengths
    met = []
    for found, w, weights, ratio in topics.inferred(words, counts, lengths, beta, prior, rng):
        met += found.tolist()
        for i, own, last, own_ratio in zip(found, weights, w, ratio):
            at = slice(starts[i], starts[i] + lengths[i])
            theta = topics.expected(own)
            share = counts[at] / (beta[words[at]] @ theta)
            assert np.abs(own_ratio[:lengths[i]] - share).max() < 1e-9 * share.max() and not own_ratio[lengths[i]:].any() and (last[lengths[i]:] == 60).all()
            assert np.abs(prior + theta * (beta[words[at]].T @ share) - own).mean() < 2e-3
    assert sorted(met) == np.flatnonzero(lengths).tolist()


def test_drawn_twice_counts_twice(spark):
    df = spark.createDataFrame([("a b a",), ("b c",), ("",)], "text string")
    known = topics.Topics(["a", "b", "c"], None, "text").counts(df).select(F.monotonically_increasing_id().alias("id"), F.col("_counts").alias("features"))
    beta, prior = topics.padded(np.array([[9.0, 1.0, 1.0], [1.0, 1.0, 9.0]])), np.full(2, 0.5)
    once = topics.gathered(known, beta, prior, 1)
    twice = topics.gathered(known.withColumn("id", F.explode(F.array("id", "id"))), beta, prior, 1)
    assert np.allclose(twice, 2 * once, rtol=1e-2) and np.isclose((once * beta[:-1]).sum(), 5.0, rtol=1e-6)
    assert topics.gathered(known.filter("false"), beta, prior, 1) is None


def test_exploded_shares_are_inferred_once(spark):
    rows, _ = texts()
    df = spark.createDataFrame(rows, "id long, text string")
    found = topics.fit_topics(df, "text", k=3, rounds=1).shares(df).select("id", F.posexplode("shares").alias("topic", "share"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert found.count() == 3 * len(rows)


def test_single_precision_ends_where_double_does(monkeypatch):
    rng = np.random.default_rng(4)
    beta = np.vstack([topics.expected(rng.gamma(0.1, 1.0, (10, 400)) + 0.01).T, np.zeros(10)])
    lengths = np.array([200, 90, 1, 40, 0])
    words = np.concatenate([rng.choice(400, n, replace=False) for n in lengths]).astype(np.int32)
    counts = rng.integers(1, 9, len(words)).astype(float)
    counts[200:290] *= 1e6  # too many words for single precision
    ends = []
    for most in (topics.SINGLE_COUNT, 0):
        monkeypatch.setattr(topics, "SINGLE_COUNT", most)
        found = {i: own for t, _, w, _ in topics.inferred(words, counts, lengths, beta, np.full(10, 0.1), np.random.default_rng(1)) for i, own in zip(t.tolist(), w)}
        assert set(found) == {0, 1, 2, 3}
        ends.append(found)
    for i, own in ends[0].items():
        total = counts[lengths[:i].sum():lengths[:i + 1].sum()].sum()
        assert own.sum() == pytest.approx(total + 1.0, rel=1e-6) and np.abs(own - ends[1][i]).max() < 0.05 * max(1.0, total / 1e3)
