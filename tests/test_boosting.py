"""Boosted trees against a booster that holds every row in memory and tries every split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import attribution, boosting

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Repeated values, a null and a NaN; labels of two classes, three classes and values, some of them missing."""
    rng = np.random.RandomState(3)
    a, c = rng.randint(0, 9, 400).astype(float), rng.normal(size=400).round(1)
    b = rng.normal(size=400).round(1)
    two = (a + 2 * b + rng.normal(size=400) > 5).astype(int)
    three = np.digitize(a - b, [2, 6])
    value = 3 * a - b * b + rng.normal(size=400)
    made = [(i, *map(float, r[:3]), int(r[3]), int(r[4]), float(r[5])) for i, r in enumerate(zip(a, b, c, two, three, value))]
    made += [(400, None, 1.0, 0.5, 1, 2, 4.0), (401, float("nan"), -1.0, 0.5, 0, 1, -4.0), (402, 3.0, 1.0, 1.0, None, None, None)]
    return spark.createDataFrame(made, "id long, a double, b double, c double, two int, three int, value double").repartition(3).persist()


def brute(x, y, w, kind, classes, cuts, rounds, depth, rate):
    """Scores of rows, each held on its own; splits tried one by one."""
    bins = np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)])
    if kind == "regression":
        target = (w * y)[:, None]
    else:
        target = np.column_stack([w * (y == c) for c in (classes[1:] if kind == "binary" else classes)])
    share = target.sum(axis=0) / w.sum()
    base = share if kind == "regression" else np.log(share) if kind == "multiclass" else np.log(share / (1 - share))
    margin = np.repeat(base[None, :], len(x), axis=0)
    for _ in range(rounds):
        g, h = boosting.gradients(kind, margin, w, target)
        for t in range(margin.shape[1]):
            def grow(inside, level):
                gs, hs = g[inside, t].sum(), h[inside, t].sum()
                best = (0.0, None)
                for f in range(x.shape[1]) if level < depth else []:
                    for cut in range(len(cuts[f])):
                        left = inside[bins[inside, f] <= cut]
                        gl, hl = g[left, t].sum(), h[left, t].sum()
                        if hl < 1 or hs - hl < 1:
                            continue
                        gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
                        if gain > best[0] * (1 + 1e-9) + 1e-12:
                            best = (gain, (f, cut))
                if best[1] is None:
                    margin[inside, t] -= rate * gs / (hs + 1)
                    return
                small = bins[inside, best[1][0]] <= best[1][1]
                grow(inside[small], level + 1), grow(inside[~small], level + 1)
            grow(np.arange(len(x)), 0)
    return margin


@pytest.mark.parametrize("kind,label", [("binary", "two"), ("multiclass", "three"), ("multiclass", "two"), ("regression", "value")])
def test_scores_are_those_of_a_search_over_all_rows_and_splits(rows, kind, label, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE_EVERY", 2)
    model = boosting.fit_boosted(rows, FEATURES, label, kind, rounds=5, depth=3, rate=0.3, bins=16)
    learned = boosting.learnable(rows, FEATURES, label, kind)
    cuts = boosting.bin_cuts(learned, 3, 16)
    got = np.array([tuple(r) for r in learned.collect()], float)
    want = brute(got[:, :3], got[:, 3], got[:, 4], kind, model.classes, cuts, 5, 3, 0.3)
    assert len(got) == 402 and len(model.roots) == 5 * len(model.base)
    np.testing.assert_allclose(model.margins(got[:, :3]), want, atol=1e-9)
    scored = {r["id"]: r["pred"] for r in model.transform(rows.select("id", *FEATURES)).collect()}
    assert len(scored) == 403
    given = {r["id"]: [r[f] if r[f] == r[f] and r[f] is not None else 0.0 for f in FEATURES] for r in rows.collect()}
    m = model.margins(np.array(list(given.values())))
    pred = m[:, 0] if kind == "regression" else np.array(model.classes)[m.argmax(axis=1) if kind == "multiclass" else (m[:, 0] > 0).astype(int)]
    np.testing.assert_allclose([scored[i] for i in given], pred)


def test_a_split_is_the_best_of_all():
    rng = np.random.RandomState(0)
    for _ in range(200):
        sums = np.column_stack([rng.normal(size=8), rng.rand(8) * 2])
        gain, at, gl, hl, gr, hr = boosting.best_split(sums)
        tried = []
        for b in range(8):
            (lg, lh), (rg, rh) = sums[:b + 1].sum(axis=0), sums[b + 1:].sum(axis=0)
            if lh >= 1 and rh >= 1:
                tried.append((lg ** 2 / (lh + 1) + rg ** 2 / (rh + 1) - (lg + rg) ** 2 / (lh + rh + 1), b))
        best = max(tried, default=(0.0, -1), key=lambda v: v[0])
        assert (at == best[1] and gain == pytest.approx(best[0])) if best[0] > 0 else at == -1
        assert gl + gr == pytest.approx(sums[:, 0].sum()) and hl + hr == pytest.approx(sums[:, 1].sum())


def test_partitions_do_not_matter_and_loss_falls(rows, monkeypatch):
    cuts = boosting.bin_cuts(boosting.learnable(rows, FEATURES, "two", "binary"), 3)
    monkeypatch.setattr(boosting, "bin_cuts", lambda *a: cuts)  # a sketch's, which the partitioning may move a little
    one = boosting.fit_boosted(rows.coalesce(1), FEATURES, "two", rounds=4, depth=3, rate=0.2)
    many = boosting.fit_boosted(rows.repartition(9, "c"), FEATURES, "two", rounds=4, depth=3, rate=0.2)
    for name in ("feature", "bin", "left", "right"):
        np.testing.assert_array_equal(one.trees[name], many.trees[name])
    np.testing.assert_allclose(one.trees["value"], many.trees["value"], atol=1e-12)
    loss = [r["loss"] for r in one.loss_by_round(rows, "two").orderBy("round").collect()]
    assert len(loss) == 4 and all(b < a for a, b in zip(loss, loss[1:])) and loss[0] < np.log(2)


def test_contributions_add_up_to_the_score(rows):
    model = boosting.fit_boosted(rows, FEATURES, "two", rounds=4, depth=3, rate=0.2)
    got = attribution.boosted_attribution(model, rows, ["id"]).collect()
    given = {r["id"]: [r[f] if r[f] == r[f] and r[f] is not None else 0.0 for f in FEATURES] for r in rows.collect()}
    want = model.margins(np.array([given[r["id"]] for r in got]))[:, 0]
    np.testing.assert_allclose([r["base"] + sum(r["contributions"]) for r in got], want, atol=1e-9)


def test_nothing_to_learn(spark, rows):
    none = boosting.fit_boosted(rows.limit(0), FEATURES, "two", rounds=2)
    assert none.transform(rows).agg(F.min("pred"), F.max("pred")).first() == (0.0, 0.0)
    alike = boosting.fit_boosted(rows.filter("two = 1"), FEATURES, "two", rounds=2)
    assert alike.transform(rows).agg(F.min("pred"), F.max("pred")).first() == (1.0, 1.0) and alike.loss_by_round(rows, "two").count() == 0
    assert boosting.fit_boosted(rows.limit(0), FEATURES, "value", "regression", rounds=2).transform(rows).agg(F.max("pred")).first()[0] == 0.0
    flat = boosting.fit_boosted(rows.withColumn("a", F.lit(1.0)), ["a", "absent"], "two", rounds=2)
    assert flat.transform(rows).select("p").distinct().count() == 1
    # features named like columns the fit makes
    named = rows.select(F.col("a").alias("weight"), F.col("b").alias("label"), "two")
    clash = boosting.fit_boosted(named, ["weight", "label"], "two", rounds=2, depth=2)
    plain = boosting.fit_boosted(rows, ["a", "b"], "two", rounds=2, depth=2)
    np.testing.assert_array_equal(clash.trees["feature"], plain.trees["feature"])
    with pytest.raises(ValueError):
        boosting.fit_boosted(rows, FEATURES, "three")


@pytest.mark.parametrize("kind,label", [("binary", "two"), ("multiclass", "three"), ("regression", "value")])
def test_a_saved_model_scores_as_before(spark, rows, tmp_path, kind, label):
    model = boosting.fit_boosted(rows, FEATURES, label, kind, rounds=3, depth=3, rate=0.3)
    path = str(tmp_path / "model")
    boosting.fit_boosted(rows.limit(0), FEATURES, label, kind, rounds=1).save(spark, path)
    empty = boosting.load_boosted(spark, path)
    assert len(empty.roots) == 0 and set(empty.importances().values()) == {0.0} and empty.transform(rows).count() == 403
    model.save(spark, path)  # in place of the other
    again = boosting.load_boosted(spark, path)
    assert (again.kind, again.features, again.classes) == (model.kind, model.features, model.classes)
    for name, values in model.trees.items():
        np.testing.assert_array_equal(again.trees[name], values)
        assert again.trees[name].dtype == values.dtype
    x = np.random.RandomState(1).normal(size=(50, 3)) * 5
    np.testing.assert_array_equal(again.margins(x), model.margins(x))


def test_importance_is_the_share_of_the_gain(rows):
    more = rows.withColumn("noise", F.lit(1.0))
    model = boosting.fit_boosted(more, [*FEATURES, "noise", "absent"], "two", rounds=4, depth=3, rate=0.3)
    shares = model.importances()
    inner = model.trees["feature"] >= 0
    assert (model.trees["gain"][inner] > 0).all() and not model.trees["gain"][~inner].any()
    assert sum(shares.values()) == pytest.approx(1.0) and shares["noise"] == shares["absent"] == 0.0
    assert min(shares["a"], shares["b"]) > shares["c"]  # the label is made of a and b
    want = model.trees["gain"][model.trees["feature"] == 1].sum() / model.trees["gain"].sum()
    assert shares["b"] == pytest.approx(want)
