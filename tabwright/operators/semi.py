"""Learning from few labels: rows to label next, pseudo-labels, blending on a hold-out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_double, col
from ..session import cut_lineage
from .models import Stack, fit, predict, problem_of


def most_uncertain(df: DataFrame, p: str, keys: Sequence[str], n: int = 100) -> DataFrame:
    """The n rows whose probability is nearest to one half: a top-n, smaller keys first on ties."""
    gap = F.abs(clean_double(p) - 0.5)
    return df.filter(gap.isNotNull()).orderBy(gap, *[col(k) for k in keys]).limit(n)


def self_train(labelled: DataFrame, unlabelled: DataFrame, algorithm: str, features: Sequence[str], label: str, confidence: float = 0.95,
               rounds: int = 3, params: Mapping | None = None) -> tuple[PipelineModel, DataFrame]:
    """Fit, take over the labels that the model is sure of, and fit again. Returns the model and (features, label, round).

    Each round's rows are written, so the rounds do not pile up in one plan. It ends early when a round adds nothing.
    """
    columns = [*features, label]
    known = cut_lineage(labelled.filter(col(label).isNotNull()).select(*columns, F.lit(0).alias("round")), "labelled")
    open_rows = cut_lineage(unlabelled.select(*features), "unlabelled")
    model = fit(known, algorithm, features, label, params)
    for i in range(1, rounds + 1):
        scored = predict(model, open_rows, features)
        scored = cut_lineage(scored.withColumn("_sure", F.greatest("p", 1 - F.col("p")) >= confidence), "scored")
        sure = scored.filter("_sure").select(*features, F.col("pred").cast(labelled.schema[label].dataType).alias(label), F.lit(i).alias("round"))
        if not sure.limit(1).count():
            break
        known = cut_lineage(known.unionByName(sure), "labelled")
        open_rows = scored.filter("not _sure").select(*features)
        model = fit(known, algorithm, features, label, params)
    return model, known


@dataclass
class CoTrained:
    """Two models on disjoint columns; a row's probability is the mean of both."""

    first: PipelineModel
    second: PipelineModel
    views: tuple[list[str], list[str]]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with p_first, p_second, p and pred."""
        out = predict(self.first, df, self.views[0]).withColumnRenamed("p", "p_first").drop("pred")
        out = predict(self.second, out, self.views[1]).withColumnRenamed("p", "p_second").drop("pred")
        p = (F.col("p_first") + F.col("p_second")) / 2
        return out.withColumn("p", p).withColumn("pred", (F.col("p") > 0.5).cast("double"))


def co_train(labelled: DataFrame, unlabelled: DataFrame, algorithm: str, views: tuple[Sequence[str], Sequence[str]], label: str, keys: Sequence[str],
             per_class: int = 10, confidence: float = 0.6, rounds: int = 10, params: Mapping | None = None) -> tuple[CoTrained, DataFrame]:
    """Two models of labels 0 and 1 hand each other their surest rows. Returns the models and (keys, label, view, round) of what was handed over.

    In a round each model, fitted on its own columns, picks the ``per_class`` open rows that it is surest of for each
    label, with a probability of at least ``confidence``; equal ones by their keys. Of each label it hands over as many as of the other, so
    the classes stay balanced. The other model learns them with that label in the next round. A row that
    both pick goes to both if they agree, and stays open if not. It ends after ``rounds``, or when nothing is handed
    over. ``keys`` must be unique and not null. Every round is written.
    """
    views = ([*views[0]], [*views[1]])
    columns = [*dict.fromkeys([*views[0], *views[1]])]
    ids, kind = list(keys), labelled.schema[label].dataType
    base = labelled.filter(col(label).isNotNull()).select(*columns, label)
    known = [cut_lineage(base, "seeds")] * 2
    open_rows = cut_lineage(unlabelled.select(*ids, *columns), "open")
    handed, fitted = [], [fit(known[v], algorithm, views[v], label, params) for v in (0, 1)]
    for i in range(1, rounds + 1):
        picks = []
        for v in (0, 1):
            scored = cut_lineage(predict(fitted[v], open_rows, views[v]).select(*ids, "p"), "sure")
            sure = (F.col("p"), 1 - F.col("p"))
            sides = [cut_lineage(scored.filter(p >= confidence).orderBy(p.desc(), *[col(k) for k in ids]).limit(per_class), "side") for p in sure]
            even = min(s.count() for s in sides)
            both = [s.orderBy(p.desc(), *[col(k) for k in ids]).limit(even).select(*ids, F.lit(y).cast(kind).alias(label), F.lit(v + 1).alias("view"))
                    for s, p, y in zip(sides, sure, (1, 0))]
            picks.append(both[0].unionByName(both[1]))
        every = cut_lineage(picks[0].unionByName(picks[1]), "picks")
        split = every.groupBy(*ids).agg(F.count_distinct(col(label)).alias("_n")).filter("_n > 1").select(*ids)
        new = cut_lineage(every.join(split, ids, "left_anti").withColumn("round", F.lit(i)), "handed")
        if not new.limit(1).count():
            break
        handed.append(new)
        for v in (0, 1):  # what the other one was sure of
            got = open_rows.join(new.filter(F.col("view") == 2 - v).select(*ids, label), ids).select(*columns, label)
            known[v] = cut_lineage(known[v].unionByName(got), "known")
        open_rows = cut_lineage(open_rows.join(new.select(*ids).distinct(), ids, "left_anti"), "open")
        fitted = [fit(known[v], algorithm, views[v], label, params) for v in (0, 1)]
    none = open_rows.limit(0).select(*ids, F.lit(None).cast(kind).alias(label), F.lit(0).alias("view"), F.lit(0).alias("round"))
    return CoTrained(*fitted, views), reduce(DataFrame.unionByName, handed, none)


def blend(df: DataFrame, bases: Mapping[str, tuple[str, Mapping]], features: Sequence[str], label: str) -> Stack:
    """Base models of split=train, and a logistic model over their scores of split=val."""
    train, val = df.filter("split = 'train'"), df.filter("split = 'val'")
    models = {name: fit(train, algorithm, features, label, params) for name, (algorithm, params) in bases.items()}

    def add(rows: DataFrame, name: str) -> DataFrame:
        scored = predict(models[name], rows, features)
        return scored.withColumnRenamed("p" if problem_of(bases[name][0]) == "binary" else "pred", name).drop("pred", "p")

    held = cut_lineage(reduce(add, models, val), "blend")
    return Stack(models, fit(held, "logistic", list(models), label), list(features))
