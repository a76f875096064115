"""The whole cleaning pass as one fit and one apply."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .clean import AUDIT_SCHEMA, NullPolicy, Winsorizer, audit_table, dedup_counts, deduplicate, recast, text_kinds
from .encode import CategoryEncoder, Standardizer


@dataclass
class Preprocessor:
    """Missing values, outliers, types, categories, scale: fitted on one table, applied to any."""

    nulls: NullPolicy
    outliers: Winsorizer
    kinds: dict[str, str]
    categories: CategoryEncoder
    scale: Standardizer
    audit_rows: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, target: str | None = None, orders: Mapping[str, Sequence[str]] | None = None,
            keys: Iterable[str] = ()) -> "Preprocessor":
        fixed = [*keys, *([target] if target else [])]
        nulls = NullPolicy.fit(df, exclude=fixed)
        step = nulls.apply(df)
        outliers = Winsorizer.fit(step, exclude=fixed)
        clipped = outliers.apply(step)
        kinds = {c: k for c, k in text_kinds(clipped).items() if c not in fixed and c not in (orders or {})}
        typed = recast(clipped, kinds)
        categories = CategoryEncoder.fit(typed, target, orders, exclude=fixed)
        encoded = categories.apply(typed)
        scale = Standardizer.fit(encoded, exclude=fixed)
        audit = reduce(DataFrame.unionByName, [
            nulls.audit(df), outliers.audit(step),
            audit_table(df, [("types", c, "RECAST", f"string to {k}", None) for c, k in kinds.items()]),
            categories.audit(df), scale.audit(df),
        ])
        return cls(nulls, outliers, kinds, categories, scale, audit)

    def save(self, spark: SparkSession, path: str) -> None:
        """Fitted values as one JSON record; frequency tables, which follow the data, as tables beside it."""
        shares = sorted(self.categories.shares)
        state = {
            "actions": self.nulls.actions, "shares": self.nulls.shares, "fills": self.nulls.fills, "bounds": self.outliers.bounds, "kinds": self.kinds,
            "plan": self.categories.plan, "orders": self.categories.orders, "known": self.categories.known, "stats": self.scale.stats, "frequencies": shares}
        text = json.dumps(state, default=str)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
        self.audit_rows.coalesce(1).write.mode("overwrite").json(f"{path}/audit")
        for i, c in enumerate(shares):
            self.categories.shares[c].write.mode("overwrite").parquet(f"{path}/frequency={i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Preprocessor":
        s = json.loads(spark.read.text(f"{path}/state").first()[0])
        pairs = lambda d: {k: tuple(v) for k, v in d.items()}
        shares = {c: spark.read.parquet(f"{path}/frequency={i}") for i, c in enumerate(s["frequencies"])}
        audit = spark.read.schema(AUDIT_SCHEMA).json(f"{path}/audit")
        return cls(NullPolicy(s["actions"], s["shares"], s["fills"]), Winsorizer(pairs(s["bounds"])), s["kinds"],
                   CategoryEncoder(s["plan"], s["orders"], s["known"], shares), Standardizer(pairs(s["stats"])), audit)

    def apply(self, df: DataFrame) -> DataFrame:
        typed = recast(self.outliers.apply(self.nulls.apply(df)), self.kinds)
        return self.scale.apply(self.categories.apply(typed))


def preprocess(df: DataFrame, target: str | None = None, orders: Mapping[str, Sequence[str]] | None = None,
               keys: Iterable[str] = (), fit_on: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """De-duplicate, then fit (on ``fit_on`` if given) and apply. Returns the table and its audit."""
    rows = cut_lineage(deduplicate(df), "distinct-rows")  # the fit reads it about ten times
    fitted = Preprocessor.fit(fit_on if fit_on is not None else rows, target, orders, keys)
    removed = dedup_counts(df).select(
        F.lit("duplicates").alias("step"), F.lit(None).cast("string").alias("column"),
        F.lit("REMOVED").alias("action"), F.lit("exact copies").alias("reason"),
        F.col("removed").cast("string").alias("value"),
    )
    return fitted.apply(rows), removed.unionByName(fitted.audit_rows)
