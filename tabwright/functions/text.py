"""Rules over text columns: source kinds, goal types and business domains."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

# fixed values: prefixes that decide the source kind
DATABASE_SCHEMES = ["postgresql://", "postgres://", "mysql://", "sqlite://", "mssql://"]
CLOUD_MARKS = ["bigquery://", "snowflake://", "s3://", "az://", "gs://", "docs.google.com/spreadsheets"]
API_SCHEMES = ["http://", "https://"]

# fixed values: words that decide the kind of problem a goal describes
CLASSIFICATION_WORDS = [
    "predict", "churn", "fraud", "default", "will they", "classify", "detect", "identify", "flag",
    "score", "risk", "likelihood", "probability", "approve", "reject", "yes or no", "which category",
]
REGRESSION_WORDS = [
    "forecast", "estimate", "how much", "predict value", "how many", "revenue", "sales", "price",
    "demand", "quantity", "amount", "continuous", "numeric", "regression",
]
UNSUPERVISED_WORDS = [
    "segment", "cluster", "group", "find patterns", "anomaly", "outlier", "no labels", "discover",
    "explore", "similar", "communities", "topics", "reduce dimensions",
]
SEMI_SUPERVISED_WORDS = ["partial labels", "some labels", "few labels", "semi", "partially labelled"]

# fixed values: words that decide the business domain, in order of precedence
DOMAIN_WORDS = {
    "financial": ["loan", "credit", "bank", "transaction", "fraud", "default", "balance", "account"],
    "retail": ["order", "purchase", "product", "shop", "retail", "cart", "customer", "churn"],
    "hr": ["employee", "attrition", "tenure", "salary", "hr", "people", "promotion", "resignation"],
    "health": ["patient", "diagnosis", "clinical", "hospital", "health", "bmi", "disease", "medical"],
}


def any_word(words: Iterable[str], at_start: bool = False) -> str:
    """One alternation pattern for plain words, so a text is read once per rule."""
    body = "|".join(re.escape(w).replace(r"\ ", " ") for w in words)
    return f"^(?:{body})" if at_start else f"(?:{body})"


def holds_any(text: Column, words: Iterable[str]) -> Column:
    """Plain substring tests, which beat one large alternation pattern on long texts."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """A rule that reads a computed value many times, with the value computed once per row."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def classify_source(uri) -> Column:
    """FILE, DATABASE, CLOUD or API. The scheme is looked at before the file extension."""
    return once(F.lower(F.trim(col(uri))), lambda text: (
        F.when(text.rlike(any_word(DATABASE_SCHEMES, at_start=True)), "DATABASE")
        .when(text.rlike(any_word(CLOUD_MARKS)), "CLOUD")
        .when(text.rlike(any_word(API_SCHEMES, at_start=True)), "API")
        .otherwise("FILE")
    ))


def classify_goal(goal) -> Column:
    """Struct (problem_type, subtype) of a goal text; each word list is looked for once at most."""
    answer = lambda kind, subtype: F.struct(F.lit(kind).alias("problem_type"), F.lit(subtype).cast("string").alias("subtype"))
    return once(F.lower(col(goal)), lambda text: (
        F.when(holds_any(text, SEMI_SUPERVISED_WORDS), answer("SEMI-SUPERVISED", None))
        .when(holds_any(text, CLASSIFICATION_WORDS), answer("SUPERVISED", "Classification"))
        .when(holds_any(text, UNSUPERVISED_WORDS), answer("UNSUPERVISED", "clustering/anomaly"))
        .when(holds_any(text, REGRESSION_WORDS), answer("SUPERVISED", "Regression"))
        .otherwise(answer("AMBIGUOUS", None))))


def infer_domain(goal) -> Column:
    """First domain any of whose words occurs; NULL when none does."""
    def first(text: Column) -> Column:
        rule = None
        for domain, words in DOMAIN_WORDS.items():
            hit = holds_any(text, words)
            rule = F.when(hit, domain) if rule is None else rule.when(hit, domain)
        return rule

    return once(F.lower(col(goal)), first)
