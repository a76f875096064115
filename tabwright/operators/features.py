"""Feature construction: recency-frequency-value, domain features, dates, interactions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import clean_double, col
from ..session import cut_lineage
from .aggregates import correlations, numeric_columns, pairs, quantile_values, wide_agg
from .joins import left_enrich
from .quality import skew_report

QUINTILES = [0.2, 0.4, 0.6, 0.8]


def rfm_base(df: DataFrame, key: str, value: str, date: str, reference=None) -> DataFrame:
    """Per key: days since the last date, count, mean value, total value.

    The aggregate is combined map-side, so a heavy key costs one row per task.
    """
    if reference is None:
        reference = df.agg(F.max(col(date))).first()[0]
    when = col(date).try_cast("timestamp") if dict(df.dtypes)[date] == "string" else col(date)
    per_key = df.groupBy(key).agg(
        F.max(when).alias("last_date"), F.count(col(date)).alias("purchase_frequency"),
        F.sum(clean_double(value)).alias("total_revenue"), F.count(clean_double(value)).alias("_n"),
    )
    total = F.col("total_revenue")
    return per_key.select(
        key, S.days_since("last_date", F.lit(reference)).alias("recency"), "purchase_frequency",
        F.try_divide(total, F.col("_n")).alias("avg_order_value"), total.alias("total_revenue"),
    )


def qcut(df: DataFrame, name: str, q: int = 5) -> Column:
    """Quantile-band score 1..q by value edges: equal values share a score."""
    edges = quantile_values(df, [name], [i / q for i in range(1, q)])[name]
    return S.edge_rank(name, edges)


def rfm(df: DataFrame, key: str, value: str, date: str, reference=None, recency_inverted: bool = True) -> DataFrame:
    """One row per key with lifetime value, three quintile scores and their sum (3-15)."""
    base = cut_lineage(rfm_base(df, key, value, date, reference), "per-key")
    edges = quantile_values(base, ["recency", "purchase_frequency", "avg_order_value"], QUINTILES)
    recency = S.edge_rank("recency", edges["recency"])
    if recency_inverted:
        recency = F.lit(6) - recency
    scored = base.select(
        "*", (F.col("purchase_frequency") * F.col("avg_order_value")).alias("customer_lifetime_value"),
        recency.alias("rfm_r"),
        S.edge_rank("purchase_frequency", edges["purchase_frequency"]).alias("rfm_f"),
        S.edge_rank("avg_order_value", edges["avg_order_value"]).alias("rfm_m"),
    )
    return scored.withColumn("rfm_score", F.col("rfm_r") + F.col("rfm_f") + F.col("rfm_m"))


def varying_hours(df: DataFrame, cols: Sequence[str]) -> dict[str, bool]:
    """Which date columns have more than one hour of the day."""
    return {c: bool(v) for c, v in wide_agg(df, {c: F.min(F.hour(col(c))) != F.max(F.hour(col(c))) for c in cols}).items()} if cols else {}


def date_features(df: DataFrame, cols: Sequence[str], hours: Mapping[str, bool] | None = None) -> DataFrame:
    """Calendar parts with sin/cos forms; the hour only where it varies, here or as given."""
    hours = varying_hours(df, cols) if hours is None else hours
    made: dict[str, Column] = {}
    for c in cols:
        with_hour = bool(hours[c])
        made.update(S.date_parts(c, with_hour))
        circles = [("month", F.month(col(c)), 12), ("dow", F.weekday(col(c)), 7)]
        if with_hour:
            circles.append(("hour", F.hour(col(c)), 24))
        for part, value, period in circles:
            made[f"{c}_{part}_sin"], made[f"{c}_{part}_cos"] = S.cyclic(value, period)
    return df.withColumns(made)


def interactions(df: DataFrame, wanted: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Named combinations of two columns; unknown columns or operations are passed over."""
    makers = {
        "multiply": ("x", lambda a, b: col(a) * col(b)),
        "divide": ("over", S.null_ratio),
        "ratio": ("over", S.null_ratio),
        "add": ("plus", lambda a, b: col(a) + col(b)),
        "subtract": ("minus", lambda a, b: col(a) - col(b)),
    }
    made = {}
    for a, b, op in wanted:
        if a in df.columns and b in df.columns and op in makers:
            word, fn = makers[op]
            made[f"{a}_{word}_{b}"] = fn(a, b)
    return df.withColumns(made) if made else df


def log1p_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_log1p": F.when(col(c) > -1, F.log1p(col(c))) for c in cols})


def activity_features(df: DataFrame, m: Mapping[str, str]) -> DataFrame:
    """Account-activity features: value per transaction, momentum, distress, intensity, complaints.

    ``m`` maps amount, count, amount_change, count_change, inactive, contacts,
    months, complaints and relationships to columns.
    """
    eps = F.lit(S.EPSILON)
    return df.withColumns({
        "avg_transaction_value": S.safe_ratio(m["amount"], m["count"]),
        "engagement_velocity": col(m["amount_change"]) * col(m["count_change"]),
        "re_engagement_signal": col(m["inactive"]) * col(m["contacts"]),
        "transaction_intensity": col(m["count"]) / (col(m["months"]) + eps),
        "complaint_rate": col(m["complaints"]) / (col(m["relationships"]) + eps),
    })


def financial_features(df: DataFrame, m: Mapping) -> DataFrame:
    made: dict[str, Column] = {}
    have = lambda *names: all(m.get(n) in df.columns for n in names)
    if have("transactions_30d", "tenure_months"):
        made["transaction_velocity"] = S.null_ratio(m["transactions_30d"], m["tenure_months"])
    balances = [c for c in m.get("monthly_balance_cols", []) if c in df.columns]
    if len(balances) >= 2:
        made["balance_volatility"] = S.row_cv(balances)
    if have("last_complaint_date"):
        reference = m.get("reference_date", F.current_date())
        made["days_since_last_complaint"] = S.days_since(m["last_complaint_date"], reference)
    if have("current_balance", "credit_limit"):
        used = S.utilisation(m["current_balance"], m["credit_limit"])
        made["credit_utilization"] = used
        made["high_credit_utilization_flag"] = S.as_flag(used > 0.80)
    return df.withColumns(made) if made else df


def retail_features(df: DataFrame, m: Mapping) -> DataFrame:
    key = m["customer_id_col"]
    scored = rfm(df, key, m["order_value_col"], m["order_date_col"], m.get("reference_date"))
    kept = scored.select(key, "recency", "purchase_frequency", "avg_order_value", "customer_lifetime_value", "rfm_score")
    return left_enrich(df, kept, key, count_col="purchase_frequency")


def hr_features(df: DataFrame, m: Mapping) -> DataFrame:
    made: dict[str, Column] = {}
    reference = m.get("reference_date", F.current_date())
    have = lambda *names: all(m.get(n) in df.columns for n in names)
    if have("hire_date_col"):
        tenure = S.months_since(m["hire_date_col"], reference)
        made["tenure_months"] = tenure
        made["tenure_bucket"] = S.cut(tenure, S.TENURE_EDGES, S.TENURE_LABELS)
    if have("last_promotion_col"):
        since = S.months_since(m["last_promotion_col"], reference)
        made["months_since_promotion"] = since
        if have("hire_date_col"):
            made["promotion_rate"] = S.null_ratio(since, made["tenure_months"])
    if have("salary_col", "salary_band_min_col", "salary_band_max_col"):
        made["salary_to_band_ratio"] = S.band_ratio(m["salary_col"], m["salary_band_min_col"], m["salary_band_max_col"])
    return df.withColumns(made) if made else df


def health_features(df: DataFrame, m: Mapping) -> DataFrame:
    made: dict[str, Column] = {}
    have = lambda *names: all(m.get(n) in df.columns for n in names)
    if have("weight_kg_col", "height_m_col"):
        bmi = S.ratio_sq(m["weight_kg_col"], m["height_m_col"])
        made["bmi"] = bmi
        made["bmi_category"] = S.cut(bmi, S.BMI_EDGES, S.BMI_LABELS)
    if have("age_col"):
        made["age_group"] = S.cut(m["age_col"], S.AGE_EDGES, S.AGE_LABELS)
    flags = [c for c in m.get("diagnosis_cols", []) if c in df.columns]
    if flags:
        made["comorbidity_count"] = S.row_sum(flags)
    return df.withColumns(made) if made else df


DOMAIN_FEATURES = {
    "financial": financial_features, "retail": retail_features, "hr": hr_features, "health": health_features,
}


def recommend_features(df: DataFrame, cols: Sequence[str], target: str, dates: Sequence[str] = (),
                       log_limit: float = 3.0, collinear_limit: float = 0.85, found: DataFrame | None = None,
                       skews: DataFrame | None = None) -> DataFrame:
    """Rows (kind, suggestion) from skew, collinearity, dates and the two strongest columns.

    ``found`` has the correlations of all pairs and with the target, ``skews`` the skew report; what is not given is computed.
    """
    spark = df.sparkSession
    cols = list(cols)
    found = found if found is not None else cut_lineage(correlations(df, pairs([*cols, target])), "correlations")
    skews = skews if skews is not None else skew_report(df, cols, limit=log_limit)
    logs = skews.filter("extreme").select(
        F.lit("log").alias("kind"), F.format_string("log1p(%s)", "column").alias("suggestion"))
    ratio = found.filter(F.col("column_b") != target).filter(F.abs("r") > collinear_limit).orderBy(
        F.desc(F.abs("r")), "column_a", "column_b").limit(1).select(
        F.lit("ratio").alias("kind"), F.format_string("%s / %s", "column_a", "column_b").alias("suggestion"))
    parts = spark.createDataFrame([("date parts", d) for d in dates], "kind string, suggestion string")
    top = found.filter(F.col("column_b") == target).select(F.col("column_a").alias("column"), F.abs("r").alias("abs_r")).filter("abs_r is not null").orderBy(
        F.desc("abs_r"), "column").limit(2)
    product = top.agg(F.max_by("column", "abs_r").alias("a"), F.min_by("column", "abs_r").alias("b")).filter(
        "a <> b").select(F.lit("product").alias("kind"), F.format_string("%s x %s", "a", "b").alias("suggestion"))
    return logs.unionByName(ratio).unionByName(parts).unionByName(product)


def engineer(df: DataFrame, domain: str | None = None, col_map: Mapping | None = None, dates: Sequence[str] = (),
             wanted: Sequence[tuple[str, str, str]] = (), hours: Mapping[str, bool] | None = None) -> DataFrame:
    """Domain features, then dates, then interactions."""
    out = DOMAIN_FEATURES[domain](df, col_map or {}) if domain in DOMAIN_FEATURES else df
    out = date_features(out, [d for d in dates if d in out.columns], hours) if dates else out
    return interactions(out, wanted)


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return numeric_columns(df, exclude)
