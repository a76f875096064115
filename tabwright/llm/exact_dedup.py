"""Exact duplicates, with frequent texts split off before the shuffle.

A frequent-items sketch (the Misra-Gries family, Spark's ``approx_top_k``) names digests that may be frequent; one exact
pass verifies them and finds which row stays. That bounded table is broadcast, so rows of frequent texts are decided
where they are read. All other digests are too rare to be skewed and take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import text_or_empty
from tabwright.session import cut_lineage

#: counters of the sketch: a digest in more than about rows / TRACKED rows is found for certain
TRACKED = 4_096
#: most digests that are split off, so the bound of the broadcast (about 100 bytes each)
HEAVY = 1_000
#: copies from which splitting off is worthwhile; rarer candidates go the ordinary way
LEAST_COPIES = 64
#: first-level sketches that are merged
SKETCHES = 64

SPACES = r"[\x20\x09-\x0D]+"


def digest(text: str):
    """Lowercase hex SHA-256 of the text with each run of white space made one space; null counts as empty."""
    return F.sha2(F.regexp_replace(text_or_empty(text), SPACES, " "), 256)


def heavy_winners(keys: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY, least: int = LEAST_COPIES) -> DataFrame:
    """The frequent digests of (doc_id, text_sha256) with their verified smallest doc_id and size; ``heavy`` rows at most."""
    sketched = (keys.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("part"))
                .agg(F.expr(f"approx_top_k_accumulate(text_sha256, {tracked})").alias("sketch"))
                .groupBy(F.lit(0).alias("all"))  # with a group, an empty table has no sketch to combine
                .agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch")))
    candidates = sketched.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {heavy})")).alias("c")).select(
        F.col("c.item").alias("text_sha256")).where("text_sha256 is not null")
    exact = (keys.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256")
             .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return exact.where(F.col("group_size") >= least)


def mark_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, and with ``carry`` the input row as ``row``.

    Of equal texts the smallest doc_id stays; a null doc_id comes after all others. Rows that repeat both text and doc_id
    keep one of them. Null texts equal empty ones. An empty table gives an empty result. Other columns, whatever their
    names, are only inside ``row``.
    """
    keys = cut_lineage(df.select(F.col(doc_id).alias("doc_id"), digest(text).alias("text_sha256")), "digests")
    winners = cut_lineage(heavy_winners(keys), "winners")
    rows = (df.select(F.col(doc_id).alias("doc_id"), digest(text).alias("text_sha256"), F.struct("*").alias("row"))
            if carry else keys)
    more = ["row"] if carry else []
    split = rows.join(F.broadcast(winners), "text_sha256", "left")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *more]
    heavy, winner = F.col("group_size").isNotNull(), F.col("doc_id").eqNullSafe(F.col("keep_id"))
    removed = split.where(heavy & ~winner).withColumn("kept", F.lit(False))
    group = Window.partitionBy("text_sha256")
    rest = (split.where(~heavy | winner)
            .withColumn("keep_id", F.coalesce("keep_id", F.min("doc_id").over(group)))
            .withColumn("group_size", F.coalesce("group_size", F.count("*").over(group)))
            .withColumn("kept", F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last())) == 1))
    return removed.select(out).unionByName(rest.select(out))


def drop_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Copies of frequent texts are dropped where they are read; of the others only the row that stays leaves the shuffle.
    """
    kept = mark_duplicates(df, doc_id, text, carry=True).where("kept")
    return kept.select("row.*")
