"""Nearest rows by exact distances inside blocks of rows that projections put next to each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import col
from ..session import cut_lineage
from .prefix import row_numbers

#: entries become whole numbers of this share of a unit, so that distances and projections are exact
UNIT = 65_536
#: rows of a block, and orders in which blocks are cut
BLOCK, ORDERS = 256, 4


def signs(order: int, width: int) -> list[int]:
    """The +1 and -1 by which an order's projection adds up a vector's entries: parities of binary digits, as in a Walsh matrix."""
    return [-1 if bin((order + 1) * 37 & (i + 1)).count("1") % 2 else 1 for i in range(width)]


def whole(vector: str) -> Column:
    return F.transform(col(vector), lambda v: F.floor(v.cast("double") * UNIT).cast("long"))


def nearest_rows(df: DataFrame, key: str, vector: str, width: int, k: int = 10, block: int = BLOCK, orders: int = ORDERS) -> DataFrame:
    """A written table (id, other, d2, rank): the ``k`` nearest other rows found for each row, nearest first, smaller ids first on ties.

    ``key`` must be unique. Rows are ordered by a projection of their vectors, then by key, and cut into blocks of
    ``block`` rows, once for each of ``orders`` projections; distances are exact within a block, so a neighbour is missed
    only if no block holds both. No block grows with the table or with the number of equal vectors. Vectors that are
    null, of another length than ``width``, or hold a null or non-finite entry take no part. ``d2`` is the squared distance in whole
    units of 1 / `UNIT`.
    """
    fit = F.col("_v").isNotNull() & (F.size("_v") == width) & F.forall("_v", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v) < float("inf")))
    rows = cut_lineage(df.select(col(key).alias("id"), col(vector).alias("_v")).filter(fit).select("id", whole("_v").alias("x")), "whole-vectors")
    found = None
    for order in range(orders):
        s = F.array(*[F.lit(v).cast("long") for v in signs(order, width)])
        place = F.aggregate(F.zip_with("x", s, lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
        placed = row_numbers(rows.withColumn("place", place), [F.col("place").asc(), F.col("id").asc()], "at")
        near = placed.withColumn("block", F.floor((F.col("at") - 1) / block)).groupBy("block").applyInArrow(_inside(k), "id long, other long, d2 long")
        found = near if found is None else found.unionByName(near)
    best = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "other")))
    return cut_lineage(best.filter(F.col("rank") <= k), "nearest")


def _inside(k: int):
    def search(rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        x = np.stack([np.asarray(v) for v in rows.column("x").to_pylist()]).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        own = (x * x).sum(axis=1)
        d2 = own[:, None] + own[None, :] - 2 * (x @ x.T)
        d2[np.arange(len(ids)), np.arange(len(ids))] = np.iinfo(np.int64).max
        take = min(k, len(ids) - 1)
        at = np.argsort(d2, axis=1, kind="stable")[:, :take]  # equal distances by id
        return pa.table({"id": np.repeat(ids, take), "other": ids[at].ravel(), "d2": np.take_along_axis(d2, at, axis=1).ravel()})
    return search


def nearest_sql(table: str, key: str, vector: str, width: int, k: int, block: int = BLOCK, orders: int = ORDERS) -> str:
    """The same as common table expressions ``whole_vectors`` and ``nearest``."""
    places = " union all ".join(
        f"""select {o} as o, id, x, (row_number() over (order by list_sum(list_transform(list_zip(x, {signs(o, width)}), lambda z: z[1] * z[2])), id) - 1) // {block} as block from whole_vectors"""
        for o in range(orders))
    return f"""whole_vectors as (select {key} as id, list_transform({vector}, lambda v: floor(v::double * {UNIT})::bigint) as x from {table}),
    placed as ({places}),
    pairs as (select distinct a.id, b.id as other, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d2
              from placed a join placed b on a.o = b.o and a.block = b.block and a.id <> b.id),
    nearest as (select * from (select *, row_number() over (partition by id order by d2, other) as rank from pairs) where rank <= {k})"""


def outlier_factors(nearest: DataFrame) -> DataFrame:
    """Local outlier factor per row of a `nearest_rows` table: (id, k_distance, density, lof).

    A row's k-distance is that of its last neighbour, its reachability from another row the larger of that row's
    k-distance and their distance, its density the inverse of the mean reachability from its neighbours, and its factor
    the neighbours' mean density over its own: about 1 inside a cluster, more for an outlier. Exactly k neighbours count;
    of others as far as the last one, those with smaller ids. Where a row and its neighbours are all equal the mean
    reachability counts as 1e-9, so that such rows have factor 1.
    """
    d = nearest.select("id", "other", F.sqrt("d2").alias("d"))
    reach = nearest.groupBy("id").agg((F.sqrt(F.max("d2"))).alias("k_distance"))
    edges = d.join(reach.withColumnsRenamed({"id": "other", "k_distance": "_k"}), "other")
    density = edges.groupBy("id").agg((1 / F.greatest(F.avg(F.greatest("_k", "d")), F.lit(1e-9))).alias("density"))
    density = cut_lineage(density.join(reach, "id"), "densities")
    around = d.join(density.select(F.col("id").alias("other"), F.col("density").alias("_d")), "other").groupBy("id").agg(F.avg("_d").alias("_around"))
    return density.join(around, "id").select("id", "k_distance", "density", (F.col("_around") / F.col("density")).alias("lof"))


def propagate(nearest: DataFrame, labels: DataFrame, key: str, label: str, k: int, rounds: int = 30) -> DataFrame:
    """Label propagation over a `nearest_rows` table: (key, label, given, round).

    Each edge counts in both directions with weight k + 1 - rank, the nearest most. In a round every row without a given
    label takes the label with the largest total weight among its neighbours' labels of the round before, the smallest
    label on ties; rows without a labelled neighbour keep theirs or stay null. Given labels never change. Votes are
    added up map-side, so a row that is near to many costs one sum a task. Every round is written; it ends when no label changes, or
    after ``rounds``. ``round`` is the last one that changed a row's label, 0 for given and for missing labels.
    """
    edges = nearest.select("id", "other", (F.lit(k + 1) - F.col("rank")).alias("w"))
    edges = cut_lineage(edges.unionByName(edges.select(F.col("other").alias("id"), F.col("id").alias("other"), "w")).groupBy("id", "other").agg(F.sum("w").alias("w")), "edges")
    state = cut_lineage(labels.select(col(key).alias("id"), col(label).alias("label"), col(label).isNotNull().alias("given"), F.lit(0).alias("round")), "labels")
    for i in range(1, rounds + 1):
        known = state.filter(F.col("label").isNotNull()).select(F.col("id").alias("other"), F.col("label").alias("vote"))
        votes = edges.join(known, "other").groupBy("id", "vote").agg(F.sum("w").alias("w"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("vote"))).alias("best")).select("id", F.col("best.vote").alias("vote"))
        new = F.when(F.col("given"), F.col("label")).otherwise(F.coalesce("vote", "label"))
        moved = ~new.eqNullSafe(F.col("label"))
        after = state.join(best, "id", "left").select("id", new.alias("label"), "given", F.when(moved, i).otherwise(F.col("round")).alias("round"))
        state = cut_lineage(after, f"round-{i}")
        if not state.filter(F.col("round") == i).limit(1).count():
            break
    return state.select(F.col("id").alias(key), F.col("label").alias(label), "given", "round")


def propagate_sql(labels: str, rounds: int, k: int) -> str:
    """Common table expressions ``edges`` and ``r0`` to ``r<rounds>`` of the same rounds, after `nearest_sql`; ``labels`` has id and label."""
    steps = [f"r0 as (select id, label, label is not null as given, 0 as round from ({labels}))"]
    for i in range(1, rounds + 1):
        steps.append(f"""v{i} as (select e.id, s.label as vote, sum(e.w) as w from edges e join r{i - 1} s on s.id = e.other where s.label is not null group by e.id, s.label),
    b{i} as (select id, vote from (select *, row_number() over (partition by id order by w desc, vote) as n from v{i}) where n = 1),
    n{i} as (select s.*, case when s.given then s.label else coalesce(b.vote, s.label) end as new from r{i - 1} s left join b{i} b on b.id = s.id),
    r{i} as (select id, new as label, given, case when new is distinct from label then {i} else round end as round from n{i})""")
    return f"""edges as (select id, other, sum(w) as w from (select id, other, {k + 1} - rank as w from nearest union all select other, id, {k + 1} - rank from nearest) group by id, other),
    """ + ",\n    ".join(steps)
