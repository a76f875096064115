"""Density clustering of any number of rows by a grid whose cells are small enough to be clusters of their own."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_double, col
from ..session import cut_lineage
from .prefix import row_numbers

NOISE = -1
#: halvings after which boxes are below what doubles tell apart; the few points in them are then compared
DEEPEST = 40


def _d2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda s, t: s + t, [(p - q) * (p - q) for p, q in zip(a, b)])


def _around(dims: int) -> list[tuple[int, ...]]:
    """Offsets of the cells that can hold a point within reach: cells of side eps / sqrt(dims), their own left out."""
    reach = math.ceil(math.sqrt(dims))
    near = itertools.product(range(-reach, reach + 1), repeat=dims)
    return [o for o in near if any(o) and sum(max(abs(v) - 1, 0) ** 2 for v in o) < dims]


def _points(df: DataFrame, features: Sequence[str], eps: float) -> DataFrame:
    """Distinct points: x0, x1, ..., their cell c0, c1, ... and how many rows lie there."""
    side, n = eps / math.sqrt(len(features)), range(len(features))
    rows = df.select(*[clean_double(f).alias(f"x{i}") for i, f in enumerate(features)]).dropna()
    points = rows.groupBy(*[f"x{i}" for i in n]).agg(F.count(F.lit(1)).alias("copies"))
    return points.withColumns({f"c{i}": F.floor(F.col(f"x{i}") / side).cast("long") for i in n})


def _meetings(few: DataFrame, all_points: DataFrame, dims: int, eps: float, keep: Sequence[str]) -> DataFrame:
    """(x of ``few`` as p0, ..., and ``keep`` of a point of ``all_points`` within ``eps`` of it, own cell left out).

    ``few`` has a bounded number of points a cell, so each point of the other side meets a bounded number, however many
    share its cell; a large cell's rows are split by adaptive execution.
    """
    n = range(dims)
    offsets = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"o{i}") for i, v in enumerate(o)]) for o in _around(dims)])).alias("_o")
    sent = few.select(*[F.col(f"x{i}").alias(f"p{i}") for i in n], *[f"c{i}" for i in n], offsets)
    sent = sent.select(*[f"p{i}" for i in n], *[(F.col(f"c{i}") + F.col(f"_o.o{i}")).alias(f"c{i}") for i in n])
    joined = all_points.select(*[f"c{i}" for i in n], *[f"x{i}" for i in n], *keep).join(sent, [f"c{i}" for i in n])
    return joined.filter(_d2([F.col(f"x{i}") for i in n], [F.col(f"p{i}") for i in n]) <= eps * eps)


def _linked_cells(cores: DataFrame, dims: int, eps: float) -> DataFrame:
    """Pairs (a, b) of neighbouring cells, as arrays, with core points within ``eps`` of each other.

    Boxes around the core points of two cells are compared: apart by more than ``eps``, or with all corners within it, they
    decide the pair; else both are cut in halves of each side, and halves that cannot matter are left behind. Undecided boxes lie
    along the distance ``eps``, and a box of one point decides, so neither side's points are ever paired.
    """
    n = range(dims)
    side = eps / math.sqrt(dims)

    def boxes(level: int) -> DataFrame:
        part = [F.floor((F.col(f"x{i}") / side - F.col(f"c{i}")) * 2**level).cast("long").alias(f"s{i}") for i in n]
        made = cores.select(F.array(*[f"c{i}" for i in n]).alias("cell"), *[f"x{i}" for i in n], *part)
        return made.groupBy("cell", F.array(*[f"s{i}" for i in n]).alias("part")).agg(
            *[F.min(f"x{i}").alias(f"l{i}") for i in n], *[F.max(f"x{i}").alias(f"h{i}") for i in n])

    def judged(pairs: DataFrame) -> DataFrame:
        apart = [F.greatest(F.col(f"al{i}") - F.col(f"bh{i}"), F.col(f"bl{i}") - F.col(f"ah{i}"), F.lit(0.0)) for i in n]
        across = [F.greatest(F.col(f"ah{i}") - F.col(f"bl{i}"), F.col(f"bh{i}") - F.col(f"al{i}")) for i in n]
        total = lambda terms: reduce(lambda s, t: s + t, [t * t for t in terms])
        return pairs.withColumn("least", total(apart)).withColumn("most", total(across)).filter(F.col("least") <= eps * eps)

    def side_of(level: DataFrame, who: str) -> DataFrame:
        return level.select(F.col("cell").alias(who), F.col("part").alias(f"{who}part"), *[F.col(f"{e}{i}").alias(f"{who}{e}{i}") for e in "lh" for i in n])

    level = cut_lineage(boxes(0), "boxes-0")
    near = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in _around(dims) if o > (0,) * dims])
    first = side_of(level, "a").withColumn("_o", F.explode(near))
    first = first.withColumn("b", F.zip_with("a", "_o", lambda x, y: x + y)).drop("_o")
    open_pairs = cut_lineage(judged(first.join(side_of(level, "b"), "b")), "open-0")
    done, at = None, 0
    while True:
        # a box of one point has least = most
        found = cut_lineage(open_pairs.filter(F.col("most") <= eps * eps).select("a", "b").distinct(), f"linked-{at}")
        done = found if done is None else done.unionByName(found)
        left = cut_lineage(open_pairs.join(found, ["a", "b"], "left_anti"), f"open-{at}")
        if not left.limit(1).count():
            return done
        if at == DEEPEST:
            part = F.array(*[F.floor((F.col(f"x{i}") / side - F.col(f"c{i}")) * 2**at).cast("long") for i in n])
            of = lambda who: cores.select(F.array(*[f"c{i}" for i in n]).alias(who), part.alias(f"{who}part"), *[F.col(f"x{i}").alias(f"{who}{i}") for i in n])
            met = left.select("a", "apart", "b", "bpart").join(of("a"), ["a", "apart"]).join(of("b"), ["b", "bpart"])
            return done.unionByName(met.filter(_d2([F.col(f"a{i}") for i in n], [F.col(f"b{i}") for i in n]) <= eps * eps).select("a", "b").distinct())
        at += 1
        halves = cut_lineage(boxes(at), f"boxes-{at}")
        pairs = left.select("a", "apart", "b", "bpart")
        for who in "ab":
            half = side_of(halves, who).withColumn("_up", F.transform(f"{who}part", lambda v: F.floor(v / 2).cast("long")))
            pairs = pairs.withColumnRenamed(f"{who}part", "_up").join(half, [who, "_up"]).drop("_up")
        open_pairs = cut_lineage(judged(pairs), f"halves-{at}")


def _components(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, label): the smallest cell that links lead to, by minimum labels with a jump each round, every round written."""
    edges = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cell-edges")
    state = cut_lineage(cells.select("cell", F.col("cell").alias("label")), "cell-labels")
    while True:
        around = edges.join(state.select(F.col("cell").alias("b"), "label"), "b").groupBy(F.col("a").alias("cell")).agg(F.min("label").alias("_near"))
        low = cut_lineage(state.join(around, "cell", "left").select("cell", F.least("label", F.coalesce("_near", "label")).alias("low"), "label"), "cell-lower")
        jump = low.select(F.col("cell").alias("low"), F.col("low").alias("_jump"))
        after = cut_lineage(low.join(jump, "low").select("cell", F.least("low", "_jump").alias("new"), "label"), "cell-labels")
        if not after.filter(F.col("new") != F.col("label")).limit(1).count():
            return after.select("cell", "label")
        state = after.select("cell", F.col("new").alias("label"))


def density_clusters(df: DataFrame, features: Sequence[str], eps: float, least: int) -> DataFrame:
    """Rows (x0, x1, ..., copies, core, cluster), one per distinct point of ``features``: a density clustering of all rows.

    A point is core if at least ``least`` rows, its own among them, lie within ``eps``. Core points within ``eps`` of each
    other share a cluster, named by its smallest core point: clusters are numbered 0, 1, ... in the order of those. Another point within ``eps`` of
    core points goes to the smallest of their clusters, the rest is noise, -1. Rows with a missing or non-finite feature take no part.

    Cells have side eps / sqrt(number of features), so rows of one cell are all within reach: a cell with ``least`` rows is
    core without a comparison, and points of the others, fewer than ``least`` a cell, are all that is ever compared.
    """
    dims = len(features)
    n, cell = range(dims), [f"c{i}" for i in range(dims)]
    own = [f"x{i}" for i in n]
    points = cut_lineage(_points(df, features, eps), "points")
    sizes = points.groupBy(*cell).agg(F.sum("copies").alias("inside"))
    points = cut_lineage(points.join(sizes, cell), "sized")
    sparse = points.filter(F.col("inside") < least)
    counts = _meetings(sparse, points, dims, eps, ["copies"]).groupBy(*[f"p{i}" for i in n]).agg(F.sum("copies").alias("outside"))
    counts = counts.withColumnsRenamed({f"p{i}": f"x{i}" for i in n})
    marked = sparse.join(counts, own, "left").withColumn("core", F.col("inside") + F.coalesce("outside", F.lit(0)) >= least).drop("outside")
    marked = cut_lineage(points.filter(F.col("inside") >= least).withColumn("core", F.lit(True)).unionByName(marked), "marked")
    cores = marked.filter("core")
    cells = cores.groupBy(F.array(*cell).alias("cell")).agg(F.min(F.struct(*own)).alias("first"))
    labels = _components(cells, _linked_cells(cores, dims, eps))
    firsts = cells.join(labels, "cell").groupBy("label").agg(F.min("first").alias("first"))
    firsts = firsts.select(F.col("label").alias("_label"), *[F.col("first")[f"x{i}"].alias(f"x{i}") for i in n])
    numbers = cut_lineage(row_numbers(firsts, [F.asc(c) for c in own], "cluster").select(F.col("_label").alias("label"), (F.col("cluster") - 1).alias("cluster")), "clusters")
    of_cell = cut_lineage(labels.join(numbers, "label").select(*[F.col("cell")[i].alias(f"c{i}") for i in n], "cluster"), "cell-clusters")
    clustered = cores.join(of_cell, cell)
    rest = marked.filter("not core")
    # a border point's own cell may hold core points; those of other cells are met as before
    inside = rest.select(*own, *cell).join(of_cell, cell).select(*own, "cluster")
    outside = _meetings(rest, clustered, dims, eps, ["cluster"]).select(*[F.col(f"p{i}").alias(f"x{i}") for i in n], "cluster")
    border = inside.unionByName(outside).groupBy(*own).agg(F.min("cluster").alias("cluster"))
    rest = rest.join(border, own, "left").withColumn("cluster", F.coalesce("cluster", F.lit(NOISE)))
    columns = [*own, "copies", "core", "cluster"]
    return clustered.select(columns).unionByName(rest.select(columns))


def append_density_cluster(df: DataFrame, features: Sequence[str], eps: float, least: int, name: str = "cluster") -> DataFrame:
    """``df`` with the cluster of every row as one more column, null where a feature is missing."""
    found = density_clusters(df, features, eps, least).select(*[F.col(f"x{i}").alias(f"_x{i}") for i in range(len(features))], F.col("cluster").alias("_cluster"))
    same = reduce(lambda a, b: a & b, [clean_double(f) == F.col(f"_x{i}") for i, f in enumerate(features)])
    return df.join(found, same, "left").select(*[col(c) for c in df.columns], F.col("_cluster").alias(name))


def density_sql(points: str, eps: float, least: int) -> str:
    """The same for two features by comparing all pairs: ``points`` is SQL that gives x0 and x1."""
    near = f"(a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) <= {eps * eps!r}"
    return f"""p as (select x0, x1, count(*) as copies, row_number() over (order by x0, x1) as i from ({points}) where x0 is not null and x1 is not null group by x0, x1),
    around as (select a.i, sum(b.copies) >= {least} as core from p a join p b on {near} group by a.i),
    q as (select p.*, core from p join around using (i)),
    links as (select a.i, b.i as j from q a join q b on a.core and b.core and {near}),
    reach as (select i as root, i as j from q where core union select r.root, l.j from reach r join links l on l.i = r.j),
    named as (select j as i, min(root) as root from reach group by j),
    numbered as (select i, dense_rank() over (order by root) - 1 as cluster from named),
    border as (select a.i, min(n.cluster) as cluster from q a join q b on not a.core and b.core and {near} join numbered n on n.i = b.i group by a.i),
    clustered as (select q.x0, q.x1, q.core, coalesce(n.cluster, d.cluster, {NOISE}) as cluster from q left join numbered n using (i) left join border d using (i))"""
