"""Merkle manifest of a dataset as a postorder append log.

Each value of a grouping column has a binary tree over its leaves in order; the trees' roots are the leaves of one more
tree. A tree's nodes are numbered in completion order, a node right after its last child, so a builder that owns an
aligned run of 2^`BITS` leaves writes a gapless stretch of the log without knowing of the others. Builders of the next
tier take the roots of 2^`BITS` such runs, and so on. Where a node lies follows in closed form from the sizes of the
subtrees before it, so a proof asks for its siblings by position and no node stores a link.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import written
from tabwright.operators.prefix import row_numbers

#: a builder takes 2^BITS nodes at most
BITS = 12
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]

NODES = "tree long, leaves long, tier int, block long, blocks long, root boolean, level int, index long, position long, digest binary"


def canonical(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[canonical(v) for v in values]), 256))


def joined(digests: list[bytes]) -> bytes:
    """The digest of digests, as hex text, one after the other."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def position(leaves: int, level: int, index):
    """Place in the log, from 0, of node ``index`` of a level, level 0 being the leaves; numbers or numpy arrays.

    Before it lie, of its own and lower levels, the nodes that end no later than it, and of higher levels those that end
    before it begins.
    """
    begin = index << level
    end = np.minimum((index + 1) << level, leaves)
    last = end == leaves
    before = sum(np.where(last, -(-leaves >> j), end >> j) for j in range(level + 1))
    return before + sum(begin >> j for j in range(level + 1, height(leaves) + 1)) - 1


def build_tier(items: DataFrame, tier: int, bits: int = BITS) -> DataFrame:
    """`NODES` that the builders of one tier write: of (tree, leaves, index, digest), each ``index`` a node of level ``bits`` x tier.

    Tier 0 writes the leaves themselves too. A builder's nodes are in completion order; ``root`` marks its last.
    """
    base = bits * tier

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        order = np.argsort(rows.column("index").to_numpy())
        digests = [d for d in rows.column("digest").take(pa.array(order)).to_pylist()]
        leaves, first = rows.column("leaves")[0].as_py(), block << bits
        top = min(base + bits, height(leaves))
        out = [(0, first, digests)] if tier == 0 else []
        for level in range(base + 1, top + 1):
            digests = [joined(digests[i:i + 2]) for i in range(0, len(digests), 2)]
            first >>= 1
            out.append((level, first, digests))
        level = np.repeat([h for h, _, _ in out], [len(d) for _, _, d in out])
        index = np.concatenate([np.arange(f, f + len(d)) for _, f, d in out])
        place = np.concatenate([position(leaves, h, np.arange(f, f + len(d))) for h, f, d in out])
        every = [d for _, _, ds in out for d in ds]
        done, n = np.argsort(place), len(place)
        blocks = -(-leaves >> (base + bits))
        return pa.table({
            "tree": pa.array([tree] * n, pa.int64()), "leaves": pa.array([leaves] * n, pa.int64()), "tier": pa.array([tier] * n, pa.int32()),
            "block": pa.array([block] * n, pa.int64()), "blocks": pa.array([blocks] * n, pa.int64()), "root": pa.array(level[done] == top),
            "level": pa.array(level[done], pa.int32()), "index": pa.array(index[done], pa.int64()), "position": pa.array(place[done], pa.int64()),
            "digest": pa.array([every[i] for i in done], pa.binary())})

    dealt = items.select("tree", F.shiftright("index", bits).alias("block"), "leaves", "index", "digest")
    return written(dealt.groupBy("tree", "block").applyInArrow(build, NODES), f"log-{tier}")


def build_log(leaves: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """The log of (tree, leaves, index, digest), tier by tier; ``leaves`` is the tree's number of leaves, ``index`` counts them from 0.

    A tree of n leaves is done after log2(n) / ``bits`` tiers. Its root is the node with ``root`` in the tier where it has one block.
    """
    tiers, items = [], leaves
    while True:
        nodes = build_tier(items, len(tiers), bits)
        tiers.append(nodes)
        if (nodes.agg(F.max("blocks")).first()[0] or 0) <= 1:
            return tiers
        items = nodes.where("root and blocks > 1").select("tree", "leaves", F.col("block").alias("index"), "digest")


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, tier, digest) of each tree's root."""
    out = None
    for nodes in tiers:
        own = nodes.where("root and blocks = 1").select("tree", "tier", "digest")
        out = own if out is None else out.unionByName(own)
    return out


def siblings(leaves: int, level: int, top: int, index: int) -> list[tuple[int, str]]:
    """Positions of the siblings of a node's way up to level ``top``, with the side they stand on; (-1, "-") where there is none."""
    out = []
    for h in range(level, top):
        other = index ^ 1
        out.append((int(position(leaves, h, other)), "L" if index & 1 else "R") if other < -(-leaves >> h) else (-1, "-"))
        index >>= 1
    return out


def climb(digest: bytes, path: str) -> bytes:
    """The root that a node and the path above it give. A path has, level by level, L or R and a digest in hex, or ``-``."""
    at = 0
    while at < len(path):
        if path[at] == "-":
            digest, at = joined([digest]), at + 1
            continue
        other = path[at + 1:at + 65]
        pair = other + digest.hex() if path[at] == "L" else digest.hex() + other
        digest, at = sha256(pair.encode()).digest(), at + 65
    return digest


def proof_digest(path: str) -> str:
    """Digest of the siblings of a path, in hex."""
    return sha256(path.translate(_SIDES).encode()).hexdigest()


_SIDES = str.maketrans("", "", "LR-")


class Segment:
    """The nodes that proofs through one block need, looked up by position."""

    def __init__(self, rows: pa.Table, tier: int, bits: int):
        self.leaves = rows.column("leaves")[0].as_py()
        self.base, place = bits * tier, rows.column("position").to_numpy()
        order = np.argsort(place)
        self.place, self.digest = place[order], rows.column("digest").take(pa.array(order)).to_pylist()
        self.top = min(self.base + bits, height(self.leaves))

    def path(self, index: int) -> str:
        """The way from node ``index`` of the block's lowest level to the block's root."""
        out = []
        for p, side in siblings(self.leaves, self.base, self.top, index):
            out.append(side if p < 0 else side + self.digest[int(np.searchsorted(self.place, p))].hex())
        return "".join(out)


def _needed(tiers: list[DataFrame], tier: int, bits: int) -> DataFrame:
    """Nodes by the block that asks for them: those the block wrote, and the roots it was built from."""
    keys = ["tree", "leaves", "position", "digest"]
    own = tiers[tier].select("block", *keys, F.lit(None).cast("long").alias("index"))
    if tier == 0:
        return own
    below = tiers[tier - 1].where("root and blocks > 1").select(F.shiftright("block", bits).alias("block"), *keys, F.col("block").alias("index"))
    return own.unionByName(below)


def upper_paths(tiers: list[DataFrame], above: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """Per tier (tree, block, path): the way from the block's root to the end, ``above`` being (tree, path) of the trees' roots."""
    ends = roots(tiers).join(above, "tree")
    out: list[DataFrame] = [None] * len(tiers)
    for tier in reversed(range(len(tiers))):
        own = ends.where(F.col("tier") == tier).select("tree", F.lit(0).cast("long").alias("block"), "path")
        if tier + 1 < len(tiers):
            asked = _needed(tiers, tier + 1, bits).withColumn("path", F.lit(None).cast("string"))
            given = out[tier + 1].select("tree", "block", "path")
            rows = asked.unionByName(given, allowMissingColumns=True)
            own = own.unionByName(rows.groupBy("tree", "block").applyInArrow(_ways(tier + 1, bits), "tree long, block long, path string"))
        out[tier] = written(own, f"paths-{tier}")
    return out


def _ways(tier: int, bits: int):
    """What a block of a tier, with the way above it, tells the blocks below."""
    def extract(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tree, _ = (k.as_py() for k in key)
        way = rows.column("path").drop_null()[0].as_py()
        nodes = rows.filter(pc.is_valid(rows.column("position")))
        segment, index = Segment(nodes, tier, bits), nodes.column("index").drop_null().to_pylist()
        return pa.table({"tree": pa.array([tree] * len(index), pa.int64()), "block": pa.array(index, pa.int64()),
                         "path": pa.array([segment.path(i) + way for i in index], pa.string())})
    return extract


def prove(tiers: list[DataFrame], above: DataFrame, asked: DataFrame, whole: bool = False, bits: int = BITS) -> DataFrame:
    """Proofs of (tree, index, key, digest): tree, index, key, proof_sha256, folded, and with ``whole`` the path.

    ``folded`` is the root that ``digest`` gives with the log's siblings; the true one exactly if it is the leaf in the log.
    Ways above a block are shared by all its rows, and so is what a block's root climbs to.
    """
    paths = upper_paths(tiers, above, bits)

    def extract(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tree, _ = (k.as_py() for k in key)
        kind = rows.column("kind").to_numpy()
        nodes, given, queries = [rows.filter(pa.array(kind == k)) for k in (0, 1, 2)]
        if not queries.num_rows:
            return pa.table({c: pa.array([], t) for c, t in types.items()})
        segment, up, known = Segment(nodes, 0, bits), given.column("path")[0].as_py(), {}
        index, digest = queries.column("index").to_pylist(), queries.column("digest").to_pylist()
        ways, folded = [segment.path(i) for i in index], []
        for way, d in zip(ways, digest):
            d = climb(d, way)
            if d not in known:
                known[d] = climb(d, up)
            folded.append(known[d])
        out = {"tree": pa.array([tree] * len(index), pa.int64()), "index": pa.array(index, pa.int64()), "key": queries.column("key").combine_chunks(),
               "proof_sha256": pa.array([proof_digest(w + up) for w in ways]), "folded": pa.array(folded, pa.binary())}
        return pa.table(out | ({"path": pa.array([w + up for w in ways])} if whole else {}))

    types = {"tree": pa.int64(), "index": pa.int64(), "key": pa.int64(), "proof_sha256": pa.string(), "folded": pa.binary()} | ({"path": pa.string()} if whole else {})
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    rows = (kind(_needed(tiers, 0, bits), 0).unionByName(kind(paths[0], 1), allowMissingColumns=True)
            .unionByName(kind(asked.select("tree", F.shiftright("index", bits).alias("block"), "index", "key", "digest"), 2), allowMissingColumns=True))
    schema = "tree long, index long, key long, proof_sha256 string, folded binary" + (", path string" if whole else "")
    return rows.groupBy("tree", "block").applyInArrow(extract, schema)


def placed(df: DataFrame, columns: list[str] = COLUMNS, key: str = "doc_id", group: str = "lang", tampered: str = "n_chars") -> DataFrame:
    """A written table of the leaves: key, grp, leaf, changed (of a tampered row), tree, index and leaves of its tree, trees.

    Trees are numbered by their group's value, null first, and leaves within by key, null first; rows that share a key
    stand by their leaves. Any number of equal rows is spread by a row number.
    """
    values = [F.col(c) for c in columns]
    plus = F.col(tampered).cast("decimal(38,0)") + 1
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 0
    changed = F.when(hit & F.col(tampered).isNotNull(), leaf_digest([plus if c == tampered else F.col(c) for c in columns]))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(group).cast("string").alias("grp"), leaf_digest(values).alias("leaf"), changed.alias("changed"))
    rows = written(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    groups = rows.groupBy("grp").agg(F.count("*").alias("leaves"))
    trees = written(row_numbers(groups, [F.col("grp").asc_nulls_first()], "tree"), "trees")
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf").asc(), F.col("salt").asc()]
    numbered = row_numbers(rows, order, "index", by=["grp"])
    own = trees.select(F.col("grp").alias("_grp"), (F.col("tree") - 1).cast("long").alias("tree"), F.col("leaves").cast("long").alias("leaves"))
    out = numbered.join(own, F.col("grp").eqNullSafe(F.col("_grp")))
    return written(out.select("key", "leaf", "changed", "tree", (F.col("index") - 1).cast("long").alias("index"), "leaves"), "placed")


def manifest(df: DataFrame, columns: list[str] = COLUMNS, key: str = "doc_id", group: str = "lang", tampered: str = "n_chars", bits: int = BITS) -> DataFrame:
    """One row per row of ``df``: its key, leaf, subroot, root, proof_sha256, folded_root, verified; digests in hex.

    A leaf is the digest of ``columns``. Leaves of one value of ``group`` ascend by key, a null key first; those that share
    a key ascend by digest, and equal rows have equal leaves side by side. The groups' subroots, null first, give the
    root. ``folded_root`` is recomputed from the leaf after tampering, which adds 1 to ``tampered`` where 7 divides the
    CRC of the key, and the logged siblings; a null there, or a null key, stays as it is. Other columns are not read; an
    empty table gives an empty result.
    """
    rows = placed(df, columns, key, group, tampered)
    tiers = build_log(rows.select("tree", "leaves", "index", F.col("leaf").alias("digest")), bits)
    subroots = written(roots(tiers).select("tree", "digest"), "subroots")
    trees = subroots.count()
    top = build_log(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("leaves"), F.col("tree").alias("index"), "digest"), bits)
    end = roots(top).select("tree", F.lit("").alias("path"))
    asked = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.col("tree").alias("key"), "digest")
    above = written(prove(top, end, asked, whole=True, bits=bits).select(F.col("index").alias("tree"), "path"), "above")
    proofs = prove(tiers, above, rows.select("tree", "index", "key", F.coalesce("changed", "leaf").alias("digest")), bits=bits)
    hexed = lambda c: F.lower(F.hex(c))
    one = roots(top).agg(F.max("digest").alias("root")).first().root
    facts = rows.select("tree", "index", hexed("leaf").alias("leaf")).join(subroots.select("tree", hexed("digest").alias("subroot")), "tree")
    root = F.lit(one.hex() if one is not None else None).cast("string")
    return proofs.join(facts, ["tree", "index"]).select(
        F.col("key").alias(key), "leaf", "subroot", root.alias("root"), "proof_sha256", hexed("folded").alias("folded_root"), (hexed("folded") == root).alias("verified"))


def manifest_sql(table: str = "documents") -> str:
    """The same in SQL."""
    value = lambda c: f"coalesce(strlen(({c})::varchar) || ':' || ({c})::varchar, '-')"
    leaf = lambda chars: "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"

    def tree(name, source):
        return f"""{name} as (
            select 0 as h, grp, i, leaf as d, count(*) over (partition by grp) as cnt from {source}
            union all
            select h + 1, grp, i // 2, sha256(string_agg(d, '' order by i)), (cnt + 1) // 2 from {name} where cnt > 1 group by h, grp, i // 2, cnt)"""

    def steps(name, nodes, leaves):  # one row per leaf and level, with the sibling or null
        return f"""{name} as (select l.grp, l.i, n.h, s.d as sibling, (l.i >> n.h) & 1 as bit
            from {leaves} l join (select distinct h, grp, cnt from {nodes}) n on n.grp is not distinct from l.grp and n.cnt > 1
            left join {nodes} s on s.h = n.h and s.grp is not distinct from l.grp and s.i = xor(l.i >> n.h, 1::bigint))"""

    def fold(name, start, path):
        return f"""{name} as (
            select grp, i, d, 0 as h from {start}
            union all
            select f.grp, f.i, sha256(case when s.sibling is null then f.d when s.bit = 1 then s.sibling || f.d else f.d || s.sibling end), f.h + 1
            from {name} f join {path} s on s.grp is not distinct from f.grp and s.i = f.i and s.h = f.h)"""

    return f"""
    with recursive crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
            lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as t),
    d as (select *, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
                                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) as crc from {table}, crc),
    leaves as (select doc_id, lang as grp, {leaf("n_chars")} as leaf, {leaf("n_chars + 1")} as changed,
                      coalesce(xor(crc, 4294967295::bigint) % 7 = 0 and n_chars is not null and doc_id is not null, false) as hit from d),
    placed as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as i from leaves),
    {tree("nodes", "placed")},
    subroots as (select grp, d as leaf from nodes where cnt = 1),
    ranked as (select 0 as grp, row_number() over (order by grp nulls first) - 1 as i, grp as lang, leaf from subroots),
    {tree("above", "(select grp, i, leaf from ranked)")},
    {steps("path", "nodes", "placed")},
    {steps("top", "above", "ranked")},
    proofs as (select grp, i, string_agg(coalesce(sibling, ''), '' order by h) as p from path group by grp, i),
    tops as (select i, string_agg(coalesce(sibling, ''), '' order by h) as p from top group by i),
    {fold("climb", "(select grp, i, case when hit then changed else leaf end as d from placed)", "path")},
    reached as (select grp, i, arg_max(d, h) as d from climb group by grp, i),
    starts as (select r.grp as lang, r.i as leaf_i, k.i as top_i, r.d from reached r join ranked k on k.lang is not distinct from r.grp),
    higher as (
        select lang, leaf_i, top_i, d, 0 as h from starts
        union all
        select f.lang, f.leaf_i, f.top_i, sha256(case when s.sibling is null then f.d when s.bit = 1 then s.sibling || f.d else f.d || s.sibling end), f.h + 1
        from higher f join top s on s.i = f.top_i and s.h = f.h),
    ends as (select lang, leaf_i, arg_max(d, h) as d from higher group by lang, leaf_i)
    select p.doc_id, p.leaf, s.leaf as subroot, (select d from above where cnt = 1) as root, sha256(coalesce(q.p, '') || coalesce(t.p, '')) as proof_sha256,
           e.d as folded_root, e.d = (select d from above where cnt = 1) as verified
    from placed p join subroots s on s.grp is not distinct from p.grp join ranked k on k.lang is not distinct from p.grp
    join ends e on e.lang is not distinct from p.grp and e.leaf_i = p.i
    left join proofs q on q.grp is not distinct from p.grp and q.i = p.i left join tops t on t.i = k.i"""
