"""Near-duplicate texts: a join on the Jaccard similarity of word n-grams by a MinHash LSH forest.

Every text has a MinHash signature, dealt to trees as keys of `DEPTH` one-byte values. Sorting a tree's keys is a trie:
texts with a common prefix are candidates. The join begins with long prefixes and shortens them until the target recall:
a pair of similarity s shares a prefix of k values in one of T trees with probability P = 1 - (1 - s^k)^T, so the pairs
met so far, each weighted by 1 / P at its estimated similarity, tell how many there are in all.

No step lists the pairs of a group. Exact copies are one text from the start. A bucket of texts with a common prefix is
cut into blocks, pairs of blocks are compared by signature, each pair in the first tree that has it, and leave a
spanning forest of the likely pairs. Its components are verified exactly, again by pairs of blocks, every pair of texts
in a component; what leaves a block is each text's number of links and a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import by_rows, let_go, slices, written
from tabwright.llm.components import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH = 24, 7
#: wanted share of the links that share a prefix, and standard errors that an estimate may be below the threshold
RECALL, SLACK = 0.999, 4.0
#: texts of a block compared by signature, and of one verified exactly
BLOCK, EXACT_BLOCK = 1_024, 512
#: rows up to which the texts to verify are found by a broadcast; beyond, by a shuffle
SMALL = 100_000
#: row numbers (8 bytes each) up to which those that stay are broadcast; beyond, they are shuffled
KEPT = 1_000_000
#: n-grams (8 bytes each) that a block of texts to verify holds at most, if no single text has more
CELLS = 2_000_000
BINS = 50
SEED = 17

_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int = WORDS) -> tuple[bytes, np.ndarray]:
    """Digest of the lower-cased words, and the distinct hashes of their n-grams, sorted.

    Words are what white space separates. A text of fewer than ``n`` words has one n-gram, all of them; without words none.
    """
    words = (text or "").lower().split()
    digest = blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    if not words:
        return digest, np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    width = max(1, len(words) - n + 1)
    out = np.full(width, len(words) if len(words) < n else n, np.uint64)
    for k in range(min(n, len(words))):
        out = (out ^ h[k:k + width]) * _MUL
        out ^= out >> np.uint64(29)
    return digest, np.unique(out)


def signature(hashes: np.ndarray, factors: np.ndarray) -> bytes:
    """One byte of the smallest permuted hash per factor."""
    least = np.full(len(factors), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 2_048):
        np.minimum(least, (factors[:, None] * hashes[None, at:at + 2_048]).min(axis=1), out=least)
    return (least >> np.uint64(24)).astype(np.uint8).tobytes()


def permutations(count: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def keyed(df: DataFrame, doc_id: str, text: str, carry: bool = False) -> DataFrame:
    """A written table: row (unique), doc_id, text, and with ``carry`` the input row as ``record`` in place of the text."""
    more = F.struct("*").alias("record") if carry else F.col(text).cast("string").alias("text")
    return written(df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), more), "rows")


def signed(rows: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """A written table of (row, doc_id, text): row, doc_id, digest, number of n-grams, keys."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = permutations(trees * depth)
        for b in slices(batches):
            own = [shingles(t, n) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([d for d, _ in own], pa.binary()), pa.array([len(h) for _, h in own], pa.int64()),
                pa.array([signature(h, factors) if len(h) else b"" for _, h in own], pa.binary())], ["row", "doc_id", "digest", "grams", "keys"])
        let_go()

    return written(rows.select("row", "doc_id", "text").mapInArrow(work, "row long, doc_id long, digest binary, grams long, keys binary"), "signatures")


def runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, a group being a run of rows equal in the first ``keys`` columns; about ``rows`` rows each, or one group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < rows:
            continue
        t = pa.Table.from_batches(held)
        starts = _starts(t, keys)
        last = int(starts[-1])
        if last:
            yield t.slice(0, last)
        held = t.slice(last).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            yield t


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    """First row of each group."""
    columns = [t.column(i).to_numpy() for i in range(keys)]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    return np.flatnonzero(new)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n things the smallest one that pairs (i, j) connect it to."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def likely_pairs(reps: DataFrame, depth: int, before: int | None, threshold: float, trees: int, full: int, block: int, slack: float) -> DataFrame:
    """A spanning forest (a, b) of the pairs with a common prefix of ``depth`` but not ``before`` values, as estimated by signature.

    Rows without a hold how many of them (n) were met at an estimated similarity (bin / BINS).
    """
    cut = threshold - slack * float(np.sqrt(threshold * (1 - threshold) / (trees * full)))
    dealt = reps.select("rep", "keys", F.explode(F.expr(f"sequence(0, {trees - 1})")).alias("tree")).select(
        "rep", "tree", F.xxhash64("tree", F.expr(f"substring(keys, tree * {full} + 1, {depth})")).alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    members = (dealt.join(by_rows(shared), "bucket").withColumn("blocks", blocks)
               .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
               .select("rep", "tree", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
               .select("rep", "tree", "bucket", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))
    rows = (members.join(by_rows(reps.select("rep", "keys")), "rep").select("bucket", "low", "high", "tree", "own", "rep", "keys")
            .repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(BINS + 1, np.int64)
        for t in runs(batches, 3, 8_192):
            starts = _starts(t, 3)
            size = np.diff(np.append(starts, t.num_rows))
            left = np.repeat(starts + size, size) - np.arange(t.num_rows)  # rows from this one to its group's end
            tree, own, rep = (t.column(c).to_numpy() for c in ("tree", "own", "rep"))
            across = t.column("low").to_numpy() != t.column("high").to_numpy()
            keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint8).reshape(-1, trees, full)
            ii, jj = [], []
            at = np.flatnonzero(left > 1)
            step = 1
            while len(at):
                for part in np.array_split(at, -(-len(at) // 4_096)):
                    i, j = part, part + step
                    ok = ~across[i] | (own[i] != own[j])
                    i, j = i[ok], j[ok]
                    if not len(i):
                        continue
                    same = keys[i] == keys[j]
                    prefix = same[:, :, :depth].all(axis=2)
                    ok = prefix.argmax(axis=1) == tree[i]  # in the first tree only
                    if before:
                        ok &= ~same[:, :, :before].all(axis=2).any(axis=1)
                    # equal bytes by chance are taken off the estimate
                    estimate = (same.reshape(len(i), -1).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                    met += np.bincount((np.clip(estimate[ok], 0, 1) * BINS).astype(int), minlength=BINS + 1)
                    ok &= estimate >= cut
                    ii.append(i[ok]), jj.append(j[ok])
                step += 1
                at = at[left[at] > step]
            if ii:
                label = forest(t.num_rows, np.concatenate(ii), np.concatenate(jj))
                moved = np.flatnonzero(label != np.arange(t.num_rows))
                if len(moved):
                    yield out(rep[moved], rep[label[moved]], None, None)
        bins = np.flatnonzero(met)
        yield out(None, None, bins, met[bins])

    def out(a, b, bins, n):
        size = len(a) if a is not None else len(bins)
        columns = [pa.nulls(size, kind) if v is None else pa.array(v, kind) for v, kind in ((a, pa.int64()), (b, pa.int64()), (bins, pa.int32()), (n, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "bin", "n"])

    return written(rows.mapInArrow(work, "a long, b long, bin int, n long"), "likely")


def candidate_edges(reps: DataFrame, threshold: float, trees: int, depth: int, block: int, recall: float, slack: float) -> DataFrame:
    """Shorten the prefixes until the target recall; the spanning forests of all depths."""
    edges, before, met, k = None, None, np.zeros(BINS + 1), depth
    middle = (np.arange(BINS + 1) + 0.5) / BINS
    above = middle >= threshold
    while True:
        found = likely_pairs(reps, k, before, threshold, trees, depth, block, slack)
        for r in found.where("a is null").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS + 1 rows at most
            met[r.bin] += r.n
        new = found.where("a is not null").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        share = 1 - (1 - np.minimum(middle, 1) ** k) ** trees
        total = (met / share)[above].sum()
        if k == 1 or met[above].sum() >= recall * total:
            return edges
        before, k = k, k - 1


def verified(rows: DataFrame, clusters: DataFrame, n: int, threshold: float, block: int, cells: int = CELLS) -> DataFrame:
    """(rep, links, edge): per block pair, a text's number of documents linked to it and the smallest text of its part of the forest.

    ``rows`` has row and text, ``clusters`` has rep (a row), grams (how many), copies and label. A block holds at most
    ``block`` texts, and fewer where a component's texts are long: about ``cells`` n-grams.
    """
    size = clusters.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("grams") / cells)).cast("int").alias("blocks"))
    clusters = written(clusters.join(by_rows(size), "label").select("rep", "copies", "label", "blocks"), "clusters")
    side = F.broadcast(clusters) if clusters.count() <= SMALL else clusters.hint("shuffle_hash")
    found = rows.select("row", "text").join(side, F.col("row") == F.col("rep")).select("rep", "copies", "label", "blocks", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            grams = pa.array([shingles(t, n)[1].tobytes() for t in b.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], grams], ["rep", "copies", "label", "blocks", "grams"])
        let_go()

    made = found.mapInArrow(sets, "rep long, copies long, label long, blocks int, grams binary")
    rows = (made
            .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "copies", "grams")
            .repartition("label", "low", "high").sortWithinPartitions("label", "low", "high", "rep"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3, 1):
            starts = np.append(_starts(t, 3), t.num_rows)
            low, high, own, rep, copies = (t.column(c).to_numpy() for c in ("low", "high", "own", "rep", "copies"))
            grams = t.column("grams").to_pylist()
            reps, counts, edges = [], [], []
            for s, e in zip(starts[:-1], starts[1:]):
                keep = np.arange(s, e)
                first = keep[own[keep] == low[s]]
                second = first if low[s] == high[s] else keep[own[keep] == high[s]]
                if not len(first) or not len(second):
                    continue
                linked = similar([np.frombuffer(grams[i], np.uint64) for i in first], [np.frombuffer(grams[i], np.uint64) for i in second], threshold)
                same = low[s] == high[s]
                if same:
                    np.fill_diagonal(linked, False)
                i, j = np.nonzero(linked)
                both = first if same else np.concatenate([first, second])
                label = forest(len(both), i, j if same else j + len(first))
                n_links = linked @ copies[second] if same else np.concatenate([linked @ copies[second], copies[first] @ linked])
                some = n_links > 0
                reps.append(rep[both[some]]), counts.append(n_links[some]), edges.append(rep[both[label[some]]])
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (reps, counts, edges)], ["rep", "links", "edge"])

    return written(rows.mapInArrow(links, "rep long, links long, edge long"), "links")


def similar(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of ``a`` and ``b`` have a Jaccard similarity of at least ``threshold``, all pairs by products of 0/1 matrices."""
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # a gram of one set is in no intersection
    _, column = np.unique(column[shared], return_inverse=True)
    row = row[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4_096):
        s, e = np.searchsorted(column, [low, low + 4_096])
        part = np.zeros((len(a) + len(b), 4_096), np.float32)
        part[row[s:e], column[s:e] - low] = 1
        common += part[:len(a)] @ part[len(a):].T
    union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - common
    return common >= threshold * union - 1e-6


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                    block: int = BLOCK, exact_block: int = EXACT_BLOCK, recall: float = RECALL, slack: float = SLACK) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id, n_links, class_size, n_copies, kept.

    Two rows are linked if the Jaccard similarity of their sets of ``n``-grams of lower-cased words is ``threshold`` or
    more. A class is a connected component of links and its id the smallest doc_id in it; ``n_links`` counts the other
    rows linked to this one, ``n_copies`` the rows with the same words, this one too. One row of a class is ``kept``, one
    with its id. Texts of fewer than ``n`` words are linked to rows with the same words only, and so are null and empty
    texts, which are equal. A null doc_id comes after all others; a class with no other id has a null id. Other columns
    are not read; an empty table gives an empty result.
    """
    return classes(keyed(df, doc_id, text), n, threshold, trees, depth, block, exact_block, recall, slack).drop("row")


def classes(texts: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
            block: int = BLOCK, exact_block: int = EXACT_BLOCK, recall: float = RECALL, slack: float = SLACK) -> DataFrame:
    """`near_duplicates` of a written table (row, doc_id, text), with the row."""
    rows = signed(texts, n, trees, depth)
    reps = written(rows.groupBy("digest").agg(F.min("row").alias("rep"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"),
                                              F.first("keys").alias("keys"), F.max("grams").alias("grams")), "texts")
    edges = candidate_edges(reps.where("grams > 0"), threshold, trees, depth, block, recall, slack)
    clusters = components(edges).join(by_rows(reps), F.col("node") == F.col("rep")).select("rep", "grams", "copies", "label")
    found = verified(texts, clusters, n, threshold, exact_block)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("edge").alias("b")))
    texts = (reps.select("digest", "rep", "doc_id", "copies").join(by_rows(links), "rep", "left").join(by_rows(joined.withColumnRenamed("node", "rep")), "rep", "left")
             .select("digest", "rep", "doc_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "rep").alias("label")))
    texts = written(texts, "classes")
    whole = texts.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"),
                                       F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rep"))).alias("least"))
    info = texts.join(by_rows(whole), "label").select("digest", "copies", "links", "class_id", "class_size", (F.col("rep") == F.col("least.rep")).alias("stays"))
    own = rows.select("digest", "row", "doc_id").join(by_rows(info), "digest")
    first = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("f")).select("digest", F.col("f.row").alias("first_row"))
    return own.join(by_rows(first), "digest").select(
        "row", "doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "class_size", F.col("copies").alias("n_copies"),
        (F.col("stays") & (F.col("row") == F.col("first_row"))).alias("kept"))


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: exactly those that `near_duplicates` marks as kept, one of each class.

    Rows are told apart by a row number, whatever their ids. Texts are never sorted for it: the numbers that stay are
    broadcast up to `KEPT` of them, and beyond that hashed beside the shuffled rows.
    """
    rows = keyed(df, doc_id, text, carry=True)
    texts = rows.select("row", "doc_id", F.col("record").getField(text).cast("string").alias("text"))
    kept = written(classes(texts, **options).where("kept").select("row"), "kept")
    side = F.broadcast(kept) if kept.count() <= KEPT else kept.hint("shuffle_hash")
    return rows.join(side, "row", "left_semi").select("record.*")
