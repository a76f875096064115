"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (what line feeds separate) hashes to a wide vector, and a text's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo a power of two. So the order of paragraphs does not matter, and a paragraph is put in or
taken out by adding or subtracting its vector, without the rest of the text.

The vector has two parts. `EXACT` lanes, modulo 2^32, are the words of the paragraph's SHA-256: texts with other
paragraphs have other sums. `LANES` lanes, modulo 2^16, tell how alike two texts are: each run of `RUN` words, counted
from the paragraph's start, adds +1 or -1 to one lane. The squared distance of two such sums estimates how many runs
only one of the texts has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import text_or_empty, written
from tabwright.operators.prefix import row_numbers

#: lanes that tell likeness, lanes that tell equality, words of a run
LANES, EXACT, RUN = 128, 8, 4
#: lanes that are summed side by side
GROUP = 8

_SPACE = r"\x09-\x0D\x20"
RUNS = rf"[^{_SPACE}]+(?:[{_SPACE}]+[^{_SPACE}]+){{0,{RUN - 1}}}"
#: hex digits of a lane of each part
_NARROW, _WIDE = 4, 8


def _number(hexed: Column) -> Column:
    return F.conv(hexed, 16, 10).cast("long")


def pair_sums(parts: DataFrame, by: list[str], text: str, own: str, other: str) -> DataFrame:
    """Two fingerprints per value of ``by``: by..., fingerprint, other_fingerprint, narrow (the first's lanes of likeness), near.

    Each row's paragraphs count in the first as often as its column ``own`` says and in the second as often as ``other``,
    which may be negative: the second can be the first, less some paragraphs, plus others. ``near`` is their `likeness`.
    Sums of eight lanes side by side come first, then a text's groups of lanes; both are combined before any shuffle.
    """
    paragraphs = parts.select(*by, F.col(own).cast("long").alias("_a"), F.col(other).cast("long").alias("_b"), F.explode(F.split(F.col(text), "\n", -1)).alias("_p"))
    hashed = paragraphs.select(*by, "_a", "_b", "_p", F.sha2("_p", 256).alias("_s"))
    runs = hashed.select(*by, "_a", "_b", "_s", F.posexplode_outer(F.regexp_extract_all("_p", F.lit(RUNS), 0)).alias("_at", "_run"))
    code = _number(F.substring(F.md5("_run"), 1, 4)).cast("int")
    runs = runs.select(*by, "_a", "_b", "_s", F.col("_at").isNull() | (F.col("_at") == 0), code.alias("_code")).toDF(*by, "_a", "_b", "_s", "_first", "_code")
    lane = F.col("_code") % LANES
    rows = runs.select(
        *by, "_a", "_b", F.coalesce(F.floor(lane / GROUP).cast("int"), F.lit(0)).alias("_slot"), (lane % GROUP).alias("_lane"),
        # both sums travel in one long: a text has fewer than 2^31 runs
        (F.when(F.floor(F.col("_code") / LANES) % 2 == 0, 1).otherwise(-1) * (F.col("_a") + F.shiftleft("_b", 32))).alias("_v"),
        *[F.when(F.col("_first"), _number(F.substring("_s", _WIDE * j + 1, _WIDE))).alias(f"_e{j}") for j in range(EXACT)])
    slots = rows.groupBy(*by, "_slot").agg(
        *[F.coalesce(F.sum(F.when(F.col("_lane") == j, F.col("_v"))), F.lit(0)).alias(f"_l{j}") for j in range(GROUP)],
        *[F.coalesce(F.sum(F.col(f"_e{j}") * F.col(w)), F.lit(0)).alias(f"{w}{j}") for w in ("_a", "_b") for j in range(EXACT)])
    low = [F.pmod(F.col(f"_l{j}") + 2**31, F.lit(2**32)) - 2**31 for j in range(GROUP)]
    first, second = [_centred(x) for x in low], [_centred(F.shiftright(F.col(f"_l{j}") - x, 32)) for j, x in enumerate(low)]
    add = lambda terms: reduce(lambda x, y: x + y, terms)
    slots = slots.select(
        *by, F.struct(F.col("_slot").alias("slot"), _hexed(first).alias("own"), _hexed(second).alias("other"), F.array(*[x.cast("short") for x in first]).alias("narrow")).alias("_g"),
        add([_centred(x - y) * _centred(x - y) for x, y in zip(first, second)]).alias("_gap"), add([x * x for x in [*first, *second]]).alias("_size"),
        *[f"{w}{j}" for w in ("_a", "_b") for j in range(EXACT)])
    whole = slots.groupBy(*by).agg(F.collect_list("_g").alias("_g"), F.sum("_gap").alias("_gap"), F.sum("_size").alias("_size"),
                                   *[F.sum(f"{w}{j}").alias(f"{w}{j}") for w in ("_a", "_b") for j in range(EXACT)])

    def each(name, missing):  # in order of the groups, those without a run too
        found = F.map_from_entries(F.transform("_g", lambda g: F.struct(g["slot"], g[name])))
        return F.transform(F.sequence(F.lit(0), F.lit(LANES // GROUP - 1)), lambda j: F.coalesce(F.try_element_at(found, j), missing))

    zero, nothing = F.lit("0" * _NARROW * GROUP), F.array_repeat(F.lit(0).cast("short"), GROUP)
    exact = {w: F.concat(*[F.lpad(F.lower(F.hex(F.pmod(F.col(f"{w}{j}"), F.lit(2**32)))), _WIDE, "0") for j in range(EXACT)]) for w in ("_a", "_b")}
    made = whole.select(*by, F.concat(F.array_join(each("own", zero), ""), exact["_a"]).alias("fingerprint"), F.concat(F.array_join(each("other", zero), ""), exact["_b"]).alias("other_fingerprint"),
                        F.flatten(each("narrow", nothing)).alias("narrow"), "_gap", "_size")
    return made.select(*by, "fingerprint", "other_fingerprint", "narrow", _share(F.col("_gap"), F.col("_size"), F.col("fingerprint") == F.col("other_fingerprint")).alias("near"))


def _hexed(lanes: list[Column]) -> Column:
    """Lanes modulo 2^16 in hex, four to a long."""
    parts = [F.pmod(x, F.lit(2**16)) for x in lanes]
    longs = [F.shiftleft(a, 48).bitwiseOR(F.shiftleft(b, 32)).bitwiseOR(F.shiftleft(c, 16)).bitwiseOR(d) for a, b, c, d in zip(*[iter(parts)] * 4)]
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in longs]))


def _share(gap: Column, size: Column, equal: Column) -> Column:
    return F.when(equal, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - gap / size))


def written_out(lanes: Column) -> Column:
    """The fingerprint of an array of sums: each lane modulo its power of two, in hex."""
    return F.concat(
        F.array_join(F.transform(F.slice(lanes, 1, LANES), lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(2**16)))), _NARROW, "0")), ""),
        F.array_join(F.transform(F.slice(lanes, LANES + 1, EXACT), lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(2**32)))), _WIDE, "0")), ""))


def lanes_of(fingerprint: Column) -> Column:
    """The array of sums that a fingerprint stands for; those of likeness between -2^15 and 2^15."""
    narrow = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda j: _centred(_number(F.substr(fingerprint, j * _NARROW + 1, F.lit(_NARROW)))))
    wide = F.transform(F.sequence(F.lit(0), F.lit(EXACT - 1)), lambda j: _number(F.substr(fingerprint, j * _WIDE + LANES * _NARROW + 1, F.lit(_WIDE))))
    return F.concat(narrow, wide)


def _centred(x: Column) -> Column:
    return F.pmod(x + 2**15, F.lit(2**16)) - 2**15


def inserted(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint with the paragraphs of another fingerprint put in."""
    return written_out(F.zip_with(lanes_of(fingerprint), lanes_of(paragraphs), lambda a, b: a + b))


def deleted(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint with the paragraphs of another fingerprint taken out."""
    return written_out(F.zip_with(lanes_of(fingerprint), lanes_of(paragraphs), lambda a, b: a - b))


def likeness(a: Column, b: Column) -> Column:
    """Share of runs that the texts of two fingerprints have in common, between 0 and 1; 1 if they are equal."""
    return _likeness(*[F.slice(lanes_of(x), 1, LANES).cast("array<short>") for x in (a, b)], a == b)


def _likeness(a: Column, b: Column, equal: Column) -> Column:
    """The same for arrays of the lanes that tell likeness.

    With squared lengths |a|^2 and |b|^2 it is 1 - |a - b|^2 / (|a|^2 + |b|^2), not below 0; its standard error is about
    1 / sqrt(`LANES`). Where neither text has a word it is 0 unless they are equal.
    """
    square = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x * x)
    a, b = a.cast("array<long>"), b.cast("array<long>")
    return _share(square(F.zip_with(a, b, lambda x, y: _centred(x - y))), square(a) + square(b), equal)


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct (doc_id, text) of ``df``: doc_id, text_sha256, fingerprint. A null text counts as empty."""
    rows = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), F.lit(1).alias("_one"))
    sums = pair_sums(rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text", "_one").dropDuplicates(["doc_id", "text_sha256"]),
                     ["doc_id", "text_sha256"], "text", "_one", "_one")
    return sums.select("doc_id", "text_sha256", "fingerprint")


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document's, or
    all it has. Its fingerprint is the text's, minus the paragraphs from the cut on, plus those put in there.
    ``near_edited`` and ``near_next`` are the `likeness` of the text to its edited form and to the next document.

    Documents follow each other by ascending doc_id, a null one first, and the first follows the last. Texts that share a
    doc_id follow by a hash of the text; rows that repeat both are one document, and each gets its result. A null text
    counts as empty, which is one empty paragraph. Other columns are not read; an empty table gives an empty result.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("a"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("t"))
    # a and t name a document; no key is null, and copies are one before anything is shuffled
    keys = rows.groupBy("doc_id", "a", "t", F.length("text").alias("n_chars")).agg(F.count("*").alias("copies"))
    ranked = written(row_numbers(keys, [F.col("doc_id").asc_nulls_first(), F.col("t").asc()], "rank"), "ranked")
    last = ranked.count()
    before = ranked.select(F.when(F.col("rank") == last, 1).otherwise(F.col("rank") + 1).alias("rank"), F.col("a").alias("pa"), F.col("t").alias("pt"),
                           F.floor(F.col("n_chars") / 2).cast("int").alias("taken"))
    links = ranked.join(before, "rank").select("a", "t", "doc_id", "copies", "n_chars", "pa", "pt", "taken")
    # both uses of the texts ask for the same columns, so they are shuffled once
    texts = rows.groupBy("a", "t").agg(F.first("text").alias("text")).join(links, ["a", "t"])
    heads = texts.select(F.col("pa").alias("a"), F.col("pt").alias("t"), F.expr("substring(text, 1, taken)").alias("head"))
    both = texts.join(heads, ["a", "t"])
    kept = F.expr("substring(text, 1, n_chars - cast(floor(n_chars / 2) as int))")
    both = both.withColumn("edited", F.concat(kept, "head")).withColumn("kept", kept)
    # paragraphs before the last line feed of what is kept are the same in both texts
    both = both.withColumn("same", F.length("kept") - F.coalesce(F.length(F.substring_index("kept", "\n", -1)), F.lit(0)))
    about = ["a", "t", "doc_id", "copies", "n_chars", "pa", "pt"]
    both = both.select(*about, F.sha2("edited", 256).alias("edited_sha256"), F.array(
        F.struct(F.expr("substring(text, 1, same - 1)").alias("part"), F.lit(1).alias("own"), F.lit(1).alias("other")),
        F.struct(F.expr("substring(text, same + 1, n_chars)").alias("part"), F.lit(1).alias("own"), F.lit(0).alias("other")),
        F.struct(F.expr("substring(edited, same + 1, length(edited))").alias("part"), F.lit(0).alias("own"), F.lit(1).alias("other"))).alias("parts"), "same")
    parts = both.select(*about, "edited_sha256", F.explode(F.when(F.col("same") > 0, F.col("parts")).otherwise(F.slice("parts", 2, 2))).alias("p"))
    parts = parts.select(*about, "edited_sha256", "p.part", "p.own", "p.other")
    sums = pair_sums(parts, [*about, "edited_sha256"], "part", "own", "other")
    done = written(sums.withColumnsRenamed({"other_fingerprint": "edited_fingerprint", "near": "near_edited"}), "fingerprints")
    exact = F.substring("fingerprint", LANES * _NARROW + 1, EXACT * _WIDE)
    after = done.select(F.col("pa").alias("a"), F.col("pt").alias("t"), F.col("narrow").alias("next_narrow"), exact.alias("next_exact"))
    equal = (F.col("narrow") == F.col("next_narrow")) & (exact == F.col("next_exact"))
    near = done.join(after, ["a", "t"]).withColumn("near_next", _likeness(F.col("narrow"), F.col("next_narrow"), equal))
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return near.select(*out, F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select(*out)


def edited_sql(table: str = "documents") -> str:
    """The same in SQL, for distinct doc_ids."""
    wide = ", ".join(f"sum(('0x' || substr(sha256(p), {_WIDE * j + 1}, {_WIDE}))::bigint * w) % 4294967296 as e{j}" for j in range(EXACT))
    hexed = " || ".join(f"printf('%08x', e{j}::bigint)" for j in range(EXACT))
    centred = "(((({0}) + 32768) % 65536 + 65536) % 65536 - 32768)"
    near = "case when {0} = {1} then 1.0e0 when {3} = 0 then 0.0e0 else greatest(0.0e0, 1 - cast({2} as double) / {3}) end"
    return rf"""
    with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, ''))::int as n_chars from {table}),
    o as (select *, coalesce(lead(doc_id) over (order by doc_id nulls first), first_value(doc_id) over (order by doc_id nulls first)) as next_id,
                 coalesce(lead(text) over (order by doc_id nulls first), first_value(text) over (order by doc_id nulls first)) as next_text from d),
    e as (select doc_id, n_chars, next_id, text, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) as edited from o),
    parts as (select doc_id, 0 as kind, unnest(string_split(text, chr(10))) as p from e union all select doc_id, 1, unnest(string_split(edited, chr(10))) from e),
    exact as (select doc_id, kind, {hexed} as hexed from (select doc_id, kind, {wide} from (select *, 1 as w from parts) group by doc_id, kind)),
    runs as (select doc_id, kind, unnest(regexp_extract_all(p, '{RUNS}')) as run from parts),
    codes as (select doc_id, kind, ('0x' || substr(md5(run), 1, 4))::bigint as code from runs),
    lanes as (select doc_id, kind, code % {LANES} as lane, {centred.format(f"sum(case when code // {LANES} % 2 = 0 then 1 else -1 end)")}::bigint as v from codes group by doc_id, kind, code % {LANES}),
    filled as (select x.doc_id, x.kind, x.hexed, j.lane, coalesce(l.v, 0) as v
               from exact x cross join (select unnest(range({LANES})) as lane) j left join lanes l on l.doc_id = x.doc_id and l.kind = x.kind and l.lane = j.lane),
    prints as (select doc_id, kind, string_agg(printf('%04x', (v + 65536) % 65536), '' order by lane) || any_value(hexed) as fingerprint, list(v order by lane) as vs,
                      sum(v * v)::bigint as size from filled group by doc_id, kind),
    pairs as (select e.doc_id, e.n_chars, sha256(e.edited) as edited_sha256, a.fingerprint, b.fingerprint as edited_fingerprint, c.fingerprint as next_fingerprint,
                     list_sum(list_transform(list_zip(a.vs, b.vs), lambda z: {centred.format("z[1] - z[2]")} ** 2)) as gap_edited, a.size + b.size as size_edited,
                     list_sum(list_transform(list_zip(a.vs, c.vs), lambda z: {centred.format("z[1] - z[2]")} ** 2)) as gap_next, a.size + c.size as size_next
              from e join prints a on a.doc_id = e.doc_id and a.kind = 0 join prints b on b.doc_id = e.doc_id and b.kind = 1 join prints c on c.doc_id = e.next_id and c.kind = 0)
    select doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {near.format("fingerprint", "edited_fingerprint", "gap_edited", "size_edited")} as near_edited,
           {near.format("fingerprint", "next_fingerprint", "gap_next", "size_next")} as near_next from pairs"""
