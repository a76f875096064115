"""License passages by diagonal voting, in DataFrame functions only.

Every rolling pair of words is hashed and joined to the places of that pair in the templates. A place in the document
minus the place in the template is a diagonal; a copy of the template puts all its pairs on one. Votes are counted per
document, template and diagonal; neighbouring diagonals are merged, so an inserted or missing word does not split a
passage; a merged span is verified by its share of the template and its length, and one that is too long, as where
notices follow each other, window by window of the length allowed. The base phrases are templates too, and
count where a single diagonal has all their pairs. Pairs are compared as words after the hash, so hashes never decide.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm.common import text_or_empty
from tabwright.llm.url_reputation import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: fixed values: phrase and label
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: notices that the voting adds
NOTICES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-notice"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("all rights reserved", "all-rights-reserved"),
]
#: diagonals this far apart are one passage; share of a notice's pairs it must have; longest span as a multiple of the notice
GAP, COVER, STRETCH = 3, 0.75, 1.5


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool


def templates(base=BASE, notices=NOTICES) -> list[Template]:
    return [Template(tuple(t.split()), label, is_base) for rows, is_base in ((base, True), (notices, False)) for t, label in rows]


def gram_table(spark: SparkSession, known: list[Template]) -> DataFrame:
    """(gram, w1, w2, template, place): a row for each pair of neighbouring words of each template, so bounded by the templates."""
    rows = [(w1, w2, i, place) for i, t in enumerate(known) for place, (w1, w2) in enumerate(zip(t.words, t.words[1:]))]
    return spark.createDataFrame(rows, "w1 string, w2 string, template int, place int").withColumn("gram", F.xxhash64("w1", "w2"))


def scan(df: DataFrame, base=BASE, notices=NOTICES, doc_id: str = "doc_id", text: str = "text", gap: int = GAP, cover: float = COVER, stretch: float = STRETCH) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words, no labels and score 0. The score is the largest share of a template found, 1 where
    a base phrase stands. Repeated rows are scanned each for itself; a null doc_id stays null. Other columns are not
    read; an empty table gives an empty result. Templates have two words at least. A notice is found where a window of
    at most ``stretch`` times its words within a passage has ``cover`` of its pairs.
    """
    known = templates(base, notices)
    grams = gram_table(df.sparkSession, known)
    wanted = [r.gram for r in grams.select("gram").distinct().collect()]
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
                     F.regexp_extract_all(F.translate(text_or_empty(text), UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("words"))
    n = F.size("words")
    pair = lambda i: (F.get("words", i), F.get("words", i + 1))
    places = F.when(n >= 2, F.filter(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(*pair(i)).isin(wanted)))
    hits = docs.select("row", "doc_id", n.cast("long").alias("n_words"),
                       F.transform(places, lambda i: F.struct(i.alias("at"), pair(i)[0].alias("w1"), pair(i)[1].alias("w2"))).alias("hits"))
    # a document without hits keeps one row, with nulls
    votes = (hits.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit"))
             .select("row", "doc_id", "n_words", "hit.*").withColumn("gram", F.xxhash64("w1", "w2"))
             .join(F.broadcast(grams), ["gram", "w1", "w2"], "left")
             .withColumn("diagonal", F.col("at") - F.col("place")))
    whose = [F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words")]
    diagonals = votes.groupBy("row", "template", "diagonal").agg(
        *whose, F.count("place").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"), F.collect_set("place").alias("places"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    merged = diagonals.withColumn("opens", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(0)))
    merged = merged.withColumn("passage", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per_template = lambda f: F.create_map(*[x for i, t in enumerate(known) for x in (F.lit(i), F.lit(f(t)))])[F.col("template")]
    size = per_template(lambda t: len(t.words))
    is_base = F.col("template") < len(base)
    exact = is_base & (F.col("votes") == size - 1)
    spans = merged.groupBy("row", "template", "passage").agg(
        F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"), F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(exact, F.col("diagonal"))).alias("last_word"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"), (F.max("high") - F.min("low") + 2).alias("length"),
        F.sort_array(F.flatten(F.collect_list(F.when(~is_base, F.transform("places", lambda p: F.struct((F.col("diagonal") + p).alias("at"), p.alias("place"))))))).alias("votes"))
    # a window of the longest span allowed begins at each vote; it has a few votes for each of its pairs of words at most
    reach = per_template(lambda t: int(len(t.words) * stretch) - 2)
    most = per_template(lambda t: (int(len(t.words) * stretch) - 1) * max(Counter(zip(t.words, t.words[1:])).values()))
    window = lambda vote, i: F.filter(F.slice("votes", i + 1, most), lambda v: v["at"] - vote["at"] <= reach)
    in_windows = F.array_max(F.transform("votes", lambda vote, i: F.size(F.array_distinct(F.transform(window(vote, i), lambda v: v["place"])))))
    long = ~is_base & (F.col("covered") / (size - 1) >= cover) & (F.col("length") > size * stretch)
    spans = spans.withColumn("covered", F.when(long, in_windows).otherwise(F.col("covered")))
    share = F.col("covered") / (size - 1)
    found = F.when(is_base, F.col("n_base") > 0).otherwise(share >= cover)
    label = per_template(lambda t: t.label)
    spans = spans.withColumn("label", F.when(found, label)).withColumn("share", F.when(found, F.when(is_base, F.lit(1.0)).otherwise(share)))
    out = spans.groupBy("row").agg(
        F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"), F.sum("n_base").cast("long").alias("n_base"),
        F.min("first_word").cast("long").alias("first_word"), F.max("last_word").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    return out.drop("row")


def scan_sql(base=BASE, notices=NOTICES, gap: int = GAP, cover: float = COVER, stretch: float = STRETCH) -> str:
    """The same rows in SQL."""
    known = templates(base, notices)
    grams = ", ".join(f"('{a}', '{b}', {i}, {p})" for i, t in enumerate(known) for p, (a, b) in enumerate(zip(t.words, t.words[1:])))
    names = ", ".join(f"({i}, '{t.label}', {len(t.words)}, {str(t.base).lower()})" for i, t in enumerate(known))
    return rf"""
    with g(w1, w2, template, place) as (values {grams}), t(template, label, size, is_base) as (values {names}),
    d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as words from documents),
    p as (select doc_id, words, unnest(range(len(words) - 1)) as pos from d),
    v as (select doc_id, template, place, pos, pos - place as diagonal from p join g on words[pos + 1] = w1 and words[pos + 2] = w2),
    x as (select *, sum(opens) over (partition by doc_id, template order by diagonal, pos) as passage from (
        select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal, pos) > {gap} then 1 else 0 end as opens from v)),
    e as (select doc_id, template, diagonal, count(*) as votes from v group by doc_id, template, diagonal),
    b as (select doc_id, count(*) as n_base, min(diagonal) as first_word, max(diagonal) as last_word,
                 string_agg(distinct label, ',' order by label) as base_labels
          from e join t using (template) where is_base and votes = size - 1 group by doc_id),
    s as (select doc_id, template, passage, count(distinct place) as covered, max(pos) - min(pos) + 2 > any_value(size) * {stretch} as long
          from x join t using (template) where not is_base group by doc_id, template, passage),
    w as (select doc_id, template, passage, max(c) as covered from (
        select a.doc_id, a.template, a.passage, a.pos, count(distinct b.place) as c
        from (select x.*, floor(size * {stretch})::int - 2 as reach from x join s using (doc_id, template, passage) join t using (template) where long) a
        join x b on b.doc_id = a.doc_id and b.template = a.template and b.passage = a.passage and b.pos between a.pos and a.pos + a.reach
        group by a.doc_id, a.template, a.passage, a.pos) group by doc_id, template, passage),
    m as (select doc_id, label, cast(coalesce(w.covered, s.covered) as double) / (size - 1) as share
          from s left join w using (doc_id, template, passage) join t using (template)
          where cast(coalesce(w.covered, s.covered) as double) / (size - 1) >= {cover}
          union all select doc_id, label, 1.0e0 from e join t using (template) where is_base and votes = size - 1),
    l as (select doc_id, string_agg(distinct label, ',' order by label) as labels, max(share) as score from m group by doc_id)
    select d.doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
           coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0e0) as score
    from d left join b using (doc_id) left join l using (doc_id)"""
