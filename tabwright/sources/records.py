"""Delimited text whose quoted fields hold line breaks, cut into records in parallel.

A split of a file may begin inside a quoted field. Every split is therefore first read as a function of how it begins, outside
or inside quotes; running these functions along the splits of a file tells how each begins. Then every split is cut into
records on its own, and only what crosses a border is put together from its pieces.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import col
from ..session import cut_lineage

WHOLE, OPEN, PIECE = 0, 1, 2


@lru_cache(maxsize=16)
def closed(sep: str, quote: str) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of lines that end outside quotes, for lines that begin outside and inside; no pattern steps back."""
    s, q = re.escape(sep), re.escape(quote)
    rest = f"[^{s}]*+" if len(sep) == 1 else f"(?:(?!{s}).)*+"
    closing = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}{rest}"
    more = f"(?:{s}(?:{q}{closing}|(?!{q}){rest}))*+"
    return re.compile(f"(?:{q}{closing}|(?!{q}){rest}){more}", re.DOTALL), re.compile(closing + more, re.DOTALL)


def ends_inside(line: str, inside: bool, sep: str = ",", quote: str = '"') -> bool:
    """Whether a line that begins inside or outside a quoted field ends inside one.

    A quote opens a field only at its beginning, and a doubled one does not close it. What follows the closing quote up to
    the separator is plain text.
    """
    return closed(sep, quote)[inside].fullmatch(line) is None if quote in line else inside


def lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows (file, block, line, value), a task's lines in the order of the file; ``block`` is where the split begins."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("line"), "value")


def _ends(sep: str, quote: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, (False, True)
        for batch in batches:
            done = []
            for file, block, value in zip(batch["file"], batch["block"], batch["value"]):
                if (file, block) != key:
                    if key is not None:
                        done.append((*key, *state))
                    key, state = (file, block), (False, True)
                if quote in value:
                    outside = ends_inside(value, state[0], sep, quote)
                    state = (outside, outside if state[0] == state[1] else ends_inside(value, state[1], sep, quote))
            if done:
                yield pd.DataFrame(done, columns=["file", "block", "outside", "inside"])
        if key is not None:
            yield pd.DataFrame([(*key, *state)], columns=["file", "block", "outside", "inside"])
    return run


def begins(found: DataFrame, sep: str = ",", quote: str = '"') -> DataFrame:
    """Rows (file, block, begins_inside), one per split."""
    ends = found.select("file", "block", "value").mapInPandas(_ends(sep, quote), "file string, block long, outside boolean, inside boolean")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("outside") == F.col("inside")  # ends the same however it begins
    swaps = F.sum((F.col("outside") & ~F.col("inside")).cast("int"))
    ends = ends.withColumn("_n", swaps.over(order)).withColumns({"_to": F.when(fixed, F.col("outside").cast("int")), "_at": F.when(fixed, F.col("_n"))})
    last = [F.coalesce(F.last(c, True).over(before), F.lit(0)) for c in ("_to", "_at")]
    now = F.coalesce(F.lag("_n").over(order), F.lit(0))
    return ends.select("file", "block", ((last[0] + now - last[1]) % 2 == 1).alias("begins_inside"))


def _cut(sep: str, quote: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, inside, held, first, kind = None, False, [], 0, WHOLE
        names = ["file", "block", "line", "kind", "value"]

        def flush(done):
            # what is still open when its split ends
            if held:
                done.append((*key, first, kind if kind == PIECE else OPEN, "\n".join(held)))

        for batch in batches:
            done = []
            for file, block, line, value, begun in zip(batch["file"], batch["block"], batch["line"], batch["value"], batch["begins_inside"]):
                if (file, block) != key:
                    flush(done)
                    key, inside, held, kind = (file, block), bool(begun), [], PIECE if begun else WHOLE
                    if block == 0:
                        value = value.removeprefix("\ufeff")
                if not held:
                    first = line
                inside = ends_inside(value, inside, sep, quote)
                held.append(value)
                if not inside:
                    record = "\n".join(held).removesuffix("\r")
                    if record.strip() or kind == PIECE:
                        done.append((file, block, first, kind, record))
                    held, kind = [], WHOLE
            if done:
                yield pd.DataFrame(done, columns=names)
        done = []
        flush(done)
        if done:
            yield pd.DataFrame(done, columns=names)
    return run


def records(spark: SparkSession, path: str | Sequence[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """Rows (file, block, line, value): every record of UTF-8 files, blank ones left out; the last two give its place.

    Lines end in LF or CRLF; inside quotes both stay as they are. A file that ends inside quotes gives what is there as its
    last record. The text is read twice, once for the quotes and once to be cut; the cut records are written and read again.
    A record is held whole by one task.
    """
    found = lines(spark, path)
    start = begins(found, sep, quote)
    # a join by shuffle would mix the lines, so they are put in order again; beside a broadcast the sort finds them ordered
    told = found.join(start, ["file", "block"]).sortWithinPartitions("file", "block", "line")
    cut = told.select("file", "block", "line", "value", "begins_inside").mapInPandas(_cut(sep, quote), "file string, block long, line long, kind int, value string")
    pieces = cut_lineage(cut, "records")
    names = ["file", "block", "line", "value"]
    whole = pieces.filter(F.col("kind") == WHOLE).select(*names)
    # a record that crosses a border opens at the end of a split and goes on with the pieces that follow
    of = F.sum((F.col("kind") == OPEN).cast("int")).over(Window.partitionBy("file").orderBy("block", "line"))
    crossing = pieces.filter(F.col("kind") != WHOLE).withColumn("_of", of)
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    joined = crossing.groupBy("file", "_of").agg(parts.alias("p")).select(
        "file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["line"].alias("line"), F.array_join(F.col("p.value"), "\n").alias("value"))
    return whole.unionByName(joined)


def infer(texts: DataFrame, names: Sequence[str]) -> T.StructType:
    """The narrowest of int, bigint, double, date, timestamp, boolean and string that holds every text of a column; one aggregate.

    A column without any text is a string.
    """
    def fits(c):
        date = r"^\d{4}-\d{2}-\d{2}"
        return [
            ("int", c.rlike(r"^[+-]?\d+$") & c.try_cast("int").isNotNull()), ("bigint", c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull()),
            ("double", c.rlike(r"^\S+$") & c.try_cast("double").isNotNull()), ("date", c.rlike(date + "$") & c.try_cast("date").isNotNull()),
            ("timestamp", c.rlike(date + r"([T ]\d{2}:\d{2}.*)?$") & c.try_cast("timestamp").isNotNull()), ("boolean", F.lower(c).isin("true", "false"))]

    asked = [(i, kind, F.count(col(n)).alias(f"n{i}") if kind is None else F.count(F.when(test, 1)).alias(f"{kind}{i}"))
             for i, n in enumerate(names) for kind, test in [(None, None), *fits(col(n))]]
    one = texts.agg(*[a for *_, a in asked]).first()
    kinds = ["int", "bigint", "double", "date", "timestamp", "boolean"]
    types = [next((k for k in kinds if one[f"n{i}"] and one[f"{k}{i}"] == one[f"n{i}"]), "string") for i in range(len(names))]
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(names, types)])


def read_records(spark: SparkSession, path: str | Sequence[str], options: dict, schema: T.StructType | None = None) -> DataFrame:
    """Rows of delimited files by ``schema``, or by the names of the first file's header and inferred types.

    With the option ``header`` the first record of every file is left out. The other options are those of ``from_csv``.
    """
    sep, quote = options.get("sep", ","), options.get("quote", '"')
    header = str(options.get("header", True)).lower() == "true"
    parsing = {k: str(v) for k, v in options.items() if k != "header"} | {"multiLine": "true"}
    rows = records(spark, path, sep, quote)
    place = F.struct("block", "line")
    if header:
        heads = rows.groupBy(F.col("file").alias("_f")).agg(F.min(place).alias("_p"), F.min_by("value", place).alias("_v"))
        rows = rows.join(heads, (F.col("file") == F.col("_f")) & (place == F.col("_p")), "left_anti")
    if schema is None:
        top = (heads.orderBy("_f").select("_v") if header else rows.orderBy("file", "block", "line").select("value")).first()
        if top is None:
            return spark.createDataFrame([], T.StructType())
        fields = next(csv.reader([top[0]], delimiter=sep, quotechar=quote))
        names = [f or f"_c{i}" for i, f in enumerate(fields)] if header else [f"_c{i}" for i in range(len(fields))]
        plain = T.StructType([T.StructField(n, T.StringType()) for n in names])
        schema = infer(rows.select(F.from_csv("value", F.lit(plain.toDDL()), parsing).alias("r")).select("r.*"), names)
    return rows.select(F.from_csv("value", F.lit(schema.toDDL()), parsing).alias("r")).select("r.*")
