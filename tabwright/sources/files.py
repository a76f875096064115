"""File scans and JSON navigation."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import col
from .records import read_records

FORMAT_BY_EXTENSION = {
    ".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".json": "json", ".jsonl": "jsonl",
    ".xml": "xml", ".xlsx": "excel", ".xls": "excel",
}


LATIN = "ISO-8859-1"
#: options that the reader of records takes; others leave a file to one task
CUT_OPTIONS = {"header", "sep", "quote", "nullValue", "emptyValue", "dateFormat", "timestampFormat"}


@dataclass(frozen=True)
class FileSpec:
    """A file, folder or glob. Give a schema to spare the inference pass over large text files.

    CSV follows the usual rules: a quote inside quotes is doubled, and quoted text may hold line breaks. A file is read by
    one task, unless a file of UTF-8 is larger than ``split_above`` bytes: then all are split and cut into records in parallel, with
    the same rows. The option ``multiLine=False`` says that no text has a line break, and splits files by lines. No row is
    dropped: what does not fit its column is missing, and with ``corrupt`` the whole record is kept in a column of that
    name. ``encoding`` is UTF-8 unless given; ``detect`` reads the files once more to find those that are not UTF-8,
    which are then taken for Latin-1, each file by itself.
    """

    path: str
    format: str | None = None
    schema: str | T.StructType | None = None
    options: dict = field(default_factory=dict)
    encoding: str = "UTF-8"
    corrupt: str | None = None
    split_above: int = 1 << 30

    def kind(self) -> str:
        if self.format:
            return self.format
        for extension, kind in FORMAT_BY_EXTENSION.items():
            if self.path.lower().rstrip("/").endswith(extension):
                return kind
        raise ValueError(f"cannot tell the format of {self.path!r}: name one")


def not_utf8(spark: SparkSession, path: str) -> list[str]:
    """The files of a path that hold bytes which are not UTF-8: a scan that returns one address for each such file."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return [r[0] for r in broken.select(F.input_file_name()).distinct().collect()]


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing value from here on."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(col(c), F.lit(None)) for c in floats}) if floats else df


def read_delimited(spark: SparkSession, spec: FileSpec, sep: str) -> DataFrame:
    """CSV or TSV rows, none dropped."""
    options = {"header": True, "sep": sep, "escape": '"', "multiLine": True, "mode": "PERMISSIVE", **spec.options}

    def large(paths) -> bool:
        sizes = spark.read.format("binaryFile").load(paths).agg(F.max("length")).first()  # lists the files, reads none
        return (sizes[0] or 0) > spec.split_above

    def read(paths, encoding: str, schema) -> DataFrame:
        found = {**options, "encoding": encoding}
        if encoding == "UTF-8" and set(spec.options) <= CUT_OPTIONS and large(paths):
            fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
            given = {k: v for k, v in options.items() if k != "multiLine"}
            if spec.corrupt and fields is not None:
                given["columnNameOfCorruptRecord"] = spec.corrupt
                fields = T.StructType([f for f in fields if f.name != spec.corrupt] + [T.StructField(spec.corrupt, T.StringType())])
            if fields is not None or not spec.corrupt:
                return read_records(spark, paths, given, fields)
        if schema is None:
            schema = spark.read.options(**found, inferSchema=True).csv(paths).schema
        if spec.corrupt:
            fields = schema.fields if isinstance(schema, T.StructType) else T._parse_datatype_string(schema).fields
            schema = T.StructType([f for f in fields if f.name != spec.corrupt] + [T.StructField(spec.corrupt, T.StringType())])
            found["columnNameOfCorruptRecord"] = spec.corrupt
        return spark.read.options(**found).schema(schema).csv(paths)

    if spec.encoding != "detect":
        return read(spec.path, spec.encoding, spec.schema)
    latin = set(not_utf8(spark, spec.path))
    if not latin:
        return read(spec.path, "UTF-8", spec.schema)
    others = [f for f in spark.read.text(spec.path).inputFiles() if f not in latin]
    if not others:
        return read(spec.path, LATIN, spec.schema)
    first = read(others, "UTF-8", spec.schema)
    return first.unionByName(read(sorted(latin), LATIN, spec.schema or first.schema), allowMissingColumns=True)


def bad_records(df: DataFrame, corrupt: str) -> DataFrame:
    """One row (rows, bad) of a table that was read with ``corrupt``."""
    # the reader refuses a scan of nothing but the corrupt-record column
    data = F.hash(*[col(c) for c in df.columns if c != corrupt][:1])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(col(corrupt).isNotNull(), data)).alias("bad"))


def read_file(spark: SparkSession, spec: FileSpec) -> DataFrame:
    kind = spec.kind()
    options = dict(spec.options)
    reader = spark.read
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    if kind in ("csv", "tsv"):
        return nan_to_null(read_delimited(spark, spec, "\t" if kind == "tsv" else ","))
    if kind == "parquet":
        return nan_to_null(reader.options(**options).parquet(spec.path))
    if kind in ("json", "jsonl"):
        # an array document is one task per file; one record per line splits
        return nan_to_null(reader.options(**{"multiLine": kind == "json", **options}).json(spec.path))
    if kind == "xml":
        return nan_to_null(reader.options(**{"rowTag": "row", **options}).xml(spec.path))
    if kind == "excel":
        from .workbook import read_excel
        if spec.schema is None:
            raise ValueError("a workbook scan needs a schema")
        return read_excel(spark, spec.path, spec.schema, **options)
    raise ValueError(f"unknown format {kind!r}")


def json_path_rows(df: DataFrame, column: str, path: str, schema: str | None = None) -> DataFrame:
    """Follow a dot path into a JSON column: a list gives a row per element, anything else one row.

    The result column ``record`` is JSON text, or a struct when a schema is given.
    """
    found = F.get_json_object(col(column), "$." + path if path else "$")
    # a text value comes back without its quotes, so the type is asked of the document itself
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(col(column)), "$." + path if path else "$", "variant"))
    records = F.when(kind.startswith("ARRAY"), F.from_json(found, "array<string>")).when(found.isNotNull(), F.array(found))
    rows = df.withColumn("record", F.explode(records))
    return rows.withColumn("record", F.from_json("record", schema)) if schema else rows
