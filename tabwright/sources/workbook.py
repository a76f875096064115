"""Workbook scan: many files in parallel, one workbook per row of a binary-file scan."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_excel(spark: SparkSession, path: str, schema: str | T.StructType, sheet: int | str = 0) -> DataFrame:
    """Rows of all workbooks matching the path. Needs openpyxl (or xlrd) on the executors."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = fields.fieldNames()

    def load(batches):
        import pandas as pd
        for batch in batches:
            for content in batch["content"]:
                table = pd.read_excel(io.BytesIO(content), sheet_name=sheet)
                yield table.reindex(columns=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(load, fields)
