"""Files of other formats as read-only tables, and results written to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AnalysisError

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """The rows of a file or folder, column names in lower case. CSV has a header unless told otherwise."""
    if kind not in FORMATS:
        raise AnalysisError(f"unknown format {kind}")
    reader = spark.read.format(kind).options(**({"header": True} if kind == "csv" else {}) | options)
    rows = (reader.schema(schema) if schema else reader).load(path)
    return rows.select(*(F.col(f"`{c}`").alias(c.lower()) for c in rows.columns))


def write(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options) -> None:
    """Writes rows; one file a partition."""
    if kind not in FORMATS:
        raise AnalysisError(f"unknown format {kind}")
    rows.write.format(kind).mode(mode).options(**({"header": True} if kind == "csv" else {}) | options).save(path)
