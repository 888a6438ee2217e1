"""The catalog as tables: tables, fields, views and indexes of one state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .types import Field, layout

#: Names and columns of the catalog's tables. Fixed values.
CATALOGS = {
    "table_catalog": "table_name string, slot_size int",
    "field_catalog": "table_name string, field_name string, type string, length int, offset int",
    "view_catalog": "view_name string, view_definition string",
    "index_catalog": "index_name string, table_name string, field_name string",
}


def fields_of_table(entry: dict) -> list[Field]:
    return [Field(**f) for f in entry["fields"]]


def catalog_rows(spark: SparkSession, name: str, manifest: dict, attached: dict[str, list[Field]]) -> DataFrame:
    """The rows of one of ``CATALOGS``; attached files count as tables."""
    tables = {t: fields_of_table(e) for t, e in manifest["tables"].items()} | attached
    if name == "table_catalog":
        rows = [(t, layout(fields)[1]) for t, fields in tables.items()]
    elif name == "field_catalog":
        rows = [(t, f.name, f.kind if f.kind != "other" else f.spark, f.length, layout(fields)[0][f.name]) for t, fields in tables.items() for f in fields]
    elif name == "view_catalog":
        rows = [(v, text) for v, text in manifest["views"].items()]
    else:
        rows = [(i, x["table"], x["field"]) for i, x in manifest["indexes"].items()]
    return spark.createDataFrame(rows, CATALOGS[name])
