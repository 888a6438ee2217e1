"""SELECTs of the dialect over a folder that files are added to, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..errors import AnalysisError
from ..plans.binder import bind
from ..plans.parser import parse
from ..plans.syntax import Select


def stream(engine: Engine, sql: str, table: str, path: str, schema: str, checkpoint: str, into: str, watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Runs a SELECT whose ``table`` is the Parquet files of ``path`` as they arrive, until it has read all there are; the results go
    to the memory table ``into``.

    Other tables are read as they are. Queries with groups give their whole state each time, others the new rows; ORDER BY needs
    groups. ``watermark``: (column, delay), beyond which late rows of windows may be dropped.
    """
    statement = parse(sql)
    if not isinstance(statement, Select):
        raise AnalysisError("not a SELECT")
    rows: DataFrame = engine.spark.readStream.schema(schema).parquet(path)
    if watermark:
        rows = rows.withWatermark(*watermark)
    out = bind(statement, lambda n: rows if n == table else engine.table(n))
    grouped = bool(statement.group_by or statement.aggregates)
    writer = out.writeStream.outputMode("complete" if grouped else "append").format("memory").queryName(into)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
