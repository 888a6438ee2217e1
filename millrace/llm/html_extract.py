"""Main text of web pages, by a recurrent block labeller."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import blocks
from .html_labeller import label


def main_texts(pages: list[str | None]) -> list[str]:
    """The main text of each page: its blocks so labelled, whole, in page order, joined by one space."""
    found = [blocks(p) for p in pages]
    return [" ".join(b.text for b, k in zip(x, kept, strict=True) if k) for x, kept in zip(found, label(found), strict=True)]


def extract(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``columns`` of every row of ``pages`` (html) with ``text``, its main text.

    Every block of the whole page is labelled, nothing is cut. Pages are read in batches as they come; there is no shuffle,
    and a worker holds the blocks of a few hundred pages. Null and empty pages, and pages without a block of main text, give an
    empty text; broken markup is read to its end; repeated rows are returned each; an empty table gives no rows;
    other columns are ignored.
    """
    told = pages.select(*columns, F.col("html").alias("_html"))
    kept = pages.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                texts = pa.array(main_texts(batch.column("_html").to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), texts], names=[*columns, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields] + ["text string"]
    return told.mapInArrow(run, ", ".join(fields))
