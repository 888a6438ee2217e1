"""From a syntax tree to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from ..errors import AnalysisError
from ..operators import cross_join, group_by, project, select, sort
from .syntax import Aggregate, Select

#: Name of a table, view or catalog -> its rows.
Resolver = Callable[[str], DataFrame]


def bind(query: Select, resolve: Resolver) -> DataFrame:
    """The rows of a query.

    Tables are joined as written, of equal names the first table's column counts. Output: plain fields, then aggregates. Without GROUP BY,
    aggregates are over all rows. HAVING may name aggregates that are not selected; ORDER BY needs selected keys.
    """
    rows = reduce(cross_join, (resolve(t) for t in query.tables))
    rows = select(rows, query.where)
    names = [*query.fields, *(a.output for a in query.aggregates)]
    if query.group_by or query.aggregates:
        for field in query.fields:
            if field not in query.group_by:
                raise AnalysisError(f"field {field} is neither grouped nor aggregated")
        hidden = [e for t in query.having.terms for e in (t.left, t.right) if isinstance(e, Aggregate)]
        rows = select(group_by(rows, query.group_by, [*query.aggregates, *hidden]), query.having)
    elif query.having.terms:
        raise AnalysisError("HAVING needs GROUP BY or aggregates")
    rows = project(rows, names)
    for item in query.order_by:
        name = item.key.output if isinstance(item.key, Aggregate) else item.key.name
        if name not in names:
            raise AnalysisError(f"ORDER BY key {name} is not selected")
    return sort(rows, query.order_by)
