"""The operators as functions of DataFrames."""

from .relational import (
    cross_join,
    group_by,
    index_join,
    index_select,
    materialize,
    move_to,
    positions,
    project,
    row_ids,
    select,
    sort,
)

__all__ = ["cross_join", "group_by", "index_join", "index_select", "materialize", "move_to", "positions", "project", "row_ids", "select", "sort"]
