"""A relational engine on Spark: a compact SQL dialect, transactions over versioned Parquet, a queryable catalog, an operator API."""

from .engine import Engine
from .errors import AnalysisError, EngineError, LockTimeout, SqlSyntaxError, TransactionError
from .session import connect

__all__ = ["AnalysisError", "Engine", "EngineError", "LockTimeout", "SqlSyntaxError", "TransactionError", "connect"]
