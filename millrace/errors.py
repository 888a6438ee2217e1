"""Errors of the engine."""


class EngineError(Exception):
    """Any error of the engine."""


class SqlSyntaxError(EngineError):
    """A text that the dialect does not accept."""


class AnalysisError(EngineError):
    """A statement whose names or types do not fit the catalog."""


class TransactionError(EngineError):
    """A transaction that cannot do what is asked."""


class LockTimeout(TransactionError):
    """Another writer has held the lock for too long."""
