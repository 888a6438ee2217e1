"""Connections and cursors in the manner of Python's DB-API."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from .engine import Engine, Transaction
from .errors import EngineError, TransactionError
from .plans.parser import parse
from .plans.syntax import Select


def connect(path: str, spark: SparkSession | None = None) -> Connection:
    """A connection to the tables in a folder. Statements commit by themselves until ``begin``."""
    return Connection(Engine(spark or SparkSession.builder.getOrCreate(), path))


class Connection:
    def __init__(self, engine: Engine):
        self.engine = engine
        self.tx: Transaction | None = None

    def cursor(self) -> Cursor:
        return Cursor(self)

    def execute(self, sql: str, parameters: tuple = ()) -> Cursor:
        return self.cursor().execute(sql, parameters)

    def begin(self) -> None:
        if self.tx:
            raise TransactionError("already in a transaction")
        self.tx = self.engine.begin()

    def commit(self) -> None:
        tx, self.tx = self._active(), None
        tx.commit()

    def rollback(self) -> None:
        tx, self.tx = self._active(), None
        tx.rollback()

    def _active(self) -> Transaction:
        if not self.tx:
            raise TransactionError("no active transaction")
        return self.tx

    def close(self) -> None:
        if self.tx:
            self.rollback()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.tx:
            (self.rollback if kind else self.commit)()


class Cursor:
    """Runs statements and fetches rows, a partition of them at a time."""

    def __init__(self, connection: Connection):
        self.connection = connection
        self.description: list[tuple] | None = None
        self.rowcount = -1
        self._rows: Iterator = iter(())

    def execute(self, sql: str, parameters: tuple = ()) -> Cursor:
        if parameters:
            raise EngineError("statements take no parameters")
        engine, tx = self.connection.engine, self.connection.tx
        if isinstance(parse(sql), Select):
            rows = engine.query(sql, tx)
            self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in rows.schema.fields]
            self.rowcount, self._rows = -1, rows.toLocalIterator()
        else:
            self.description, self._rows = None, iter(())
            self.rowcount = engine.execute(sql, tx)
        return self

    @property
    def columns(self) -> list[str]:
        return [d[0] for d in self.description or ()]

    @property
    def lastrowid(self):
        raise EngineError("rows have no insert ids")

    def fetchone(self) -> tuple | None:
        row = next(self._rows, None)
        return None if row is None else tuple(row)

    def fetchmany(self, size: int = 1) -> list[tuple]:
        return [tuple(r) for _, r in zip(range(size), self._rows, strict=False)]

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self._rows]

    def __iter__(self) -> Iterator[tuple]:
        return map(tuple, self._rows)

    def close(self) -> None:
        self._rows = iter(())
