"""The engine: statements in, DataFrames or counts of changed rows out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CATALOGS, catalog_rows, fields_of_table
from .errors import AnalysisError, TransactionError
from .functions.comparisons import comparison, condition, operand
from .operators import index_select
from .plans import cost
from .plans.binder import bind
from .plans.parser import parse
from .plans.syntax import Constant, CreateIndex, CreateTable, CreateView, Delete, Insert, Name, Predicate, Select, Statement, Term, Update
from .sources import external
from .sources.store import INDEXES, Store, table_entry
from .types import Field, fields_of, layout, spark_schema, stored_value

#: Rows that inserts of one transaction gather before they are written as a part.
PENDING_ROWS = 10_000


class Transaction:
    """A state that grows from a committed one: reads see it, a commit makes it the committed one, a rollback drops it.

    The first write takes the writer's lock and starts from the state committed by then; if that is newer than what the transaction has read, the
    write fails.
    """

    def __init__(self, engine: Engine):
        self.engine, self.store = engine, engine.store
        self.manifest = engine.store.manifest()
        self.token: str | None = None
        self.pending: dict[str, list[tuple]] = {}
        self.open = True
        self.read_any = False

    def write(self) -> dict:
        """The manifest to change, with the lock held."""
        if not self.open:
            raise TransactionError("the transaction has ended")
        if self.token is None:
            token = self.store.lock()
            now = self.store.manifest()
            if now["version"] != self.manifest["version"]:
                if self.read_any:
                    self.store.unlock(token)
                    raise TransactionError("what this transaction has read has been changed since")
                self.manifest = now
            self.token = token
        return self.manifest

    def flush(self, name: str | None = None) -> None:
        """Writes gathered inserts as one part a table."""
        for table in [name] if name else list(self.pending):
            if rows := self.pending.pop(table, None):
                entry = self.manifest["tables"][table]
                schema = spark_schema(fields_of_table(entry))
                self.store.add_part(table, entry, self.engine.spark.createDataFrame(rows, schema).coalesce(1))

    def commit(self) -> None:
        if not self.open:
            raise TransactionError("no active transaction")
        try:
            if self.token is not None:
                self.flush()
                self.store.commit(self.manifest, self.token)
        finally:
            self._end()

    def rollback(self) -> None:
        if not self.open:
            raise TransactionError("no active transaction")
        try:
            if self.token is not None:
                self.store.drop_parts(self.manifest)
        finally:
            self._end()

    def _end(self) -> None:
        self.open = False
        if self.token is not None:
            self.store.unlock(self.token)
            self.token = None


class Engine:
    """Tables in a folder, and files attached to be read.

    ``query`` gives the rows of a SELECT, ``execute`` runs any other statement and gives the number of rows it changed (0 for
    CREATE). Without a transaction each statement is one of its own.
    """

    def __init__(self, spark: SparkSession, path: str, lock_seconds: float = 10.0, block_bytes: int = cost.BLOCK_BYTES, lease_seconds: float = 5.0):
        self.spark, self.block_bytes = spark, block_bytes
        self.store = Store(spark, path, lock_seconds, lease_seconds)
        self.attached: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        self._figures: dict[tuple, cost.Statistics] = {}

    # -- names -----------------------------------------------------------------------------------------------------------------

    def attach(self, name: str, source: str | DataFrame, kind: str = "parquet", **options) -> None:
        """Makes a file, a folder or a DataFrame a read-only table of this engine object."""
        name = name.lower()
        self._free(name, self.store.manifest())
        read = (lambda: source) if isinstance(source, DataFrame) else lambda: external.read(self.spark, source, kind, **options)
        self.attached[name] = lambda: (rows := read()).select(*(F.col(f"`{c}`").alias(c.lower()) for c in rows.columns))

    def _attached(self, name: str) -> DataFrame:
        """The rows of an attached source, whose schema is read when it is first used."""
        found = self.attached[name]
        if not isinstance(found, DataFrame):
            found = self.attached[name] = found()
        return found

    def _free(self, name: str, manifest: dict) -> None:
        if name in manifest["tables"] or name in manifest["views"] or name in self.attached or name in CATALOGS:
            raise AnalysisError(f"{name} already exists")

    def _fields(self, name: str, manifest: dict) -> list[Field]:
        if name in manifest["tables"]:
            return fields_of_table(manifest["tables"][name])
        if name in self.attached:
            return fields_of(self._attached(name).schema)
        raise AnalysisError(f'table "{name}" not found')

    def table(self, name: str, tx: Transaction | None = None) -> DataFrame:
        """The rows of a table, view or catalog."""
        if tx:
            tx.read_any = True
        manifest = tx.manifest if tx else self.store.manifest()
        if name in CATALOGS:
            attached = {n: fields_of(self._attached(n).schema) for n in self.attached}
            return catalog_rows(self.spark, name, manifest, attached)
        if name in manifest["views"]:
            return bind(parse(manifest["views"][name]), lambda n: self.table(n, tx))
        if name in self.attached:
            return self._attached(name)
        if name not in manifest["tables"]:
            raise AnalysisError(f'table "{name}" not found')
        rows = self.store.read(manifest["tables"][name])
        if tx and tx.pending.get(name):
            rows = rows.unionByName(self.spark.createDataFrame(tx.pending[name], rows.schema))
        return rows

    # -- statements ------------------------------------------------------------------------------------------------------------

    def begin(self) -> Transaction:
        return Transaction(self)

    def query(self, sql: str, tx: Transaction | None = None) -> DataFrame:
        """The rows of a SELECT, planned but not computed. A transaction goes on whatever becomes of it."""
        statement = parse(sql)
        if not isinstance(statement, Select):
            raise AnalysisError("not a SELECT")
        return bind(statement, lambda n: self.table(n, tx))

    def execute(self, sql: str, tx: Transaction | None = None) -> int:
        """Runs a statement that is no SELECT; how many rows it changed."""
        statement = parse(sql)
        if isinstance(statement, Select):
            raise AnalysisError("a SELECT is not executed but queried")
        with self._own(tx) as own:
            return self._run(statement, own)

    @contextmanager
    def _own(self, tx: Transaction | None):
        """``tx``, or a transaction that is committed at the end and rolled back by an error."""
        if tx:
            yield tx
            return
        own = self.begin()
        try:
            yield own
        except BaseException:
            own.rollback()
            raise
        own.commit()

    def _run(self, s: Statement, tx: Transaction) -> int:
        run = {Insert: self._insert, Delete: self._delete, Update: self._update, CreateTable: self._create_table, CreateView: self._create_view, CreateIndex: self._create_index}
        return run[type(s)](s, tx)

    def _base(self, name: str, tx: Transaction) -> tuple[dict, list[Field]]:
        """The entry and fields of a table that can be changed."""
        manifest = tx.write()
        if name not in manifest["tables"]:
            raise AnalysisError(f'table "{name}" not found')
        return manifest["tables"][name], fields_of_table(manifest["tables"][name])

    def _insert(self, s: Insert, tx: Transaction) -> int:
        _, fields = self._base(s.table, tx)
        known = {f.name: f for f in fields}
        for name in s.fields:
            if name not in known:
                raise AnalysisError(f"field {name} not found")
        if len(set(s.fields)) < len(s.fields):
            raise AnalysisError("a field is named twice")
        given = dict(zip(s.fields, s.values, strict=True))
        rows = tx.pending.setdefault(s.table, [])
        rows.append(tuple(stored_value(f, given[f.name]) if f.name in given else f.default for f in fields))
        if len(rows) >= PENDING_ROWS:
            tx.flush(s.table)
        return 1

    def insert_rows(self, name: str, rows: DataFrame, tx: Transaction | None = None) -> None:
        """Adds the rows of a DataFrame as one part, written by the executors; columns that it lacks get their defaults."""
        with self._own(tx) as own:
            entry, fields = self._base(name.lower(), own)
            given = {c.lower(): c for c in rows.columns}
            if extra := set(given) - {f.name for f in fields}:
                raise AnalysisError(f"field {sorted(extra)[0]} not found")
            columns = [F.col(f"`{given[f.name]}`").cast(f.spark_type) if f.name in given else F.lit(f.default).cast(f.spark_type) for f in fields]
            for f, column in zip(fields, list(columns), strict=True):
                if f.kind == "varchar" and f.length:
                    fits = F.char_length(column) <= f.length
                    columns[fields.index(f)] = F.when(fits | column.isNull(), column).otherwise(F.raise_error(F.lit(f"value for field {f.name} exceeds {f.length} characters")))
            self.store.add_part(name.lower(), entry, rows.select(*(c.alias(f.name) for c, f in zip(columns, fields, strict=True))))

    def _delete(self, s: Delete, tx: Transaction) -> int:
        entry, fields = self._base(s.table, tx)
        tx.flush(s.table)
        hit = self._condition(s.where, fields)
        return self.store.rewrite(s.table, entry, hit, lambda rows: rows.where(~F.coalesce(hit, F.lit(False))))

    def _update(self, s: Update, tx: Transaction) -> int:
        entry, fields = self._base(s.table, tx)
        known = {f.name: f for f in fields}
        if s.field not in known:
            raise AnalysisError(f"field {s.field} not found")
        tx.flush(s.table)
        target, schema = known[s.field], spark_schema(fields)
        if isinstance(s.value, Constant):
            stored = stored_value(target, s.value.value)
            value: Column = operand(Constant(stored), schema)[0].cast(target.spark_type)
        else:
            value, kind = operand(s.value, schema)
            if kind != target.spark_type and not {known[s.value.name].kind, target.kind} <= {"int", "long", "short"}:
                raise AnalysisError(f"type mismatch for field {s.field}")
            value = value.cast(target.spark_type)
            if target.kind == "varchar" and target.length:
                value = F.when(F.char_length(value) <= target.length, value).otherwise(F.raise_error(F.lit(f"value for field {s.field} exceeds {target.length} characters")))
        hit = self._condition(s.where, fields)
        change = lambda rows: rows.withColumn(s.field, F.when(F.coalesce(hit, F.lit(False)), value).otherwise(F.col(f"`{s.field}`")))
        return self.store.rewrite(s.table, entry, hit, change)

    def _condition(self, where: Predicate, fields: list[Field]) -> Column:
        return condition(where, spark_schema(fields))

    def _create_table(self, s: CreateTable, tx: Transaction) -> int:
        manifest = tx.write()
        self._free(s.table, manifest)
        fields = [Field(f.name, f.kind, f.length) for f in s.fields]
        if len({f.name for f in fields}) < len(fields):
            raise AnalysisError("a field is named twice")
        self.create_table(s.table, fields, tx)
        return 0

    def create_table(self, name: str, fields: list[Field], tx: Transaction | None = None) -> None:
        """A new empty table; also of kinds that the dialect cannot declare."""
        if layout(fields)[1] > self.block_bytes:
            raise AnalysisError(f"a record of {name} is larger than a block")
        with self._own(tx) as own:
            manifest = own.write()
            self._free(name.lower(), manifest)
            manifest["tables"][name.lower()] = table_entry(fields)

    def _create_view(self, s: CreateView, tx: Transaction) -> int:
        manifest = tx.write()
        self._free(s.view, manifest)
        bind(s.query, lambda n: self.table(n, tx))
        manifest["views"][s.view] = s.text
        return 0

    def _create_index(self, s: CreateIndex, tx: Transaction) -> int:
        manifest = tx.write()
        if s.index in manifest["indexes"]:
            raise AnalysisError(f"{s.index} already exists")
        if s.column not in {f.name for f in self._fields(s.table, manifest)}:
            raise AnalysisError(f"field {s.column} not found")
        manifest["indexes"][s.index] = {"table": s.table, "field": s.column}
        return 0

    # -- catalog ---------------------------------------------------------------------------------------------------------------

    def schema(self, name: str) -> list[Field]:
        """The fields of a table."""
        return self._fields(name.lower(), self.store.manifest())

    def view_definition(self, name: str) -> str:
        """The text of a view; empty if there is none."""
        return self.store.manifest()["views"].get(name.lower(), "")

    def indexes(self, table: str) -> dict[str, str]:
        """The name of the index of each indexed field; of several the last."""
        return {x["field"]: i for i, x in self.store.manifest()["indexes"].items() if x["table"] == table.lower()}

    def statistics(self, name: str, tx: Transaction | None = None) -> cost.Statistics:
        """Exact records, blocks and distinct values of a table; kept until the table changes."""
        name = name.lower()
        manifest = tx.manifest if tx else self.store.manifest()
        fields = self._fields(name, manifest)
        pending = len(tx.pending.get(name, ())) if tx else 0
        key = (name, json.dumps(manifest["tables"].get(name, {}).get("parts")), pending, id(self.attached.get(name) and self._attached(name)))
        if key not in self._figures:
            rows = self.table(name, tx)
            column = lambda f: F.col(f"`{f.name}`")
            # a job a column, which reads that column alone; all at once would make a row for each row and column
            distinct = {f.name: rows.select(column(f)).where(column(f).isNotNull()).distinct().count() for f in fields}
            self._figures[key] = cost.Statistics.of(rows.count(), layout(fields)[1], distinct, self.block_bytes)
        return self._figures[key]

    def refresh_statistics(self) -> None:
        self._figures.clear()

    def table_plan(self, name: str, tx: Transaction | None = None) -> cost.Plan:
        """The estimate of a table or view."""
        manifest = tx.manifest if tx else self.store.manifest()
        if name in manifest["views"]:
            return cost.plan_query(parse(manifest["views"][name]), lambda n: self.table_plan(n, tx), self.block_bytes)
        fields = self._fields(name, manifest)
        return cost.TablePlan(self.statistics(name, tx), [f.name for f in fields], layout(fields)[1])

    def explain_cost(self, sql: str, tx: Transaction | None = None) -> dict[str, int]:
        """Estimated blocks accessed and records output of a SELECT; Catalyst's own plan is ``query(sql).explain()``."""
        statement = parse(sql)
        if not isinstance(statement, Select):
            raise AnalysisError("not a SELECT")
        plan = cost.plan_query(statement, lambda n: self.table_plan(n, tx), self.block_bytes)
        return {"blocks": plan.blocks(), "records": plan.records()}

    def index_estimate(self, index: str, kind: str = "hash") -> cost.IndexEstimate:
        found = self._index(index)
        field = next(f for f in self.schema(found["table"]) if f.name == found["field"])
        record = [Field("block", "int"), Field("id", "int"), field]
        return cost.IndexEstimate(self.statistics(found["table"]), field.name, layout(record)[1], self.block_bytes, kind)

    # -- index layouts ---------------------------------------------------------------------------------------------------------

    def _index(self, index: str) -> dict:
        found = self.store.manifest()["indexes"].get(index.lower())
        if not found:
            raise AnalysisError(f'index "{index}" not found')
        return found

    def build_index(self, index: str, kind: str = "hash", buckets: int = cost.HASH_BUCKETS) -> DataFrame:
        """The rows of an index's table in a layout made for lookups by its field, written anew only if the table has changed.

        ``hash``: a folder a bucket of the field's hash, so that a lookup reads one; ``btree``: sorted by ranges of the field, so that a lookup reads the
        row groups whose minimum and maximum enclose it. A layout never changes results; one of an older version is not read.
        """
        found = self._index(index)
        rows = self.table(found["table"])
        version = self._version(found["table"], rows)
        parts = json.dumps([kind, buckets, version])
        folder = f"{INDEXES}/{index.lower()}-{kind}/{uuid.uuid5(uuid.NAMESPACE_OID, parts).hex}"
        field = F.col(f"`{found['field']}`")
        if version is None or not self.store.files.exists(f"{folder}/_SUCCESS"):
            for old in self.store.files.listed(f"{INDEXES}/{index.lower()}-{kind}"):  # older versions, and this one if it was not finished
                self.store.files.delete(f"{INDEXES}/{index.lower()}-{kind}/{old}")
            if kind == "hash":
                bucket = F.pmod(F.xxhash64(field), F.lit(buckets)).cast("int")
                laid = rows.withColumn("_bucket", bucket).repartition("_bucket", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(8)))
                laid.write.partitionBy("_bucket").parquet(self.store.files.url(folder))
            else:
                rows.repartitionByRange(field).sortWithinPartitions(field).write.parquet(self.store.files.url(folder))
        return self.spark.read.parquet(self.store.files.url(folder))

    def _version(self, table: str, rows: DataFrame) -> list | None:
        """What tells one version of a table from another: its parts, or the names, sizes and times of the files attached; None if there is nothing."""
        if table in self.attached:
            return self.store.files.states(rows.inputFiles()) or None
        return self.store.manifest()["tables"].get(table, {}).get("parts")

    def index_lookup(self, index: str, value, kind: str = "hash", buckets: int = cost.HASH_BUCKETS) -> DataFrame:
        """The rows of an index's table whose field equals ``value``."""
        found = self._index(index)
        laid = self.build_index(index, kind, buckets)
        columns = [f.name for f in self.schema(found["table"])]
        if kind == "hash":
            test = comparison(Term(Name(found["field"]), "=", Constant(value)), laid.schema)
            key, _ = operand(Constant(value), laid.schema)
            bucket = F.pmod(F.xxhash64(key.cast(laid.schema[found["field"]].dataType)), F.lit(buckets)).cast("int")
            same = type(value) is not bool or laid.schema[found["field"]].dataType.simpleString() == "boolean"
            wanted = laid.where(test & (F.col("_bucket") == bucket)) if same and self._exact(value, laid.schema[found["field"]].dataType) else laid.where(test)
            return wanted.select(*columns)
        return index_select(laid, found["field"], value).select(*columns)

    @staticmethod
    def _exact(value, kind) -> bool:
        """Whether a constant has the type of a field, so that it hashes as the field does."""
        known = {"int": int, "bigint": int, "smallint": int, "string": str, "boolean": bool}.get(kind.simpleString())
        bits = {"int": 31, "bigint": 63, "smallint": 15}.get(kind.simpleString(), 0)
        return known is type(value) and (known is not int or -(1 << bits) <= value < 1 << bits)

    # -- upkeep ----------------------------------------------------------------------------------------------------------------

    def recover(self) -> list[str]:
        """Deletes what writers that died have left; waits for a live one first, takes the lock over from a dead one."""
        token = self.store.lock()
        try:
            return self.store.recover()
        finally:
            self.store.unlock(token)

    def vacuum(self, older_than: float = 7 * 86_400.0) -> list[str]:
        """Deletes the parts that were replaced ``older_than`` seconds ago or before; rows read from states that old are lost."""
        token = self.store.lock()
        try:
            return self.store.vacuum(older_than, token)
        finally:
            self.store.unlock(token)

    def compact(self, name: str, partitions: int | None = None) -> None:
        """Rewrites a table as one part, as many small inserts make it slow to read."""
        with self._own(None) as tx:
            entry, _ = self._base(name.lower(), tx)
            rows = self.store.read(entry)
            entry["parts"] = []
            self.store.add_part(name.lower(), entry, rows.repartition(partitions) if partitions else rows)
