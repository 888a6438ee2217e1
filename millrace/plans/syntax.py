"""Syntax trees, predicates included."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection
from dataclasses import dataclass, field

#: Operators by their texts. Fixed values.
OPERATORS = {"=": "=", "==": "=", "<>": "<>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
AGGREGATES = ("max", "min", "count", "avg", "sum")


@dataclass(frozen=True)
class Name:
    """A column."""

    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Constant:
    """An int, string, bool or date."""

    value: object

    def __str__(self) -> str:
        v = self.value
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, dt.datetime):
            return v.strftime("%Y-%m-%d" if v.time() == dt.time() else "%Y-%m-%d %H:%M:%S")
        return f"'{v}'" if isinstance(v, str) else str(v)


@dataclass(frozen=True)
class Aggregate:
    """A function of a column; its result is named ``<function>Of<column>``."""

    function: str
    name: str

    @property
    def output(self) -> str:
        return f"{self.function}Of{self.name}"

    def __str__(self) -> str:
        return f"{self.function}({self.name})"


Expression = Name | Constant | Aggregate


def column_of(e: Expression) -> str | None:
    """The column an expression reads: of an aggregate its result's; None for constants."""
    return e.name if isinstance(e, Name) else e.output if isinstance(e, Aggregate) else None


@dataclass(frozen=True)
class Term:
    """A comparison of two expressions."""

    left: Expression
    op: str
    right: Expression

    @property
    def columns(self) -> set[str]:
        return {c for c in map(column_of, (self.left, self.right)) if c}

    def _with_constant(self, name: str) -> Constant | None:
        for a, b in ((self.left, self.right), (self.right, self.left)):
            if column_of(a) == name and isinstance(b, Constant):
                return b
        return None

    def equates_with_constant(self, name: str):
        """c of ``name = c`` or ``c = name``; None otherwise."""
        found = self._with_constant(name) if self.op == "=" else None
        return found and found.value

    def compares_with_constant(self, name: str) -> tuple[str, object] | None:
        """(operator as written, c) of a comparison of ``name`` with a constant on either side."""
        found = self._with_constant(name)
        return found and (self.op, found.value)

    def equates_with_field(self, name: str) -> str | None:
        """The other column of ``name = column``."""
        left, right = column_of(self.left), column_of(self.right)
        if self.op == "=" and left and right:
            return right if left == name else left if right == name else None
        return None

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Predicate:
    """Terms that must all hold; none: always true."""

    terms: tuple[Term, ...] = ()

    def conjoin(self, other: Predicate) -> Predicate:
        return Predicate(self.terms + other.terms)

    def sub_predicate(self, columns: Collection[str]) -> Predicate | None:
        """The terms that only read ``columns``; None if there are none."""
        found = tuple(t for t in self.terms if t.columns <= set(columns))
        return Predicate(found) if found else None

    def join_predicate(self, first: Collection[str], second: Collection[str]) -> Predicate | None:
        """The terms that need columns of both; None if there are none."""
        a, b = set(first), set(second)
        found = tuple(t for t in self.terms if t.columns <= a | b and not t.columns <= a and not t.columns <= b)
        return Predicate(found) if found else None

    def _first(self, of):
        return next((x for x in map(of, self.terms) if x is not None), None)

    def equates_with_constant(self, name: str):
        return self._first(lambda t: t.equates_with_constant(name))

    def compares_with_constant(self, name: str) -> tuple[str, object] | None:
        return self._first(lambda t: t.compares_with_constant(name))

    def equates_with_field(self, name: str) -> str | None:
        return self._first(lambda t: t.equates_with_field(name))

    @property
    def columns(self) -> set[str]:
        return set().union(*(t.columns for t in self.terms))

    def __str__(self) -> str:
        return " and ".join(map(str, self.terms))


@dataclass(frozen=True)
class Order:
    key: Name | Aggregate
    descending: bool = False


@dataclass(frozen=True)
class Select:
    fields: tuple[str, ...]
    aggregates: tuple[Aggregate, ...]
    tables: tuple[str, ...]
    where: Predicate = Predicate()
    group_by: tuple[str, ...] = ()
    having: Predicate = Predicate()
    order_by: tuple[Order, ...] = ()


@dataclass(frozen=True)
class Insert:
    table: str
    fields: tuple[str, ...]
    values: tuple[object, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: Predicate = Predicate()


@dataclass(frozen=True)
class Update:
    table: str
    field: str
    value: Expression
    where: Predicate = Predicate()


@dataclass(frozen=True)
class FieldDefinition:
    name: str
    kind: str
    length: int = 0


@dataclass(frozen=True)
class CreateTable:
    table: str
    fields: tuple[FieldDefinition, ...]


@dataclass(frozen=True)
class CreateView:
    view: str
    query: Select
    text: str = field(compare=False, default="")


@dataclass(frozen=True)
class CreateIndex:
    index: str
    table: str
    column: str


Statement = Select | Insert | Delete | Update | CreateTable | CreateView | CreateIndex
