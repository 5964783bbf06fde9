"""Row predicates with two-valued logic, built in Python and lowered to Spark columns.

A comparison is numeric if its literal reads as a number; then a text cell that doesn't read as one
fails every operator, also !=. There is no null: what can't be compared fails, and NOT of that holds.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import literal_number, number

OPERATORS: dict[str, Callable] = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
#: A date, of which day and month may be missing, and perhaps a time of day.
_TIME = re.compile(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?)?)?", re.ASCII)


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Cmp(Predicate):
    column: str
    op: str
    value: object

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}; known: {', '.join(OPERATORS)}")


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate


@dataclass(frozen=True)
class Like(Predicate):
    """The cell as text against a pattern: % is any text, _ any character, and a backslash takes either as it is."""

    column: str
    pattern: str


@dataclass(frozen=True)
class Missing(Predicate):
    """A cell without a value: empty text, or null in a typed column."""

    column: str


class Field:
    """A column to compare, by name: field("amount") > 100."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __eq__(self, value: object) -> Predicate:  # type: ignore[override]
        return Cmp(self.name, "=", value)

    def __ne__(self, value: object) -> Predicate:  # type: ignore[override]
        return Cmp(self.name, "!=", value)

    def __lt__(self, value: object) -> Predicate:
        return Cmp(self.name, "<", value)

    def __le__(self, value: object) -> Predicate:
        return Cmp(self.name, "<=", value)

    def __gt__(self, value: object) -> Predicate:
        return Cmp(self.name, ">", value)

    def __ge__(self, value: object) -> Predicate:
        return Cmp(self.name, ">=", value)

    def isin(self, *values: object) -> Predicate:
        """Equal to one of the values at least; of none of them nothing is."""
        found: Predicate | None = None
        for v in values:
            found = self == v if found is None else found | (self == v)
        return found if found is not None else Missing(self.name) & ~Missing(self.name)

    def between(self, low: object, high: object) -> Predicate:
        """From low to high, both included."""
        return (self >= low) & (self <= high)

    def like(self, pattern: str) -> Predicate:
        return Like(self.name, pattern)

    def missing(self) -> Predicate:
        return Missing(self.name)

    __hash__ = None  # type: ignore[assignment]


def field(name: str) -> Field:
    return Field(name)


def lower(predicate: Predicate, resolve: Callable[[str], tuple[Column, T.DataType]], negated: bool = False) -> Column:
    """The predicate as a column. NOT moves down to the comparisons, so positive ones stay as the scan can take them."""
    match predicate:
        case Not(inner):
            return lower(inner, resolve, not negated)
        case And(a, b) | Or(a, b):
            left, right = lower(a, resolve, negated), lower(b, resolve, negated)
            return left & right if isinstance(predicate, And) != negated else left | right
        case Cmp(name, op, value):
            column, kind = resolve(name)
            holds = _compare(column, kind, op, value)
            return F.coalesce(~holds, F.lit(True)) if negated else holds
        case Like(name, pattern):
            column, kind = resolve(name)
            holds = (column if isinstance(kind, T.StringType) else column.cast("string")).like(pattern)
            return F.coalesce(~holds, F.lit(True)) if negated else holds
        case Missing(name):
            column, kind = resolve(name)
            empty = column.isNull() | (column == "") if isinstance(kind, T.StringType) else column.isNull()
            return ~empty if negated else empty
    raise TypeError(f"not a predicate: {predicate!r}")


def _compare(column: Column, kind: T.DataType, op: str, value: object) -> Column:
    apply, as_number = OPERATORS[op], literal_number(value)
    if isinstance(kind, _NUMERIC) and as_number is not None:
        if math.isnan(as_number):
            return F.when(column.isNotNull(), F.lit(op == "!="))
        exact = int(as_number) if as_number.is_integer() and abs(as_number) < 2**53 else as_number
        holds = apply(column, F.lit(exact))
        # Spark takes not-a-number for the greatest number; here it differs from every number and is not above any.
        return holds & ~F.isnan(column) if isinstance(kind, (T.FloatType, T.DoubleType)) and op in (">", ">=") else holds
    if isinstance(kind, _TIMES):
        return apply(column, F.lit(_time(value)).cast(kind))
    text = column if isinstance(kind, T.StringType) else column.cast("string")
    if as_number is None:
        return apply(text, F.lit(str(value)))
    cell = number(text)
    if math.isnan(as_number):
        return F.when(cell.isNotNull(), F.lit(op == "!="))
    return F.when(F.isnan(cell), F.lit(op == "!=")).otherwise(apply(cell, F.lit(as_number)))


def _time(value: object) -> str:
    """The text of a literal that is compared with times, which must be one."""
    text = str(value)
    if m := _TIME.fullmatch(text):
        year, month, day, hour, minute, second = (int(x or d) for x, d in zip(m.groups(), (0, 1, 1, 0, 0, 0), strict=True))
        try:
            datetime(year, month, day, hour, minute, second)
        except ValueError:
            pass
        else:
            return text
    raise ValueError(f"not a date or time: {text!r}")
