"""The queries of the library as a fluent interface: where, select, group_by, limit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import number
from ..plans.predicates import Predicate, lower

POSITION = "__position"
FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX")


@dataclass(frozen=True)
class Agg:
    """An aggregate of a column; COUNT takes * too. name is the output's, by default FUNCTION(column)."""

    function: str
    column: str = "*"
    name: str | None = None

    def __post_init__(self) -> None:
        if self.function.upper() not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {self.function!r}; known: {', '.join(FUNCTIONS)}")
        if self.column == "*" and self.function.upper() != "COUNT":
            raise ValueError(f"{self.function}(*) is not defined")

    @property
    def label(self) -> str:
        return self.name or f"{self.function}({self.column})"


@dataclass(frozen=True)
class Table:
    """Rows with unique internal column names and the header that the user sees.

    Names are looked up without regard to case and to space around header names; of repeated names
    the last counts.
    """

    df: DataFrame
    header: list[str]
    #: Places of averages, which are null over no number until they are put out.
    averages: tuple[int, ...] = ()
    #: Rows are to be numbered by their order: not before filters, which then still reach the scan.
    unnumbered: bool = False

    @classmethod
    def of(cls, df: DataFrame) -> Table:
        return cls(df, list(df.columns))

    def _place(self, name: str, what: str = "column") -> int:
        places = {h.strip().lower(): i for i, h in enumerate(self.header)}
        if (at := places.get(name.strip().lower())) is None:
            raise ValueError(f"{what} not found: {name}")
        return at

    def _resolve(self, name: str) -> tuple[Column, T.DataType]:
        column = self.df.columns[self._place(name)]
        return F.col(f"`{column}`"), self.df.schema[column].dataType

    def ordered(self) -> Table:
        """Remembers the order of a single file's rows, for order-preserving output. Several files have no defined order."""
        return self if self.is_ordered else replace(self, unnumbered=True)

    @property
    def is_ordered(self) -> bool:
        return self.unnumbered or POSITION in self.df.columns

    def numbered(self) -> Table:
        """With the rows' order as a column, if the table is ordered."""
        return replace(self, df=self.df.withColumn(POSITION, F.monotonically_increasing_id()), unnumbered=False) if self.unnumbered else self

    def where(self, predicate: Predicate) -> Table:
        return replace(self, df=self.df.where(lower(predicate, self._resolve)))

    def select(self, *names: str | tuple[str, str]) -> Table:
        """Columns in the order given, repeats allowed; * or none is all. A pair is a column and its new name; else names are spelled as in the header."""
        if not names or names == ("*",):
            return self
        t = self.numbered()
        pairs = [n if isinstance(n, tuple) else (n, None) for n in names]
        places = [t._place(n) for n, _ in pairs]
        columns = [F.col(f"`{t.df.columns[p]}`").alias(f"p{i}") for i, p in enumerate(places)]
        header = [alias or t.header[p] for p, (_, alias) in zip(places, pairs, strict=True)]
        return Table(t.df.select(*columns, *[POSITION] * t.is_ordered), header, tuple(i for i, p in enumerate(places) if p in t.averages))

    def limit(self, n: int, offset: int = 0) -> Table:
        """The first n rows after offset of them if ordered, else any n. Of an order by columns Spark keeps n + offset rows a task."""
        if n < 0 or offset < 0:
            raise ValueError("LIMIT and OFFSET must not be negative")
        t = self.numbered()
        df = t.df.orderBy(POSITION) if t.is_ordered else t.df
        return replace(t, df=(df.offset(offset) if offset else df).limit(n))

    def order_by(self, *keys: str | tuple[str, str]) -> Table:
        """Rows by columns, each a name or a pair of name and "asc" or "desc". Text cells that are numbers come first, by value, then other text; missing numbers come first of all."""
        t = replace(self, unnumbered=False)
        order: list[Column] = []
        for k in keys:
            name, way = k if isinstance(k, tuple) else (k, "asc")
            if way not in ("asc", "desc"):
                raise ValueError(f"unknown order {way!r}; known: asc, desc")
            column, kind = t._resolve(name)
            parts = [number(column).isNull(), number(column), column] if isinstance(kind, T.StringType) else [column]
            order += [p.asc() if way == "asc" else p.desc() for p in parts]
        return replace(t, df=t.df.drop(POSITION).orderBy(*order))

    def distinct(self) -> Table:
        """Each different row once, the first of them if ordered."""
        t = self.numbered()
        return replace(t, df=t.df.groupBy([c for c in t.df.columns if c != POSITION]).agg(F.min(POSITION).alias(POSITION)) if t.is_ordered else t.df.distinct())

    def with_case(self, name: str, cases: Sequence[tuple[Predicate, object]], default: object = None) -> Table:
        """One more column: the value of the first case whose predicate holds, else the default."""
        if not cases:
            raise ValueError("CASE needs a case")
        t, value = self.numbered(), None
        for predicate, result in cases:
            holds = lower(predicate, t._resolve)
            value = F.when(holds, F.lit(result)) if value is None else value.when(holds, F.lit(result))
        return replace(t, df=t.df.select(*[c for c in t.df.columns if c != POSITION], value.otherwise(F.lit(default)).alias(f"case{len(t.header)}"), *[POSITION] * t.is_ordered), header=[*t.header, name])

    def group_by(self, *keys: str) -> Grouped:
        return Grouped(self, list(keys))

    def aggregate(self, *aggs: Agg) -> Table:
        """One row of aggregates over all rows."""
        return Grouped(self, []).agg(*aggs)

    def to_df(self) -> DataFrame:
        """A DataFrame with the header's names."""
        df = self.df.drop(POSITION)
        filled = [F.coalesce(c, F.lit(0.0)) if i in self.averages else F.col(f"`{c}`") for i, c in enumerate(df.columns)]
        return df.select([c.alias(f"o{i}") for i, c in enumerate(filled)]).toDF(*self.header)


@dataclass(frozen=True)
class Grouped:
    table: Table
    keys: list[str]

    def distinct(self) -> Table:
        return self.agg()

    def agg(self, *aggs: Agg) -> Table:
        """Keys in the order given, then aggregates.

        COUNT counts rows whatever its column. SUM and AVG of no number are 0, MIN and MAX null.
        Text cells that don't read as numbers are left out, of not-a-number MIN and MAX too.
        """
        t = self.table.numbered()
        keys = [F.col(f"`{t.df.columns[t._place(k, 'GROUP BY column')]}`") for k in self.keys]
        columns = [_aggregate(a, *(t._resolve(a.column) if a.column != "*" else (F.lit(1), T.IntegerType()))).alias(f"a{i}") for i, a in enumerate(aggs)]
        columns += [F.min(POSITION).alias(POSITION)] * t.is_ordered
        named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
        if columns:
            df = t.df.groupBy(*named).agg(*columns)
        else:
            df = t.df.select(*named).distinct()
        averages = tuple(len(keys) + i for i, a in enumerate(aggs) if a.function.upper() == "AVG")
        return Table(df, [*self.keys, *(a.label for a in aggs)], averages)


def _aggregate(agg: Agg, column: Column, kind: T.DataType) -> Column:
    function = agg.function.upper()
    if function == "COUNT":
        return F.count(F.lit(1))
    if isinstance(kind, T.StringType):
        value = number(column)
        extreme = F.when(~F.isnan(value), value)
    else:
        value = extreme = column.cast("double")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            extreme = F.when(~F.isnan(value), value)
    match function:
        case "SUM":
            return F.coalesce(F.sum(value), F.lit(0.0))
        case "AVG":
            return F.avg(value)
        case "MIN":
            return F.min(extreme)
        case _:
            return F.max(extreme)
