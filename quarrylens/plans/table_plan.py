"""The five-clause table query: select, where, orderBy, offset, limit.

A plan is an immutable value; compiling it gives one lazy DataFrame, evaluated as
where -> orderBy -> offset -> limit -> select.  Nulls sort lowest, as the smallest
value, in comparisons and in ordering alike.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The operators of a filter.
FILTER_OPS = (
    "=",
    "!=",
    "in",
    "contains",
    "startsWith",
    "endsWith",
    ">",
    ">=",
    "<",
    "<=",
    "between",
)
# ICU collation orders a, A, b; binary order is faster and the default.
UNICODE = "UNICODE"


class PlanError(ValueError):
    """A clause that cannot be part of a plan."""


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None

    def __post_init__(self):
        if self.op not in FILTER_OPS:
            raise PlanError(
                f"Invalid filter operator: '{self.op}'. Valid operators: {', '.join(FILTER_OPS)}"
            )
        if self.op == "in" and not isinstance(self.value, (list, tuple)):
            object.__setattr__(self, "value", (self.value,))
        if self.op == "between":
            object.__setattr__(self, "value", _bounds(self.value))


def _bounds(value: Any) -> tuple[Any, Any]:
    if isinstance(value, (list, tuple)) and len(value) >= 2:
        return value[0], value[1]
    if isinstance(value, dict) and "lower" in value and "upper" in value:
        return value["lower"], value["upper"]
    raise PlanError("'between' filter requires [lower, upper] or {lower, upper}")


@dataclass(frozen=True)
class TablePlan:
    select: tuple[str, ...] | None = None
    where: tuple[Filter, ...] = field(default=())
    order_by: tuple[tuple[str, str], ...] | None = None
    offset: int | None = None
    limit: int | None = None

    def merge(self, other: TablePlan) -> TablePlan:
        """Filters add up; every other clause of ``other`` replaces this one's."""
        return TablePlan(
            other.select if other.select is not None else self.select,
            self.where + other.where,
            other.order_by if other.order_by is not None else self.order_by,
            other.offset if other.offset is not None else self.offset,
            other.limit if other.limit is not None else self.limit,
        )

    def without_pagination(self) -> TablePlan:
        return replace(self, offset=None, limit=None)

    @classmethod
    def from_dict(cls, plan: dict[str, Any]) -> TablePlan:
        """Build from ``{select, where, orderBy, offset, limit}``."""
        return cls(
            tuple(plan["select"]) if plan.get("select") else None,
            tuple(_filter_of(f) for f in plan.get("where") or ()),
            tuple((o["column"], _direction(o.get("direction"))) for o in plan["orderBy"])
            if plan.get("orderBy")
            else None,
            plan.get("offset"),
            plan.get("limit"),
        )


def _filter_of(spec: dict[str, Any]) -> Filter:
    value = spec.get("value")
    if spec["op"] == "in":
        value = spec.get("values", value)
    if spec["op"] == "between" and "lower" in spec and "upper" in spec:
        value = (spec["lower"], spec["upper"])
    return Filter(spec["column"], spec["op"], value)


def _direction(direction: str | None) -> str:
    return "desc" if direction == "desc" else "asc"


def parse_filter(text: str) -> Filter:
    """``column:op:value``; the value reads as true, false, null, a number or text."""
    column, _, rest = text.partition(":")
    op, _, raw = rest.partition(":")
    if not column or not op:
        raise PlanError("where must be in the form column:op:value")
    words = {"true": True, "false": False, "null": None}
    if raw in words:
        return Filter(column, op, words[raw])
    try:
        number = float(raw)
    except ValueError:
        return Filter(column, op, raw)
    return Filter(column, op, int(number) if math.isfinite(number) and number.is_integer() else number)


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "other"


def _column_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    return "string" if isinstance(data_type, T.StringType) else "other"


def _as_text(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.ArrayType):
        return F.array_join(F.transform(column, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",")
    text = column.cast("string")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.regexp_replace(text, r"\.0$", "")
    return text


def _same(column: Column, data_type: T.DataType, value: Any) -> Column:
    """Identity without conversion between types; null equals null."""
    if value is None:
        return column.isNull()
    if _kind(value) != _column_kind(data_type):
        return F.lit(False)
    return column.eqNullSafe(F.lit(value))


def _compare(column: Column, data_type: T.DataType, value: Any, collation: str | None):
    """Operands of an ordering comparison: numbers as numbers, all else as text."""
    if _kind(value) == "number" and _column_kind(data_type) == "number":
        return column, F.lit(value)
    text = str(value).lower() if isinstance(value, bool) else str(value)
    left, right = _as_text(column, data_type), F.lit(text)
    return (F.collate(left, collation), F.collate(right, collation)) if collation else (left, right)


def condition(df: DataFrame, clause: Filter, collation: str | None = None) -> Column:
    """Boolean column for one filter, never null."""
    data_type = df.schema[clause.column].dataType
    column, op, value = F.col(f"`{clause.column}`"), clause.op, clause.value
    if op == "=":
        return _same(column, data_type, value)
    if op == "!=":
        return ~_same(column, data_type, value)
    if op == "in":
        out = F.lit(False)
        plain = [v for v in value if v is not None and _kind(v) == _column_kind(data_type)]
        if plain:
            out = F.coalesce(column.isin(plain), F.lit(False))
        return out | column.isNull() if any(v is None for v in value) else out
    if op in ("contains", "startsWith", "endsWith"):
        needle = "" if value is None else (str(value).lower() if isinstance(value, bool) else str(value))
        text = _as_text(column, data_type)
        test = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[op]
        return F.coalesce(test(text, F.lit(needle)), F.lit(False))
    if op == "between":
        lower, upper = value
        return _at_least(column, data_type, lower, collation) & _at_most(column, data_type, upper, collation)
    if op == ">":
        return ~_at_most(column, data_type, value, collation)
    if op == ">=":
        return _at_least(column, data_type, value, collation)
    if op == "<":
        return ~_at_least(column, data_type, value, collation)
    return _at_most(column, data_type, value, collation)


def _at_least(column, data_type, value, collation) -> Column:
    if value is None:
        return F.lit(True)
    left, right = _compare(column, data_type, value, collation)
    return F.coalesce(left >= right, F.lit(False))


def _at_most(column, data_type, value, collation) -> Column:
    if value is None:
        return column.isNull()
    left, right = _compare(column, data_type, value, collation)
    return column.isNull() | F.coalesce(left <= right, F.lit(False))


def _sort_key(df: DataFrame, name: str, direction: str, collation: str | None) -> list[Column]:
    if name not in df.columns:
        return []
    column = F.col(f"`{name}`")
    if collation and isinstance(df.schema[name].dataType, T.StringType):
        column = F.collate(column, collation)
    return [column.desc_nulls_last() if direction == "desc" else column.asc_nulls_first()]


def apply_plan(
    df: DataFrame,
    plan: TablePlan,
    native_order: Sequence[Column] = (),
    collation: str | None = None,
) -> DataFrame:
    """Compile ``plan`` over ``df``; ties and missing orders use ``native_order``."""
    for clause in plan.where:
        if clause.column not in df.columns:
            shown = ", ".join(df.columns[:10])
            raise PlanError(f"Column '{clause.column}' not found. Available columns: {shown}")
        df = df.filter(condition(df, clause, collation))
    keys = [k for c, d in plan.order_by or () for k in _sort_key(df, c, d, collation)]
    keys += list(native_order)
    if keys:
        df = df.orderBy(*keys)
    if plan.offset:
        df = df.offset(plan.offset)
    if plan.limit is not None and plan.limit >= 0:
        df = df.limit(plan.limit)
    if plan.select:
        df = df.select(
            *[
                F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c)
                for c in plan.select
            ]
        )
    return df


@dataclass(frozen=True)
class TableQuery:
    """Immutable query builder over one table."""

    df: DataFrame
    native_order: tuple[Column, ...] = ()
    current: TablePlan = TablePlan()
    collation: str | None = None

    def _with(self, extra: TablePlan) -> TableQuery:
        return replace(self, current=self.current.merge(extra))

    def select(self, columns: Sequence[str]) -> TableQuery:
        columns = tuple(columns)
        if not columns:
            raise PlanError("select requires at least one column")
        return self._with(TablePlan(select=columns))

    def where(self, column: str, op: str, value: Any = None) -> TableQuery:
        return self._with(TablePlan(where=(Filter(column, op, value),)))

    def order_by(self, column: str, direction: str = "asc") -> TableQuery:
        return self._with(TablePlan(order_by=((column, _direction(direction)),)))

    def limit(self, count: int) -> TableQuery:
        return self._with(TablePlan(limit=_whole("limit", count)))

    def offset(self, count: int) -> TableQuery:
        return self._with(TablePlan(offset=_whole("offset", count)))

    def query(self, plan: TablePlan | dict[str, Any]) -> TableQuery:
        return self._with(TablePlan.from_dict(plan) if isinstance(plan, dict) else plan)

    def plan(self) -> TablePlan:
        return self.current

    def rows(self) -> DataFrame:
        return apply_plan(self.df, self.current, self.native_order, self.collation)

    def first(self) -> Row | None:
        return self.limit(1).rows().first()

    def count(self) -> int:
        kept = replace(self.current.without_pagination(), order_by=None)
        return apply_plan(self.df, kept, collation=self.collation).count()


def _whole(name: str, count: Any) -> int:
    if isinstance(count, bool) or not isinstance(count, (int, float)):
        raise PlanError(f"{name} must be a non-negative number")
    if not math.isfinite(count) or count < 0:
        raise PlanError(f"{name} must be a non-negative number")
    return int(count)
