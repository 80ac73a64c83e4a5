"""Which partitions a conjunction of simple comparisons can leave out."""

from __future__ import annotations

import datetime as dt
import decimal
import operator
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType, DateType, DecimalType, FractionalType, IntegralType, StringType, TimestampNTZType, TimestampType

from .layout import Table, partition_period

#: (column, operator, value); of the operator "in", a tuple of values.
Comparison = tuple[str, str, object]
OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_NODES = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
_TURNED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def day_of(value: object) -> dt.date | None:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.datetime.fromisoformat(str(value).strip()).date()
    except ValueError:
        return None


def keeps(key: str, op: str, value: object, slack: int = 0) -> bool:
    """Whether a row of the partition can have a key date (or time) that compares so. slack: days by which rows may lie beside their partition."""
    if op == "in":
        return any(keeps(key, "=", v, slack) for v in value)
    day, (start, end) = day_of(value), partition_period(key)
    if day is None or op not in OPS or op == "<>":
        return True
    last = end - dt.timedelta(1) if end != dt.date.max else end
    if slack:
        start = start - dt.timedelta(slack) if start > dt.date.min else start
        last = last + dt.timedelta(slack) if last < dt.date.max else last
    return {"=": start <= day <= last, "<": start <= day, "<=": start <= day, ">": last >= day, ">=": last >= day}[op]


def kept_partitions(table: Table, comparisons: list[Comparison]) -> list[str]:
    """Partition keys, in order, that the comparisons on the key date or on the partition column leave."""
    date, keys = table.keys[1].lower(), list(table.starts)
    physical = {f.name.lower() for g in table.groups for f in g.schema}
    # Instants are dated by the zone of the session that reads them, which may not be the writer's.
    slack = int(isinstance(table.index.schema[1].dataType, TimestampType))
    for column, op, value in comparisons:
        if column.lower() == date:
            keys = [k for k in keys if keeps(k, op, value, slack)]
        elif column.lower() == table.kind and table.kind not in physical and (op in OPS or op == "in"):
            keys = [k for k in keys if (k.partition("=")[2] in {str(v) for v in value} if op == "in" else OPS[op](k.partition("=")[2], str(value)))]
    return keys


def converted(value: object, kind: DataType) -> object:
    """A comparison's constant (of IN: tuple of them) as Parquet's statistics give values of the type; None where they can't be compared."""
    if isinstance(value, (tuple, list)):
        out = tuple(converted(v, kind) for v in value)
        return None if None in out else out
    try:
        if isinstance(kind, StringType):
            return value if isinstance(value, str) else None
        if isinstance(kind, DateType):
            day = dt.datetime.fromisoformat(str(value).strip()) if not isinstance(value, dt.date) else value
            if isinstance(day, dt.datetime):
                return day.date() if day.time() == dt.time() else None
            return day
        if isinstance(kind, TimestampNTZType):
            return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value).strip())
        if isinstance(kind, IntegralType):
            return int(value) if isinstance(value, (int, decimal.Decimal)) and int(value) == value else None
        if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType):
            return float(value) if isinstance(value, (int, float, decimal.Decimal)) else None
    except (ValueError, OverflowError):
        return None
    return None


def possible(stats, op: str, value: object) -> bool:
    """Whether a row group with these statistics can hold a value that compares so. Without statistics it can."""
    if stats is None or not stats.has_min_max:
        return not (stats is not None and stats.has_null_count and stats.num_values == 0)
    lo, hi = stats.min, stats.max
    try:
        if isinstance(lo, float) and (lo != lo or hi != hi):
            return True
        # NaN lies above all numbers in comparisons, but not in statistics.
        return {"=": lambda: lo <= value <= hi, "in": lambda: any(lo <= v <= hi for v in value), "<": lambda: lo < value, "<=": lambda: lo <= value, ">": lambda: isinstance(hi, float) or hi > value, ">=": lambda: isinstance(hi, float) or hi >= value, "<>": lambda: True}[op]()
    except TypeError:
        return True


def conjuncts(spark: SparkSession, condition: str) -> list[Comparison]:
    """The comparisons of a column with a constant that an SQL condition requires; all else is left to the row filter."""
    return comparisons_in(spark._jsparkSession.sessionState().sqlParser().parseExpression(condition), spark)


def _children(node) -> list:
    return [node.children().apply(i) for i in range(node.children().size())]


def comparisons_in(node, spark: SparkSession | None = None) -> list[Comparison]:
    """Of a Catalyst expression. With a session, constant expressions are folded."""
    kind = node.getClass().getSimpleName()
    if kind == "And":
        return [x for c in _children(node) for x in comparisons_in(c, spark)]
    if kind == "UnresolvedFunction" and node.nameParts().size() == 1 and node.nameParts().apply(0).lower() == "between":
        of, lo, hi = _children(node)
        a, lo, hi = _column(of), _constant(lo, spark), _constant(hi, spark)
        return [(a, op, v) for op, v in ((">=", lo), ("<=", hi)) if a and v is not None]
    if kind == "In":
        a, listed = _column(node.value()), [_constant(node.list().apply(i), spark) for i in range(node.list().size())]
        return [(a, "in", tuple(listed))] if a and None not in listed else []
    if kind == "InSet":
        return []
    if kind not in _NODES:
        return []
    a, b = _children(node)
    if (name := _column(a)) and (y := _constant(b, spark)) is not None:
        return [(name, _NODES[kind], y)]
    if (name := _column(b)) and (x := _constant(a, spark)) is not None:
        return [(name, _TURNED[_NODES[kind]], x)]
    return []


def _column(node) -> str | None:
    kind = node.getClass().getSimpleName()
    if kind == "Cast":  # of a date to a timestamp, to compare: order is kept
        return _column(_children(node)[0]) if node.dataType().simpleString().startswith("timestamp") else None
    if kind == "UnresolvedAttribute":
        return ".".join(node.nameParts().apply(i) for i in range(node.nameParts().size()))
    return node.name() if kind == "AttributeReference" else None


def _constant(node, spark: SparkSession | None = None) -> object:
    """A literal's value: dates, times and strings as text, numbers as they are. None where there is none."""
    if node.getClass().getSimpleName() != "Literal":
        return _folded(node, spark) if spark is not None else None
    if node.value() is None:
        return None
    kind, text = node.dataType().simpleString(), node.toString()
    if kind == "date" or kind.startswith("timestamp") or kind == "string":
        return text
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return int(text)
    if kind in ("float", "double"):
        return float(text)
    return decimal.Decimal(text) if kind.startswith("decimal") else None


def _folded(node, spark: SparkSession) -> object:
    """The value of an expression without columns, if the optimizer makes a constant of it."""
    if any(_names_column(x) for x in _every(node)):
        return None
    try:
        plan = spark.sql(f"SELECT {node.sql()} AS v")._jdf.queryExecution()
        if not plan.analyzed().deterministic():
            return None
        top = plan.optimizedPlan()
        while top.getClass().getSimpleName() != "Project" and top.children().size():
            top = top.children().apply(0)
        value = top.expressions().apply(0)
        if value.getClass().getSimpleName() == "Alias":
            value = _children(value)[0]
        return _constant(value)
    except Exception:  # what can't be folded prunes nothing; the row filter reports errors
        return None


def _every(node) -> Iterator:
    yield node
    for c in _children(node):
        yield from _every(c)


def _names_column(node) -> bool:
    return node.getClass().getSimpleName() in ("UnresolvedAttribute", "AttributeReference", "UnresolvedStar") or "Subquery" in node.getClass().getSimpleName()
