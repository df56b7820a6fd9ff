"""Relational operators on DataFrames: filters, projections, joins, unions, order, windows. All are lazy and built-in only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions.coerce import family, time_ms, time_text

OPS = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", "<": "<", ">": ">", "<=": "<=", ">=": ">="}
INVERSE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
_APPLY = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Ref:
    """The right side of a comparison with another column."""

    name: str


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class Bool:
    """op: and, or."""

    op: str
    parts: tuple


def column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ValueError(f"column not found: {name}")
    return df[f"`{name}`"]


def _literal_family(value: Any) -> str:
    return "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "other"


def condition(df: DataFrame, tree: Compare | Bool) -> Column:
    """The Column of a predicate. Values of different families never match; null matches only = NULL."""
    if isinstance(tree, Bool):
        parts = [condition(df, p) for p in tree.parts]
        return reduce((lambda a, b: a & b) if tree.op == "and" else (lambda a, b: a | b), parts)
    if tree.op not in OPS:
        raise ValueError(f"unsupported operator: {tree.op}")
    op, left = OPS[tree.op], column(df, tree.column)
    mine = family(df.schema[tree.column].dataType)
    if isinstance(tree.value, Ref):
        right, other = column(df, tree.value.name), family(df.schema[tree.value.name].dataType)
    elif tree.value is None:
        return left.isNull() if op == "=" else left.isNotNull() if op == "!=" else F.lit(False)
    else:
        right, other = F.lit(tree.value), _literal_family(tree.value)
        if mine == "time" and other == "string":  # a time column takes the text of a time, as a timestamp the scan can use
            right, other = F.lit(tree.value).cast(df.schema[tree.column].dataType), "time"
        elif mine == "time" and other == "number":
            left, mine = time_ms(left, df.schema[tree.column].dataType), "number"
    if mine != other and "null" not in (mine, other):
        return F.lit(False)
    return _APPLY[op](left, right)


def where(df: DataFrame, tree: Compare | Bool) -> DataFrame:
    return df.where(condition(df, tree))


def filter_(df: DataFrame, name: str, op: str, value: Any) -> DataFrame:
    return where(df, Compare(name, op, value))


def invert(tree: Compare) -> Compare:
    if isinstance(tree, Bool):
        raise ValueError("compound NOT is not supported in SQL v1")
    return Compare(tree.column, INVERSE[OPS[tree.op]], tree.value)


def select(df: DataFrame, names: Sequence[str], aliases: Sequence[str] | None = None) -> DataFrame:
    return df.select(*(column(df, n).alias(a) for n, a in zip(names, aliases or names, strict=True)))


def select_by_indices(df: DataFrame, indices: Sequence[int], aliases: Sequence[str] | None = None) -> DataFrame:
    return select(df, [df.columns[i] for i in indices], aliases)


def with_column(df: DataFrame, name: str, source: str | None = None, *, function: str | None = None, args: Sequence = ()) -> DataFrame:
    """A copy of a column, or a function of columns (Ref), literals and nested (function, args) pairs."""
    if function is None:
        return df.withColumn(name, column(df, source))
    return df.withColumn(name, expression(df, (function, *args)).col)


def expression(df: DataFrame, node: Any) -> scalar.Arg:
    if isinstance(node, Ref):
        return scalar.Arg(column(df, node.name), df.schema[node.name].dataType)
    if isinstance(node, tuple):
        name, *args = node
        if name.upper() == "CAST":
            kind = scalar.CASTS[args[1].upper()]
            return scalar.Arg(scalar.cast(expression(df, args[0]), kind), scalar.CAST_TYPES[kind])
        return scalar.call(name, *(expression(df, a) for a in args))
    kinds = {"bool": T.BooleanType(), "number": T.LongType() if isinstance(node, int) else T.DoubleType(), "string": T.StringType()}
    return scalar.Arg(F.lit(node), kinds.get(_literal_family(node), T.NullType()))


def drop(df: DataFrame, name: str) -> DataFrame:
    column(df, name)
    return df.drop(name)


def join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """All left columns, then all right ones; a right name that the left has too gets the suffix _right.

    Keys compare by type: of different families none match. null_safe makes null keys match each other.
    """
    taken, names = set(left.columns), []
    for c in right.columns:
        while c in taken:
            c += "_right"
        taken.add(c)
        names.append(c)
    key = names[right.columns.index(right_on)]
    same = family(left.schema[left_on].dataType) == family(right.schema[right_on].dataType)
    right = right.toDF(*names)
    a, b = left[f"`{left_on}`"], right[f"`{key}`"]
    if not same:  # an equi-join that nothing meets, so that outer sides keep their rows without a nested loop
        right = right.withColumn("__never", F.lit(None).cast("string"))
        return left.join(right, a.cast("string") == F.col("__never"), how).drop("__never")
    return left.join(right, a.eqNullSafe(b) if null_safe else a == b, how)


def union(left: DataFrame, right: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows of both by position, under the left names."""
    if len(left.columns) != len(right.columns):
        raise ValueError("UNION inputs must have the same column count")
    out = left.union(right.toDF(*left.columns))
    return out.distinct() if distinct else out


def order_by(df: DataFrame, names: Sequence[str], ascending: Sequence[bool] | None = None) -> DataFrame:
    """Nulls come last in either direction."""
    up = ascending or [True] * len(names)
    return df.orderBy(*(column(df, n).asc_nulls_last() if a else column(df, n).desc_nulls_last() for n, a in zip(names, up, strict=True)))


def top_n(df: DataFrame, names: Sequence[str], n: int, ascending: Sequence[bool] | None = None) -> DataFrame:
    return order_by(df, names, ascending).limit(n)


def window_start(df: DataFrame, time_col: str, window_ms: int, out: str = "window_start", slide_ms: int = 0, as_text: bool = False) -> DataFrame:
    """Adds the start (epoch milliseconds, or its text) of the windows that hold a row's time; with a slide, one row each, newest first.

    A null time has a null window. Starts are multiples of the window or slide; times before the epoch truncate toward it.
    """
    if window_ms <= 0 or slide_ms < 0 or slide_ms > window_ms:
        raise ValueError("window must be positive, and the slide between 0 and the window")
    ms = time_ms(column(df, time_col), df.schema[time_col].dataType)
    step = slide_ms or window_ms
    last = ms - ms % step
    shown = (lambda c: time_text(c)) if as_text else (lambda c: c)
    if step == window_ms:
        return df.withColumn(out, shown(last))
    n = -(-window_ms // step)
    starts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: last - i * step)
    inside = F.filter(starts, lambda s: ms < s + window_ms)
    return df.withColumn("__ws", F.explode_outer(F.when(ms.isNotNull(), inside))).withColumn(out, shown(F.col("__ws"))).drop("__ws")
