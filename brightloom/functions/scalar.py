"""The scalar functions: arity, result type and a builder of a Column for each name. Null arguments give null."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coerce import number, stamp, text, time_ms

_LEFT, _RIGHT = r"^[ \t\n\x0B\f\r]+", r"[ \t\n\x0B\f\r]+$"
_STRING, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()


@dataclass(frozen=True)
class Arg:
    """A Column and its type, which coercion needs when the plan is made."""

    col: Column
    type: T.DataType


@dataclass(frozen=True)
class Function:
    least: int
    most: int | None
    build: Callable[..., Column]
    type: T.DataType
    strict: str = ""

    def check(self, name: str, n: int) -> None:
        if n < self.least or (self.most is not None and n > self.most):
            want = f"{self.least}" if self.least == self.most else f"at least {self.least}" if self.most is None else f"{self.least} to {self.most}"
            raise ValueError(f"{name} expects {want} argument(s), got {n}")



def _concat_ws(*args: Arg) -> Column:
    cols = [text(a.col) for a in args]
    return reduce(lambda a, b: F.concat(a, cols[0], b), cols[1:]) if len(cols) > 2 else F.when(cols[0].isNotNull(), cols[1])


def _int(a: Arg) -> Column:
    return a.col.cast("int")


def _substr(s: Arg, start: Arg, *length: Arg) -> Column:
    at = F.greatest(_int(start), F.lit(1))
    if not length:
        return F.substr(text(s.col), at)
    # greatest() skips nulls, so a null argument must be asked for
    cut = F.substr(text(s.col), at, F.greatest(_int(length[0]), F.lit(0)))
    return F.when(start.col.isNotNull() & length[0].col.isNotNull(), cut)


def cast(arg: Arg, kind: str) -> Column:
    """STRING, INT (64 bit, truncating), DOUBLE or BOOL. A text is true only as 'true' or '1'; other bad texts raise."""
    if kind == "BOOL":
        return F.lower(arg.col).isin("true", "1") if isinstance(arg.type, T.StringType) else arg.col.cast("boolean")
    return arg.col.cast({"STRING": "string", "INT": "bigint", "DOUBLE": "double"}[kind])


CASTS = {
    "STRING": "STRING", "TEXT": "STRING", "VARCHAR": "STRING", "INT": "INT", "INTEGER": "INT", "INT64": "INT", "BIGINT": "INT", "DOUBLE": "DOUBLE", "FLOAT": "DOUBLE",
    "REAL": "DOUBLE", "BOOL": "BOOL", "BOOLEAN": "BOOL",
}
CAST_TYPES = {"STRING": _STRING, "INT": _LONG, "DOUBLE": _DOUBLE, "BOOL": T.BooleanType()}


def _str1(f: Callable[[Column], Column]) -> Function:
    return Function(1, 1, lambda a: f(text(a.col)), _STRING)


def _num1(f: Callable[[Column], Column]) -> Function:
    return Function(1, 1, lambda a: f(number(a.col)).cast("double"), _DOUBLE)


def _date1(f: Callable[[Column], Column]) -> Function:
    return Function(1, 1, lambda a: f(stamp(a.col, a.type)).cast("bigint"), _LONG)


def _iso_year(t: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), t)


def _now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


_length = Function(1, 1, lambda a: F.length(text(a.col)).cast("bigint"), _LONG)
_left = Function(2, 2, lambda s, n: F.left(text(s.col), _int(n)), _STRING)
_right = Function(2, 2, lambda s, n: F.right(text(s.col), _int(n)), _STRING)
_sub = Function(2, 3, _substr, _STRING)
_clock = Function(0, 0, _now, _STRING)
_today = Function(0, 0, lambda: F.date_format(F.current_date(), "yyyy-MM-dd"), _STRING)
_week = _date1(F.weekofyear)

FUNCTIONS: dict[str, Function] = {
    "LOWER": _str1(F.lower), "UPPER": _str1(F.upper),
    "TRIM": _str1(lambda c: F.regexp_replace(F.regexp_replace(c, _LEFT, ""), _RIGHT, "")),
    "LTRIM": _str1(lambda c: F.regexp_replace(c, _LEFT, "")), "RTRIM": _str1(lambda c: F.regexp_replace(c, _RIGHT, "")),
    "LENGTH": _length, "LEN": _length, "CHAR_LENGTH": _length, "CHARACTER_LENGTH": _length,
    "REVERSE": _str1(F.reverse),
    "CONCAT": Function(1, None, lambda *a: F.concat(*(text(x.col) for x in a)), _STRING),
    "CONCAT_WS": Function(2, None, _concat_ws, _STRING),
    "LEFT": _left, "RIGHT": _right, "SUBSTR": _sub, "SUBSTRING": _sub,
    "POSITION": Function(2, 2, lambda n, s: F.instr(text(s.col), text(n.col)).cast("bigint"), _LONG),
    "REPLACE": Function(3, 3, lambda s, a, b: F.replace(text(s.col), text(a.col), text(b.col)), _STRING),
    "ABS": _num1(F.abs), "CEIL": _num1(F.ceil), "FLOOR": _num1(F.floor), "ROUND": _num1(lambda c: F.round(c, 0)),
    "YEAR": _date1(F.year), "MONTH": _date1(F.month), "DAY": _date1(F.dayofmonth),
    "ISO_YEAR": _date1(_iso_year), "ISO_WEEK": _week, "WEEK": _week,
    "YEARWEEK": _date1(lambda t: _iso_year(t).cast("bigint") * 100 + F.weekofyear(t)),
    "NOW": _clock, "CURRENT_TIMESTAMP": _clock, "CURRENTTIMESTAMP": _clock, "TODAY": _today, "CURRENT_DATE": _today,
    "UNIX_TIMESTAMP": Function(0, 1, lambda *a: F.expr("unix_timestamp()") if not a else (lambda ms: ((ms - ms % 1000) / 1000).cast("bigint"))(time_ms(a[0].col, a[0].type)), _LONG),
}
ALIASES = {"BTRIM": "TRIM"}


def lookup(name: str) -> Function:
    key = ALIASES.get(name.upper(), name.upper())
    if key not in FUNCTIONS:
        raise KeyError(f"unsupported function: {name}")
    return FUNCTIONS[key]


def call(name: str, *args: Arg) -> Arg:
    f = lookup(name)
    f.check(name.upper(), len(args))
    return Arg(f.build(*args), f.type)
