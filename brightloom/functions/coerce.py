"""Value coercion shared by functions, predicates and windows. Time is epoch milliseconds, UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def family(dtype: T.DataType) -> str:
    """number, string, bool, time or other: values of different families never compare equal."""
    if isinstance(dtype, NUMERIC):
        return "number"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "null" if isinstance(dtype, T.NullType) else "other"


def time_ms(col: Column, dtype: T.DataType) -> Column:
    """Epoch milliseconds of a timestamp, a date, a number (already milliseconds) or a text.

    A text is all digits (milliseconds), empty (zero), or yyyy-MM-dd with an optional time after 'T' or a blank; anything
    else raises.
    """
    kind = family(dtype)
    if kind == "time":
        return F.unix_millis(col.cast("timestamp"))
    if kind == "number":
        return col.cast("long")
    if kind == "null":
        return F.lit(None).cast("long")
    if kind != "string":
        raise TypeError(f"not a time: {dtype.simpleString()}")
    parsed = F.coalesce(*(F.try_to_timestamp(col, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))
    return (
        F.when(col.isNull(), F.lit(None).cast("long"))
        .when(col == "", F.lit(0).cast("long"))
        .when(col.rlike(r"^[0-9]+$"), col.try_cast("long"))
        .when(parsed.isNotNull(), F.unix_millis(parsed))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported time text: "), col)).cast("long"))
    )


def stamp(col: Column, dtype: T.DataType) -> Column:
    return F.timestamp_millis(time_ms(col, dtype))


def time_text(ms: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss, with milliseconds only where there are some."""
    at = F.timestamp_millis(ms)
    return F.when(ms % 1000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"))


def text(col: Column) -> Column:
    return col.cast("string")


def number(col: Column) -> Column:
    return col.cast("double")
