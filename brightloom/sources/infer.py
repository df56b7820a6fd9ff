"""Column types from text cells: one aggregate over all columns, one type a column (the widest that every cell fits)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LONG, _DOUBLE = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))([eE][+-]?[0-9]+)?$"
_PADDED = r"^[+-]?0[0-9]+$"
_VECTOR = r"^\[\s*[+-]?[0-9.eE+-]+([,\s]+[+-]?[0-9.eE+-]+)*\s*\]$"
_ORDER = ("bool", "long", "number", "vector")


def _fits(c: Column, kind: str, padded_text: bool) -> Column:
    plain = ~c.rlike(_PADDED) if padded_text else F.lit(True)
    is_long = c.rlike(_LONG) & plain & c.try_cast("bigint").isNotNull()
    if kind == "bool":
        return c.isin("true", "TRUE", "false", "FALSE")
    if kind == "long":
        return is_long
    if kind == "number":
        return is_long | (c.rlike(_DOUBLE) & c.try_cast("double").isNotNull())
    return c.rlike(_VECTOR)


def infer(df: DataFrame, padded_text: bool = True, null_words: bool = False) -> DataFrame:
    """df, all text, with empty cells null and each column cast. padded_text: 007 stays text; null_words: null and NULL are null."""
    cell = {c: F.nullif(F.col(f"`{c}`"), F.lit("")) for c in df.columns}
    if null_words:
        cell = {c: F.when(~v.isin("null", "NULL"), v) for c, v in cell.items()}
    cells = df.select(*(v.alias(c) for c, v in cell.items()))
    asks = [F.bool_and(_fits(F.col(f"`{c}`"), k, padded_text)).alias(f"{i}_{k}") for i, c in enumerate(cells.columns) for k in _ORDER]
    got = cells.agg(*asks).first() if asks else None
    out = []
    for i, c in enumerate(cells.columns):
        col, kind = F.col(f"`{c}`"), next((k for k in _ORDER if got[f"{i}_{k}"]), "string")
        if kind == "vector":
            col = F.transform(F.split(F.trim(F.regexp_replace(col, r"[\[\]]", " ")), r"[,\s]+"), lambda x: x.cast("float"))
        elif kind != "string":
            col = col.cast({"bool": "boolean", "long": "bigint", "number": "double"}[kind])
        out.append(col.alias(c))
    return cells.select(*out)
