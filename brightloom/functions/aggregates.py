"""The five aggregates. SUM and AVG are doubles and 0.0 for a group without values; COUNT counts rows; MIN and MAX skip nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import family

NAMES = ("SUM", "COUNT", "AVG", "MIN", "MAX")


def build(name: str, column: str | None, df: DataFrame) -> Column:
    """The aggregate of a column of df (None: all columns, of COUNT). SUM and AVG of a text are errors when planned."""
    name = name.upper()
    if name not in NAMES:
        raise ValueError(f"unsupported aggregate: {name}")
    if name == "COUNT":
        return F.count(F.lit(1))
    col = df[f"`{column}`"]
    if name in ("SUM", "AVG"):
        if family(df.schema[column].dataType) not in ("number", "bool", "null"):
            raise ValueError(f"value is not numeric: {column}")
        return F.coalesce((F.sum if name == "SUM" else F.avg)(col.cast("double")), F.lit(0.0))
    return (F.min if name == "MIN" else F.max)(col)


def aggregate(df: DataFrame, keys: list[str], specs: list[tuple[str, str | None, str]]) -> DataFrame:
    """keys and one column per (aggregate, column, alias). Without keys, an empty input gives no row."""
    made = [build(name, column, df).alias(alias) for name, column, alias in specs]
    if keys:
        return df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*made)
    return df.agg(*made, F.count(F.lit(1)).alias("__rows")).where("__rows > 0").drop("__rows")
