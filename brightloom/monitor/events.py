"""External events: normalisation of payloads, append-only storage, and reads by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def normalize(payloads: DataFrame, source_id: str, mapping: dict[str, str], column: str = "payload_json") -> DataFrame:
    """Standard rows of JSON payloads. mapping: event_time, event_type and source_key to payload fields, and any more fields to add."""
    get = lambda f: F.get_json_object(F.col(f"`{column}`"), f"$.{f}")
    standard = ("event_time", "event_type", "source_key")
    missing = [k for k in standard if k not in mapping]
    if missing:
        raise ValueError(f"mapping lacks {missing}")
    more = {k: get(f) for k, f in mapping.items() if k not in standard}
    return payloads.select(
        *(get(mapping[k]).alias(k) for k in standard), F.col(f"`{column}`").alias("payload_json"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("ingested_at"),
        F.lit(source_id).alias("source_id"), *(c.alias(k) for k, c in more.items()),
    )


def ingest(rows: DataFrame, root: str) -> None:
    """Appends normalised rows, partitioned by source."""
    rows.write.mode("append").partitionBy("source_id").parquet(f"{root}/events")


def read(spark: SparkSession, root: str, source_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/events")
    return df.where(F.col("source_id") == source_id) if source_id else df


def between(df: DataFrame, start: str | None = None, end: str | None = None, time_field: str = "event_time", limit: int | None = None) -> DataFrame:
    """start <= time < end by text order; limit takes the last ones."""
    t = F.col(f"`{time_field}`")
    df = df.where(t >= start) if start else df
    df = df.where(t < end) if end else df
    return df.orderBy(t.desc()).limit(limit) if limit else df
