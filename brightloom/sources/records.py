"""Paged record tables (a REST service's list endpoint) as a Spark data source: a partition for each page range."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def iter_record_pages(fetch: Callable[[str | None], dict], limit: int | None = None) -> Iterator[list[dict]]:
    """Pages of records from fetch(page_token) -> {"items": [...], "has_more": bool, "page_token": str}."""
    token, seen = None, 0
    while True:
        page = fetch(token)
        items = page.get("items", [])
        if limit is not None:
            items = items[: limit - seen]
        seen += len(items)
        if items:
            yield items
        if not page.get("has_more") or (limit is not None and seen >= limit):
            return
        token = page.get("page_token")


def list_records(spark: SparkSession, fetch: Callable[[str | None], dict], path: str, limit: int | None = None) -> DataFrame:
    """The records as a table: each page is appended under path as it comes, so the driver holds one page at a time."""
    flat = lambda v: v if isinstance(v, (str, int, float, bool)) or v is None else json.dumps(v, ensure_ascii=False)
    for i, page in enumerate(iter_record_pages(fetch, limit)):
        lines = [(json.dumps({k: flat(v) for k, v in (r.get("fields", r)).items()}, ensure_ascii=False),) for r in page]
        spark.createDataFrame(lines, "value string").write.mode("append" if i else "overwrite").text(path)
    return spark.read.json(path)
