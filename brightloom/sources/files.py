"""File sources: CSV, delimited and regex lines, JSON lines and arrays, probing, materialisation, and CSV output."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .infer import infer


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", infer_types: bool = True) -> DataFrame:
    """A CSV with a header; quotes may hold delimiters and line ends. Rows with fewer cells than the header are left out."""
    options = {"header": True, "sep": delimiter, "quote": '"', "escape": '"', "multiLine": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "enforceSchema": True}
    head = spark.read.options(**options | {"inferSchema": False}).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*head.columns, "__bad"]])
    raw = spark.read.options(**options, emptyValue="").schema(schema).csv(path)
    # a row is short when it is marked malformed and its last cell is missing; longer rows are cut to the header
    last = F.col(f"`{head.columns[-1]}`") if head.columns else F.lit(None)
    kept = raw.where(F.col("__bad").isNull() | last.isNotNull()).drop("__bad")
    return infer(kept) if infer_types else kept


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def read_line_file(spark: SparkSession, path: str, mappings: Sequence[tuple[str, int]], mode: str = "split", split_delimiter: str = "|", regex_pattern: str | None = None) -> DataFrame:
    """Columns (name, index) of each line: parts between delimiters, or groups (0: all) of a regex that the whole line must match."""
    lines = _lines(spark, path)
    if mode == "split":
        parts = F.split("value", re.escape(split_delimiter), -1)
        return infer(lines.select(*(F.get(parts, F.lit(i)).alias(n) for n, i in mappings)), padded_text=False, null_words=True)
    if mode != "regex" or not regex_pattern:
        raise ValueError("line mode must be split, or regex with a regex_pattern")
    pattern = f"^(?:{regex_pattern.removeprefix('^').removesuffix('$')})$"
    match = lines.where(F.col("value").rlike(pattern))
    return infer(match.select(*(F.regexp_extract("value", pattern, i).alias(n) for n, i in mappings)), padded_text=False, null_words=True)


def read_json(spark: SparkSession, path: str, columns: Sequence[str] | None = None, format: str = "json_lines") -> DataFrame:
    """Objects, one a line or in one array. Nested objects stay JSON text, arrays of numbers are vectors, missing keys null.

    Without columns, they are the keys of the first object.
    """
    if format == "json_lines":
        objects = _lines(spark, path).select(F.col("value"))
    elif format == "json_array":
        whole = spark.read.text(path, wholetext=True)
        objects = whole.select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    else:
        raise ValueError("format must be json_lines or json_array")
    if columns is None:
        first = objects.first()
        columns = list(json.loads(first["value"])) if first else []
    fields = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    raw = objects.select(fields.alias("o")).select(*(F.try_element_at("o", F.lit(c)).alias(c) for c in columns))
    typed = infer(raw, padded_text=False)
    bad = [F.count_if(F.col(f"`{c}`").startswith("[")).alias(c) for c, k in typed.dtypes if k == "string"]
    if bad and any(v for v in typed.agg(*bad).first()):
        raise ValueError("JSON arrays must be numeric")
    return typed


def probe(spark: SparkSession, path: str) -> dict:
    """The likely format of a file, from its extension and first four lines: kind, format, score, confidence, schema, delimiter, candidates, warnings."""
    lines = [r["value"] for r in spark.read.text(path).where(F.trim("value") != "").limit(4).collect()]
    if not lines:
        raise ValueError(f"cannot probe an empty file: {path}")
    name, found, warnings = path.lower(), [], []
    first = lines[0].strip()

    def offer(kind: str, format_: str, score: int, schema: list[str], delimiter: str = "") -> None:
        found.append({"kind": kind, "format": format_, "score": score, "schema": schema, "delimiter": delimiter})

    if first.startswith("["):
        try:
            objects = json.loads("\n".join(lines) if first.endswith("]") else first[: first.rindex("}") + 1] + "]")
            offer("json", "json_array", 90 + 10 * name.endswith(".json"), list(objects[0]) if objects and isinstance(objects[0], dict) else [])
        except ValueError:
            offer("json", "json_array", 60 + 20 * name.endswith(".json"), [])
    if first.startswith("{"):
        good = 0
        for x in lines:
            try:
                good += isinstance(json.loads(x), dict)
            except ValueError:
                warnings.append("a sample line is not a JSON object")
        if good:
            offer("json", "json_lines", 60 + 35 * good // len(lines) + 5 * name.endswith((".jsonl", ".json", ".ndjson")), list(json.loads(first)) if good == len(lines) else [])
    for d in (",", "\t", ";"):
        width = {_cells(x, d) for x in lines}
        if len(width) == 1 and (n := width.pop()) > 1:
            head = [c.strip().strip('"') for c in first.split(d)]
            named = all(re.match(r"^[^\d\W]\w*$", c) for c in head)
            offer("csv", "csv", 50 + 20 * named + min(10, n) + 15 * name.endswith((".csv", ".tsv")), head, d)
    for d in ("|", " ", ":"):
        width = {len(x.split(d)) for x in lines}
        if len(width) == 1 and (n := width.pop()) > 1:
            offer("line", "line_split", 45 + 20 * (d == "|") + min(5, n), [f"c{i}" for i in range(n)], d)
    if not found and name.endswith(".csv"):
        offer("csv", "csv", 50, [c.strip() for c in first.split(",")], ",")
    if not found:
        offer("line", "line_split", 10, ["c0"], "|")
        warnings.append("no format fits well")
    found.sort(key=lambda f: -f["score"])
    gap = found[0]["score"] - (found[1]["score"] if len(found) > 1 else 0)
    return found[0] | {"confidence": "high" if found[0]["score"] >= 80 and gap >= 10 else "medium" if found[0]["score"] >= 55 else "low", "candidates": found, "warnings": warnings}


def _cells(line: str, delimiter: str) -> int:
    return len(re.sub(r'"(?:[^"]|"")*"', "", line).split(delimiter))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The file read as probe() finds it."""
    p = probe(spark, path)
    if p["kind"] == "csv":
        return read_csv(spark, path, p["delimiter"])
    if p["kind"] == "json":
        return read_json(spark, path, p["schema"] or None, p["format"])
    return read_line_file(spark, path, [(c, i) for i, c in enumerate(p["schema"])], "split", p["delimiter"])


def materialize(spark: SparkSession, path: str, reader, root: str, options: dict | None = None) -> DataFrame:
    """reader()'s rows as Parquet under root, keyed by options and the file's path, size and time; read back if already there."""
    real = os.path.abspath(path.removeprefix("file://"))
    stat = os.stat(real)
    key = hashlib.sha256(json.dumps([options or {}, real, stat.st_size, stat.st_mtime_ns], sort_keys=True).encode()).hexdigest()
    out = f"{root.rstrip('/')}/{key}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        reader().write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def save_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV part files with headers. Vectors are written as [1 2 3]."""
    vectors = {c: F.concat(F.lit("["), F.array_join(F.col(f"`{c}`"), " "), F.lit("]")) for c, k in df.dtypes if k.startswith("array")}
    df.withColumns(vectors).write.mode("overwrite").option("header", True).csv(path)


def read_excel(spark: SparkSession, path: str, sheet_name: str | int = 0, date_format: str = "%Y-%m-%d %H:%M:%S") -> DataFrame:
    """A sheet through pandas on the driver (a workbook is one small file); dates become text."""
    import pandas as pd

    sheet = pd.read_excel(path, sheet_name=sheet_name)
    for c in sheet.columns:
        if pd.api.types.is_datetime64_any_dtype(sheet[c]):
            sheet[c] = sheet[c].dt.strftime(date_format)
    sheet.columns = [str(c) for c in sheet.columns]
    return spark.createDataFrame(sheet)


def from_arrow(spark: SparkSession, data) -> DataFrame:
    """A pyarrow table, record batch or reader, or anything with __arrow_c_stream__."""
    import pyarrow as pa

    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    elif isinstance(data, pa.RecordBatchReader):
        data = data.read_all()
    elif not isinstance(data, pa.Table):
        data = pa.RecordBatchReader.from_stream(data).read_all()
    fixed = {i: pa.list_(f.type.value_type) for i, f in enumerate(data.schema) if pa.types.is_fixed_size_list(f.type)}
    for i, kind in fixed.items():
        data = data.set_column(i, data.schema.field(i).name, data.column(i).cast(kind))
    return spark.createDataFrame(data)


def group_rows_by_field(df: DataFrame, field: str, kind: str = "string") -> DataFrame:
    """field's key, rows (JSON) and count. A list counts by its first item, an object by its name, else by its JSON."""
    raw = F.col(f"`{field}`").cast("string")
    item = F.when(raw.startswith("["), F.get_json_object(raw, "$[0]")).otherwise(raw)
    key = F.when(item.startswith("{"), F.coalesce(F.get_json_object(item, "$.name"), item)).otherwise(item)
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    return df.groupBy(key.alias("key")).agg(F.collect_list(row).alias("rows"), F.count(F.lit(1)).alias("count"))


def group_rows_count_by_field(df: DataFrame, field: str) -> DataFrame:
    return group_rows_by_field(df, field).select("key", "count")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Names made of letters, digits and underscores, unique, not starting with a digit."""
    names: list[str] = []
    for c in df.columns:
        n = re.sub(r"\W+", "_", c.strip()).strip("_").lower() or "column"
        n = f"c_{n}" if n[0].isdigit() else n
        base, k = n, 2
        while n in names:
            n, k = f"{base}_{k}", k + 1
        names.append(n)
    return df.toDF(*names)
