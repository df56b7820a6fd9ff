"""The engine's entry point: readers, a table registry with kinds, the SQL dialect, search, streams and background jobs."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import vector
from .plans import parser, planner
from .plans.errors import SqlSemanticError, SqlTableKindError, SqlUnsupportedError
from .plugins import PluginManager
from .sources import files
from .streaming import query as streams
from .streaming import sql as stream_sql

_TYPES = {
    "STRING": T.StringType(), "TEXT": T.StringType(), "VARCHAR": T.StringType(), "CHAR": T.StringType(), "INT": T.LongType(), "INTEGER": T.LongType(), "BIGINT": T.LongType(), "SMALLINT": T.LongType(),
    "INT64": T.LongType(), "DOUBLE": T.DoubleType(), "NUMERIC": T.DoubleType(), "DECIMAL": T.DoubleType(), "FLOAT": T.FloatType(), "REAL": T.FloatType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
}


class Session:
    """extended: statements the dialect rejects go to Spark SQL over the same views, with Spark's semantics."""

    def __init__(self, spark: SparkSession, extended: bool = False, materialize_dir: str | None = None):
        self.spark, self.extended, self.materialize_dir = spark, extended, materialize_dir
        self.tables: dict[str, DataFrame] = {}
        self.kinds: dict[str, str] = {}
        self.sources: dict[str, streams.Source] = {}
        self.sinks: dict[str, streams.Sink] = {}
        self.plugins = PluginManager()
        self._pool = ThreadPoolExecutor(4, thread_name_prefix="job")

    # sources

    def read_csv(self, path: str, delimiter: str = ",", materialize: bool = False, cache_in_memory: bool = False) -> DataFrame:
        return self._kept(path, lambda: files.read_csv(self.spark, path, delimiter), {"format": "csv", "delimiter": delimiter}, materialize, cache_in_memory)

    def read_line_file(self, path: str, mappings, mode: str = "split", split_delimiter: str = "|", regex_pattern: str | None = None, materialize: bool = False, cache_in_memory: bool = False) -> DataFrame:
        options = {"format": "line", "mode": mode, "split": split_delimiter, "regex": regex_pattern, "mappings": list(map(list, mappings))}
        return self._kept(path, lambda: files.read_line_file(self.spark, path, mappings, mode, split_delimiter, regex_pattern), options, materialize, cache_in_memory)

    def read_json(self, path: str, columns=None, format: str = "json_lines", materialize: bool = False, cache_in_memory: bool = False) -> DataFrame:
        return self._kept(path, lambda: files.read_json(self.spark, path, columns, format), {"format": format, "columns": columns}, materialize, cache_in_memory)

    def read_excel(self, path: str, sheet_name: str | int = 0, date_format: str = "%Y-%m-%d %H:%M:%S") -> DataFrame:
        return files.read_excel(self.spark, path, sheet_name, date_format)

    def _kept(self, path, reader, options, materialize, cache) -> DataFrame:
        df = files.materialize(self.spark, path, reader, self.materialize_dir, options) if materialize and self.materialize_dir else reader()
        return df.persist() if cache else df

    def probe(self, path: str) -> dict:
        return files.probe(self.spark, path)

    def read(self, path: str) -> DataFrame:
        return files.read(self.spark, path)

    def create_dataframe(self, data, schema=None) -> DataFrame:
        return self.spark.createDataFrame(data, schema)

    def create_dataframe_from_arrow(self, data) -> DataFrame:
        return files.from_arrow(self.spark, data)

    def read_stream_csv_dir(self, path: str, schema=None, delimiter: str = ",") -> streams.Stream:
        return streams.Stream(self.spark, streams.CsvDirSource(path, delimiter, schema))

    # tables

    def create_temp_view(self, name: str, df: DataFrame) -> None:
        if self.kinds.get(name, "regular") != "regular":
            raise SqlTableKindError(f"{name} is a {self.kinds[name]} table")
        self._put(name, df)

    def _put(self, name: str, df: DataFrame) -> None:
        self.tables[name], self.kinds[name] = df, "regular"
        df.createOrReplaceTempView(f"`{name}`")

    def table(self, name: str) -> DataFrame:
        if self.kinds.get(name) == "sink":
            raise SqlTableKindError(f"SINK table cannot be used as a source: {name}")
        if name in self.sources:
            return self.sources[name].batch(self.spark)
        if name in self.tables:
            return self.tables[name]
        raise SqlSemanticError(f"table not found: {name}")

    # SQL

    def sql(self, text: str) -> DataFrame:
        text = self.plugins.run("before_parse", {"sql": text})["sql"]
        try:
            statement = parser.parse(text)
            self.plugins.run("after_parse", {"sql": text, "statement": statement})
            self.plugins.run("before_plan", {"sql": text, "statement": statement})
            if isinstance(statement, parser.Create):
                out = self._create(statement)
            elif isinstance(statement, parser.Insert):
                out = self._insert(statement)
            else:
                out = planner.Planner(self.table, self.spark).query(statement)
        except SqlUnsupportedError:
            if not self.extended:
                raise
            out = self.spark.sql(text)
        self.plugins.run("after_plan", {"sql": text, "plan": out})
        return out

    def collect(self, df: DataFrame) -> list:
        """df's rows, with the hooks around execution."""
        self.plugins.run("before_execute", {"plan": df})
        rows = df.collect()
        self.plugins.run("after_execute", {"plan": df, "rows": len(rows)})
        return rows

    def explain_sql(self, text: str) -> str:
        """The sections logical, physical and strategy of a SELECT."""
        q = parser.parse(text)
        df = planner.Planner(self.table, self.spark).query(q)
        physical = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return "\n".join(["logical", *(f"  {x}" for x in planner.steps(q)), "physical", physical.strip(), "strategy", "  mode=batch", "  optimizer=catalyst", "  adaptive=" + self.spark.conf.get("spark.sql.adaptive.enabled")])

    def _status(self, message: str, rows: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(True, message, rows)], "ok boolean, message string, affected_rows long")

    def _create(self, c: parser.Create) -> DataFrame:
        if c.name in self.kinds or c.name in self.tables:
            raise SqlSemanticError(f"table already exists: {c.name}")
        unknown = [t for _, t in c.columns if t not in _TYPES]
        if unknown:
            raise SqlUnsupportedError(f"column type {unknown[0]}")
        schema = T.StructType([T.StructField(n, _TYPES[t]) for n, t in c.columns])
        path = c.options.get("path")
        if c.kind != "regular":
            if (c.provider or "csv") != "csv" or not path:
                raise SqlUnsupportedError(f"{c.kind.upper()} TABLE needs USING csv and OPTIONS(path: ...)")
            if c.kind == "source":
                self.sources[c.name] = streams.CsvDirSource(path, c.options.get("delimiter", ","), schema if c.columns else None)
            else:
                self.sinks[c.name] = streams.FileAppendSink(path, c.options.get("delimiter", ","))
            self.kinds[c.name] = c.kind
            return self._status(f"{c.kind} table created")
        if not path:
            if c.provider:
                raise SqlSemanticError("OPTIONS(path: ...) is missing")
            self._put(c.name, self.spark.createDataFrame([], schema))
            return self._status("table created")
        df = self._external(c, path)
        if c.columns and [n for n, _ in c.columns] != df.columns:
            raise SqlSemanticError(f"declared columns do not match the file: {df.columns}")
        self._put(c.name, df)
        return self._status("table created")

    def _external(self, c: parser.Create, path: str) -> DataFrame:
        o, provider = c.options, c.provider
        if not provider:
            return self.read(path)
        if provider == "csv":
            return self.read_csv(path, o.get("delimiter", ","))
        if provider == "json":
            if o.get("format", "json_lines") not in ("json_lines", "json_array"):
                raise SqlSemanticError("CREATE TABLE option format must be json_lines or json_array")
            columns = [x.strip() for x in o["columns"].split(",")] if "columns" in o else [n for n, _ in c.columns] or None
            return self.read_json(path, columns, o.get("format", "json_lines"))
        if o.get("mode", "split") not in ("split", "regex"):
            raise SqlSemanticError("CREATE TABLE option mode must be split or regex")
        mode = o.get("mode", "split")
        if "mappings" in o:
            mappings = [(k.strip(), int(v)) for k, v in (m.split(":") for m in o["mappings"].split(","))]
        else:
            mappings = [(n, i + (mode == "regex")) for i, (n, _) in enumerate(c.columns)]
        return self.read_line_file(path, mappings, mode, o.get("split_delimiter", "|"), o.get("regex_pattern", o.get("regex")))

    def _insert(self, i: parser.Insert) -> DataFrame:
        kind = self.kinds.get(i.table)
        if kind is None:
            raise SqlSemanticError(f"table not found: {i.table}")
        if kind == "source":
            raise SqlTableKindError(f"SOURCE table is read-only: {i.table}")
        sink = self.sinks.get(i.table)
        schema = self.tables[i.table].schema if not sink else None
        if i.query is not None:
            rows = planner.Planner(self.table, self.spark).query(i.query)
            targets = i.columns or (schema.names if schema else rows.columns)
            if len(targets) != len(rows.columns):
                raise SqlSemanticError("INSERT column count mismatch")
            rows = rows.toDF(*targets)
        else:
            targets = i.columns or (schema.names if schema else [f"c{k}" for k in range(len(i.rows[0]))])
            if any(len(r) != len(targets) for r in i.rows):
                raise SqlSemanticError("INSERT column count mismatch")
            rows = self._values(i.rows, targets, schema)
        if sink:
            n = rows.count()
            sink.write(rows, -1)
            return self._status("inserted", n)
        unknown = [t for t in targets if t not in schema.names]
        if unknown:
            raise SqlSemanticError(f"INSERT column not found: {unknown[0]}")
        full = rows.select(*((F.col(f"`{f.name}`") if f.name in targets else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        self._put(i.table, self.tables[i.table].union(full))
        return self._status("inserted", len(i.rows) if i.rows else full.count())

    def _values(self, rows: list[list], targets: Sequence[str], schema: T.StructType | None) -> DataFrame:
        def shaped(v, dtype):
            return float(v) if isinstance(dtype, (T.DoubleType, T.FloatType)) and isinstance(v, int) and not isinstance(v, bool) else v

        kinds = [schema[t].dataType if schema is not None and t in schema.names else None for t in targets]
        fields = []
        for k, t in enumerate(targets):
            values = [r[k] for r in rows if r[k] is not None]
            kind = kinds[k] or (T.LongType() if values and all(type(v) is int for v in values) else T.DoubleType() if values and all(type(v) in (int, float) for v in values) else T.StringType())
            kinds[k] = kind
            fields.append(T.StructField(t, kind))
        try:
            return self.spark.createDataFrame([tuple(shaped(v, kinds[k]) for k, v in enumerate(r)) for r in rows], T.StructType(fields))
        except Exception as e:
            raise SqlSemanticError(f"INSERT value does not fit its column: {e}") from None

    # search

    def vector_search(self, table: str, column: str, query: Sequence[float], top_k: int = 10, metric: str = "cosine", id_column: str | None = None) -> DataFrame:
        return vector.vector_query(self.table(table), column, query, top_k, metric, id_column)

    def explain_vector_search(self, table: str, column: str, query: Sequence[float], top_k: int = 10, metric: str = "cosine") -> str:
        return vector.explain_vector_query(self.table(table), column, query, top_k, metric)

    # streams

    def stream_sql(self, text: str) -> streams.Stream:
        return stream_sql.plan(self, parser.parse(text))

    def start_stream_sql(self, text: str, **options) -> streams.StreamQuery:
        return stream_sql.start(self, parser.parse(text), **options)

    def explain_stream_sql(self, text: str, **options) -> str:
        return stream_sql.explain(self, parser.parse(text), **options)

    # jobs

    def submit(self, work: DataFrame | str, retries: int = 0, tag: str | None = None) -> Future:
        """Collects a query in the background; the future's result is its rows. With a tag, cancel(tag) stops it."""

        def run():
            if tag:
                self.spark.addTag(tag)
            try:
                for left in range(retries, -1, -1):
                    try:
                        return (self.sql(work) if isinstance(work, str) else work).collect()
                    except Exception:
                        if not left:
                            raise
            finally:
                if tag:
                    self.spark.removeTag(tag)

        return self._pool.submit(run)

    def cancel(self, tag: str) -> list[str]:
        return self.spark.interruptTag(tag)
