"""Streams over Structured Streaming: sources, sinks, per-batch and running operators, progress and delivery modes.

Row-wise operators and running aggregates are part of the streaming plan; what the engine defines per micro-batch (order,
limit, aggregates without state, HAVING after running ones) runs on each batch's rows before the sink.
"""

from __future__ import annotations

import json
import os
import queue
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregates
from ..functions.coerce import time_ms, time_text
from ..operators import relational as rel
from ..sources import files

DELIVERY = ("at-least-once", "best-effort")
BACKENDS = {
    "memory": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider", "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
MODES = ("single-process", "local-workers", "auto")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; without that, on a local master, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="brightloom-stream-")
    path = os.path.join("/" + root.removeprefix("file:").lstrip("/"), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


class Source:
    """A stream's input. bounded: it ends."""

    bounded = True

    def stream(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def batch(self, spark: SparkSession) -> DataFrame:
        """Everything there is now, as a table."""
        raise NotImplementedError


class _Spool(Source):
    """Folders of Parquet files, one a batch, in the order of the files' times. Executors write them; no row passes through the driver.

    The stream takes a number of files a trigger, so every batch has as many: what its rows don't fill is padded with empty ones.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, files: int = 1):
        self.spark, self.schema, self.files, self.count = spark, schema, files, 0
        self.path = shared_folder(spark, "spool")

    def add(self, df: DataFrame) -> None:
        hidden = os.path.join(self.path, f"_{self.count:08d}")
        self._stage(df.coalesce(self.files), hidden)
        self._publish(hidden)

    @staticmethod
    def _stage(df: DataFrame, hidden: str) -> None:
        df.write.option("maxRecordsPerFile", 0).parquet(hidden)

    @staticmethod
    def _staged(hidden: str) -> list[str]:
        return sorted(f for f in os.listdir(hidden) if f.endswith(".parquet") and f[0] not in "._")

    def _publish(self, hidden: str) -> None:
        """Shows a staged batch to streams: all its files at once, by the folder's new name."""
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        for i in range(self.files - len(self._staged(hidden))):
            pq.write_table(to_arrow_schema(self.schema).empty_table(), os.path.join(hidden, f"pad-{i:05d}.parquet"))
        at = 1_000_000_000 + self.count
        for f in self._staged(hidden):
            os.utime(os.path.join(hidden, f), (at, at))
        os.replace(hidden, os.path.join(self.path, f"batch-{self.count:08d}"))
        self.count += 1

    def stream(self, spark: SparkSession) -> DataFrame:
        return spark.readStream.schema(self.schema).options(maxFilesPerTrigger=self.files, recursiveFileLookup=True).parquet(self.path)

    def batch(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)


class MemorySource(_Spool):
    """A bounded list of batches: DataFrames of one schema. A batch has as many files as the one of most, at most one a core."""

    def __init__(self, spark: SparkSession, batches: Sequence[DataFrame]):
        super().__init__(spark, batches[0].schema)
        hidden = [os.path.join(self.path, f"_{i:08d}") for i in range(len(batches))]
        for b, h in zip(batches, hidden, strict=True):
            self._stage(b.coalesce(max(1, spark.sparkContext.defaultParallelism)), h)
        self.files = max(len(self._staged(h)) for h in hidden)
        for h in hidden:
            self._publish(h)


class QueueSource(_Spool):
    """Batches pushed while the stream runs; bounded once closed. files: how many a batch has, and so how many tasks write one."""

    bounded = False

    def __init__(self, spark: SparkSession, schema, files: int = 1):
        super().__init__(spark, schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema, files)

    def push_rows(self, rows: Sequence) -> None:
        self.push(self.spark.createDataFrame(list(rows), self.schema))

    def push_arrow(self, data) -> None:
        self.push(files.from_arrow(self.spark, data))

    def push(self, df: DataFrame) -> None:
        """A DataFrame's rows as one batch, written by executors; push_rows and push_arrow are for what is on the driver already."""
        if self.bounded:
            raise RuntimeError("source is closed")
        if df.dtypes != self.spark.createDataFrame([], self.schema).dtypes:
            raise ValueError("batch schema does not match the source")
        self.add(df)

    def close(self) -> None:
        self.bounded = True


class BufferedSource(QueueSource):
    """Collects rows and emits a batch when there are emit_rows of them or emit_interval_seconds have passed."""

    def __init__(self, spark: SparkSession, schema, emit_interval_seconds: float = 1.0, emit_rows: int = 1024, clock: Callable[[], float] = time.monotonic):
        super().__init__(spark, schema)
        self.every, self.rows, self.clock = emit_interval_seconds, emit_rows, clock
        self.held: list = []
        self.since = clock()

    def write(self, row) -> None:
        self.held.append(row)
        if len(self.held) >= self.rows or self.clock() - self.since >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.push_rows(self.held)
        self.held, self.since = [], self.clock()

    def close(self) -> None:
        self.flush()
        super().close()


class CsvDirSource(Source):
    """A folder of CSV files, one a batch, in the order in which they were written (file times). Unbounded."""

    bounded = False

    def __init__(self, path: str, delimiter: str = ",", schema=None):
        self.path, self.delimiter, self.declared = path, delimiter, schema

    def schema(self, spark: SparkSession) -> T.StructType:
        if self.declared is None:
            first = sorted(f for f in os.listdir(self.path.removeprefix("file://")) if f.endswith(".csv"))
            if not first:
                raise ValueError(f"no CSV file to take the columns from in {self.path}")
            self.declared = files.read_csv(spark, os.path.join(self.path, first[0]), self.delimiter).schema
        return self.declared if isinstance(self.declared, T.StructType) else spark.createDataFrame([], self.declared).schema

    def stream(self, spark: SparkSession) -> DataFrame:
        return spark.readStream.schema(self.schema(spark)).options(header=True, sep=self.delimiter, maxFilesPerTrigger=1, pathGlobFilter="*.csv").csv(self.path)

    def batch(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema(spark)).options(header=True, sep=self.delimiter, pathGlobFilter="*.csv").csv(self.path)


class Sink:
    def write(self, df: DataFrame, batch: int) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class ConsoleSink(Sink):
    def write(self, df: DataFrame, batch: int) -> None:
        print(f"batch {batch}")
        df.show(truncate=False)


class FileAppendSink(Sink):
    """One CSV file on the driver that grows with each batch; the header is written to an empty file only.

    Executors write a batch's lines to a shared folder, and the driver appends those files' bytes in order.
    """

    def __init__(self, path: str, delimiter: str = ","):
        self.path, self.delimiter = path.removeprefix("file://"), delimiter

    def _lines(self, df: DataFrame) -> DataFrame:
        """Values as Python's str gives them, nulls empty."""
        sep, plain = self.delimiter, (T.StringType, T.IntegralType)
        if all(isinstance(f.dataType, (*plain, T.BooleanType)) for f in df.schema):
            columns = [F.col(c) for c in (f"c{i}" for i in range(len(df.columns)))]
            shown = [F.initcap(c.cast("string")) if isinstance(f.dataType, T.BooleanType) else c.cast("string") for c, f in zip(columns, df.schema, strict=True)]
            return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(F.concat_ws(sep, *(F.coalesce(c, F.lit("")) for c in shown)).alias("value"))
        return df.sparkSession.createDataFrame(df.rdd.map(lambda row: (sep.join("" if v is None else str(v) for v in row),)), "value string")

    def write(self, df: DataFrame, batch: int) -> None:
        stage = os.path.join(shared_folder(df.sparkSession, "append"), "lines")
        self._lines(df).write.options(compression="none", maxRecordsPerFile=0).text(stage)
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self.path, "ab") as f:
            if not f.tell():
                f.write((self.delimiter.join(df.columns) + "\n").encode())
            for part in sorted(p for p in os.listdir(stage) if p.startswith("part-")):
                with open(os.path.join(stage, part), "rb") as lines:
                    shutil.copyfileobj(lines, f, 1 << 20)
        shutil.rmtree(os.path.dirname(stage))


class MemorySink(Sink):
    """The last batch's rows, all batches' rows, and counters. A batch stays in Parquet files that executors write; its rows come
    to the driver only if last or all is asked for, and frame() gives them as a table."""

    def __init__(self) -> None:
        self.batches, self.schemas, self.spark, self.root = 0, [], None, None

    def write(self, df: DataFrame, batch: int) -> None:
        self.spark, self.root = df.sparkSession, self.root or shared_folder(df.sparkSession, "memory")
        kept = T.StructType([T.StructField(f"c{i}", T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType) for i, f in enumerate(df.schema)])
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) if isinstance(g.dataType, T.NullType) else F.col(f.name) for f, g in zip(kept, df.schema, strict=True)]
        df.toDF(*kept.names).select(*cast).write.mode("overwrite").parquet(f"{self.root}/{self.batches}")
        self.schemas.append((kept, df.columns))
        self.batches += 1

    def _read(self, i: int) -> DataFrame:
        return self.spark.read.schema(self.schemas[i][0]).parquet(f"{self.root}/{i}")

    def _rows(self, i: int) -> list:
        return self._read(i).orderBy("_metadata.file_name", "_metadata.row_index").toDF(*self.schemas[i][1]).collect()

    @property
    def last(self) -> list:
        return self._rows(self.batches - 1) if self.batches else []

    @property
    def all(self) -> list[list]:
        return [self._rows(i) for i in range(self.batches)]

    @property
    def rows(self) -> int:
        return sum(self._read(i).count() for i in range(self.batches))

    def frame(self, number: str | None = None) -> DataFrame:
        """All batches' rows; number: a column more, the batch's place from 0."""
        out = None
        for i in range(self.batches):
            one = self._read(i).toDF(*self.schemas[i][1])
            one = one.withColumn(number, F.lit(i).cast("long")) if number else one
            out = one if out is None else out.union(one)
        if out is None:
            raise ValueError("no batch was written")
        return out


class QueueSink(Sink):
    """Batches as Arrow tables, to be polled."""

    def __init__(self) -> None:
        self.queue, self.closed = queue.Queue(), False

    def write(self, df: DataFrame, batch: int) -> None:
        self.queue.put(df.toArrow())

    def poll_arrow(self, timeout: float = 0.0):
        try:
            return self.queue.get(timeout=timeout) if timeout else self.queue.get_nowait()
        except queue.Empty:
            return None

    def close(self) -> None:
        self.closed = True


class CallbackSink(Sink):
    """Calls on_emit with an Arrow table of at least emit_rows rows, or of what came within emit_interval_seconds."""

    def __init__(self, on_emit: Callable, emit_interval_seconds: float = 0.0, emit_rows: int = 1, clock: Callable[[], float] = time.monotonic):
        self.on_emit, self.every, self.rows, self.clock = on_emit, emit_interval_seconds, emit_rows, clock
        self.held, self.since = [], clock()

    def write(self, df: DataFrame, batch: int) -> None:
        self.held.append(df.toArrow())
        if sum(t.num_rows for t in self.held) >= self.rows or (self.every and self.clock() - self.since >= self.every):
            self.flush()

    def flush(self) -> None:
        import pyarrow as pa

        if self.held:
            self.on_emit(pa.concat_tables(self.held))
        self.held, self.since = [], self.clock()

    def close(self) -> None:
        self.flush()


class Stream:
    """A stream and what is done to it. Methods return new streams."""

    def __init__(self, spark: SparkSession, source: Source, rowwise=(), running=None, per_batch=(), window: str | None = None):
        self.spark, self.source, self.rowwise, self.running, self.per_batch, self.window_column = spark, source, tuple(rowwise), running, tuple(per_batch), window

    def _with(self, f: Callable[[DataFrame], DataFrame], per_batch: bool = False, window: str | None = None) -> Stream:
        late = per_batch or self.running is not None or self.per_batch
        more = {"per_batch": (*self.per_batch, f)} if late else {"rowwise": (*self.rowwise, f)}
        return Stream(**{"spark": self.spark, "source": self.source, "rowwise": self.rowwise, "running": self.running, "per_batch": self.per_batch, "window": window or self.window_column} | more)

    def select(self, names: Sequence[str], aliases: Sequence[str] | None = None) -> Stream:
        return self._with(lambda df: rel.select(df, names, aliases))

    def filter(self, name: str, op: str, value) -> Stream:
        return self._with(lambda df: rel.filter_(df, name, op, value))

    def where(self, tree) -> Stream:
        return self._with(lambda df: rel.where(df, tree))

    def with_column(self, name: str, source: str | None = None, *, function: str | None = None, args: Sequence = ()) -> Stream:
        return self._with(lambda df: rel.with_column(df, name, source, function=function, args=args))

    def drop(self, name: str) -> Stream:
        return self._with(lambda df: rel.drop(df, name))

    def transform(self, f: Callable[[DataFrame], DataFrame], per_batch: bool = False) -> Stream:
        return self._with(f, per_batch)

    def with_state(self, keys: Sequence[str], f: Callable, schema: str, state_schema: str) -> Stream:
        """f(key, batches of a group's rows in pandas, state) yields pandas rows of schema; state lives on between batches.

        The state is Spark's GroupState over state_schema: exists, get, update(tuple), remove().
        """

        def apply(df: DataFrame) -> DataFrame:
            return df.groupBy(*keys).applyInPandasWithState(f, schema, state_schema, "append", "NoTimeout")

        return self._with(apply)

    def limit(self, n: int) -> Stream:
        """Of each micro-batch."""
        return self._with(lambda df: df.limit(n), per_batch=True)

    def order_by(self, names: Sequence[str], ascending: Sequence[bool] | None = None) -> Stream:
        """Of each micro-batch; a source without end has no order."""
        if not self.source.bounded:
            raise ValueError("ORDER BY is not supported on unbounded stream sources")
        return self._with(lambda df: rel.order_by(df, names, ascending), per_batch=True)

    def window(self, time_col: str, window_ms: int, out: str = "window_start", slide_ms: int = 0) -> Stream:
        return self._with(lambda df: rel.window_start(df, time_col, window_ms, out, slide_ms, as_text=True), window=out)

    def group_by(self, keys: Sequence[str]) -> GroupedStream:
        return GroupedStream(self, list(keys))

    def frame(self) -> DataFrame:
        """The streaming plan up to what runs per batch."""
        df = self.source.stream(self.spark)
        for f in self.rowwise:
            df = f(df)
        return aggregates.aggregate(df, self.running[0], self.running[1]) if self.running and not self.running[2] else df

    def start(self, sink: Sink, **options) -> StreamQuery:
        return StreamQuery(self, sink, **options)


class GroupedStream:
    def __init__(self, stream: Stream, keys: list[str]):
        self.stream, self.keys = stream, keys

    def agg(self, specs: Sequence[tuple[str, str | None, str]], stateful: bool = False, max_retained_windows: int = 0) -> Stream:
        """specs: (aggregate, column, alias). With state, each batch emits the groups it touched, with their running values.

        max_retained_windows keeps the state of so many windows, those first seen last; a later row of another starts anew.
        """
        s, keys, specs = self.stream, self.keys, list(specs)
        if not stateful:
            return s._with(lambda df: aggregates.aggregate(df, keys, specs), per_batch=True)
        if s.running or s.per_batch:
            raise ValueError("a running aggregate cannot follow per-batch operators")
        return Stream(s.spark, s.source, s.rowwise, (keys, specs, max_retained_windows), (), s.window_column)

    def sum(self, column: str, out: str | None = None, **kw) -> Stream:
        return self.agg([("SUM", column, out or f"sum_{column}")], **kw)

    def count(self, out: str = "count", **kw) -> Stream:
        return self.agg([("COUNT", None, out)], **kw)

    def min(self, column: str, out: str | None = None, **kw) -> Stream:
        return self.agg([("MIN", column, out or f"min_{column}")], **kw)

    def max(self, column: str, out: str | None = None, **kw) -> Stream:
        return self.agg([("MAX", column, out or f"max_{column}")], **kw)

    def avg(self, column: str, out: str | None = None, **kw) -> Stream:
        return self.agg([("AVG", column, out or f"avg_{column}")], **kw)


class RetainedState:
    """Running aggregates whose state is a table per batch, so that windows can be evicted by number.

    Sums, counts and extremes merge; averages are a sum and a count. A table is written under the batch's number, so a
    batch that runs again starts from the same state. The tables of the last two batches are kept.
    """

    def __init__(self, path: str, keys: list[str], specs: list[tuple], keep: int, window: str | None):
        self.path, self.keys, self.specs, self.keep = path, keys, specs, keep
        self.window = window if window in keys else next((k for k in keys if "window" in k), None)
        self.held: DataFrame | None = None

    def _state(self, spark: SparkSession, batch: int) -> DataFrame | None:
        at = f"{self.path}/{batch}"
        return spark.read.parquet(at) if batch >= 0 and os.path.exists(f"{at}/_SUCCESS") else None

    def update(self, df: DataFrame, batch: int) -> DataFrame:
        parts, finals = [], []
        for i, (name, column, alias) in enumerate(self.specs):
            c = F.col(f"`{column}`") if column else None
            total = F.sum(F.coalesce(c.cast("double"), F.lit(0.0))) if name in ("SUM", "AVG") else None
            parts += [(f"s{i}", total, F.sum)] if total is not None else []
            parts += [(f"n{i}", F.count(F.lit(1)) if name == "COUNT" else F.count(c), F.sum)] if name in ("COUNT", "AVG") else []
            parts += [(f"m{i}", (F.min if name == "MIN" else F.max)(c), F.min if name == "MIN" else F.max)] if name in ("MIN", "MAX") else []
            out = {"SUM": F.col(f"s{i}"), "COUNT": F.col(f"n{i}"), "MIN": F.col(f"m{i}"), "MAX": F.col(f"m{i}")}.get(name)
            finals.append((F.coalesce(F.col(f"s{i}") / F.nullif(F.col(f"n{i}"), F.lit(0)), F.lit(0.0)) if out is None else out).alias(alias))
        now = df.groupBy(*self.keys).agg(*(p.alias(n) for n, p, _ in parts)).withColumns({"seen": F.lit(batch).cast("long"), "touched": F.lit(True)})
        before = self._state(df.sparkSession, batch - 1)
        merged = now if before is None else now.unionByName(before.withColumn("touched", F.lit(False)))
        merged = merged.groupBy(*self.keys).agg(*(m(n).alias(n) for n, _, m in parts), F.min("seen").alias("seen"), F.max("touched").alias("touched"))
        if self.keep and self.window:  # as many windows as are kept, so the list is short
            windows = merged.groupBy(self.window).agg(F.min("seen").alias("first")).orderBy(F.col("first").desc(), F.col(self.window).desc()).limit(self.keep)
            kept = merged.join(F.broadcast(windows.select(self.window)), self.window, "left_semi")
        else:
            kept = merged
        if self.held is not None:  # the last batch's sink is done with it
            self.held.unpersist()
        self.held = merged.persist()
        kept.drop("touched").write.mode("overwrite").parquet(f"{self.path}/{batch}")
        old = f"{self.path}/{batch - 2}"
        if os.path.isdir(old):
            shutil.rmtree(old)
        return merged.where("touched").select(*self.keys, *finals)


PROGRESS = {
    "query_id": "", "status": "created", "requested_execution_mode": "auto", "execution_mode": "spark", "execution_reason": "", "transport_mode": "spark-shuffle", "batches_pulled": 0,
    "batches_processed": 0, "blocked_count": 0, "max_backlog_batches": 0, "inflight_batches": 0, "inflight_partitions": 0, "last_batch_latency_ms": 0, "last_sink_latency_ms": 0,
    "last_state_latency_ms": 0, "last_source_offset": "", "backpressure_active": False, "actor_eligible": False, "used_actor_runtime": False, "used_shared_memory": False, "has_stateful_ops": False,
    "has_window": False, "sink_is_blocking": True, "source_is_bounded": True, "estimated_partitions": 0, "projected_payload_bytes": 0, "sampled_batches": 0, "sampled_rows_per_batch": 0,
    "average_projected_payload_bytes": 0, "actor_speedup": 0.0, "compute_to_overhead_ratio": 0.0, "estimated_state_size_bytes": 0, "estimated_batch_cost": 0, "backpressure_max_queue_batches": 0,
    "backpressure_high_watermark": 0, "backpressure_low_watermark": 0, "checkpoint_delivery_mode": "at-least-once",
}


class _Enough(Exception):
    pass


class StreamQuery:
    """A running stream. at-least-once replays the source from its start at every start; best-effort goes on where the last run
    ended, state included. max_inflight_batches is one file a trigger here: batches never queue in the engine."""

    def __init__(self, stream: Stream, sink: Sink, checkpoint: str | None = None, delivery: str = "at-least-once", trigger_interval_ms: int = 0, execution_mode: str = "auto", max_inflight_batches: int = 1, plugins=None, state_backend: str | None = None):
        if state_backend is not None:
            if state_backend not in BACKENDS:
                raise ValueError(f"unknown state backend: {state_backend}")
            stream.spark.conf.set("spark.sql.streaming.stateStore.providerClass", BACKENDS[state_backend])
        if delivery not in DELIVERY:
            raise ValueError(f"unknown delivery mode: {delivery}")
        if execution_mode not in MODES:
            raise ValueError(f"unknown execution mode: {execution_mode}")
        self.stream, self.sink, self.delivery, self.interval, self.plugins = stream, sink, delivery, trigger_interval_ms, plugins
        self.checkpoint = checkpoint.removeprefix("file://") if checkpoint else shared_folder(stream.spark, "checkpoint")
        os.makedirs(self.checkpoint, exist_ok=True)
        self.counters = os.path.join(self.checkpoint, "progress.json")
        self.run = f"{self.checkpoint}/spark" if delivery == "best-effort" else f"{self.checkpoint}/run-{uuid.uuid4().hex}"
        self.facts = dict(PROGRESS) | {
            "query_id": uuid.uuid4().hex, "requested_execution_mode": execution_mode, "execution_reason": "every mode runs as Spark tasks", "checkpoint_delivery_mode": delivery,
            "has_stateful_ops": stream.running is not None, "has_window": stream.window_column is not None, "source_is_bounded": stream.source.bounded,
            "backpressure_max_queue_batches": max_inflight_batches, "backpressure_high_watermark": max_inflight_batches, "backpressure_low_watermark": max(0, max_inflight_batches - 1),
        }
        if os.path.exists(self.counters):
            with open(self.counters) as f:
                self.facts |= {k: v for k, v in json.load(f).items() if k in ("batches_pulled", "batches_processed")}
        self.query, self.done, self.most = None, 0, None

    def _batch(self, df: DataFrame, batch: int) -> None:
        if self.most is not None and self.done >= self.most:
            raise _Enough
        began = time.time()
        if self.plugins:
            self.plugins.run("stream_batch_start", {"batch": batch})
        running = self.stream.running
        if running and running[2]:
            df = RetainedState(f"{self.run}-state", running[0], running[1], running[2], self.stream.window_column).update(df, batch)
        for f in self.stream.per_batch:
            df = f(df)
        at = time.time()
        self.sink.write(df, batch)
        self.done += 1
        self.facts["batches_pulled"] += 1
        self.facts["batches_processed"] += 1
        self.facts |= {"last_sink_latency_ms": int((time.time() - at) * 1000), "last_batch_latency_ms": int((time.time() - began) * 1000), "last_source_offset": str(batch)}
        hidden = f"{self.counters}.{uuid.uuid4().hex}"
        with open(hidden, "w") as f:
            json.dump(self.facts, f)
        os.replace(hidden, self.counters)
        if self.plugins:
            self.plugins.run("stream_batch_end", {"batch": batch})

    def start(self) -> StreamQuery:
        df = self.stream.frame()
        mode = "update" if self.stream.running and not self.stream.running[2] else "append"
        writer = df.writeStream.outputMode(mode).option("checkpointLocation", self.run).foreachBatch(self._batch)
        writer = writer.trigger(processingTime=f"{self.interval} milliseconds") if self.interval else writer.trigger(availableNow=True)
        self.facts["status"] = "running"
        self.query = writer.start()
        return self

    def await_termination(self, max_batches: int | None = None, timeout: float | None = None) -> int:
        """Runs until the source is used up (or max_batches are done, or the time is over); the batches of this run."""
        self.most = max_batches
        if self.query is None:
            self.start()
        try:
            self.query.awaitTermination(timeout)
        except Exception:
            if self.most is None or self.done < self.most:
                self.facts["status"] = "failed"
                raise
        self.facts["status"] = "finished" if not self.query.isActive else self.facts["status"]
        if not self.query.isActive:
            self.sink.close()
        return self.done

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
        self.facts["status"] = "stopped"
        self.sink.close()

    def progress(self) -> dict:
        last = self.query.lastProgress if self.query is not None else None
        if last:
            state = last.get("stateOperators") or []
            self.facts["estimated_state_size_bytes"] = sum(s.get("memoryUsedBytes", 0) for s in state)
            self.facts["last_state_latency_ms"] = sum(s.get("commitTimeMs", 0) for s in state)
            self.facts["sampled_rows_per_batch"] = last.get("numInputRows", 0)
        return dict(self.facts)

    def snapshot_json(self) -> str:
        return json.dumps(self.progress())


def window_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, time_text(time_ms(F.col(f"`{column}`"), df.schema[column].dataType)))
