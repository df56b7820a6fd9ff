"""Running monitors: a rule's SQL over snapshots or a time window, its condition, signals, and promotion to focus events."""

from __future__ import annotations

import json
import os
import secrets
import shutil
import sqlite3
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..streaming.query import shared_folder
from . import dsl

_FOUND = ("row", "severity", "title", "summary", "dedupe")


class Store:
    """Monitors' state and focus events, on the driver, in SQLite (a path, :memory:, or "" for a temporary file)."""

    def __init__(self, path: str = ":memory:"):
        self.db = sqlite3.connect(path, check_same_thread=False)
        self.db.executescript(
            "CREATE TABLE IF NOT EXISTS rules(id TEXT PRIMARY KEY, spec TEXT, state TEXT);"
            "CREATE TABLE IF NOT EXISTS signals(id TEXT PRIMARY KEY, rule TEXT, at REAL, row TEXT);"
            "CREATE TABLE IF NOT EXISTS focus(id TEXT PRIMARY KEY, rule TEXT, at REAL, severity TEXT, title TEXT, summary TEXT, dedupe TEXT, row TEXT, status TEXT);"
            "CREATE INDEX IF NOT EXISTS focus_by_rule ON focus(rule, at, id);"
            "CREATE TABLE IF NOT EXISTS cursors(consumer TEXT PRIMARY KEY, at REAL, id TEXT);"
        )

    def save_rule(self, spec: dict) -> str:
        rule = spec.get("id") or uuid.uuid4().hex
        self.db.execute("INSERT INTO rules VALUES (?, ?, '{}') ON CONFLICT(id) DO UPDATE SET spec = excluded.spec", (rule, json.dumps(spec)))
        return rule

    def rule(self, rule: str) -> tuple[dict, dict]:
        row = self.db.execute("SELECT spec, state FROM rules WHERE id = ?", (rule,)).fetchone()
        if row is None:
            raise KeyError(f"unknown rule: {rule}")
        return json.loads(row[0]), json.loads(row[1])

    def save_state(self, rule: str, state: dict) -> None:
        self.db.execute("UPDATE rules SET state = ? WHERE id = ?", (json.dumps(state), rule))

    def add_signal(self, rule: str, at: float, row: dict) -> str:
        signal = uuid.uuid4().hex
        self.db.execute("INSERT INTO signals VALUES (?, ?, ?, ?)", (signal, rule, at, json.dumps(row, default=str)))
        return signal

    def add_focus(self, rule: str, at: float, severity: str, title: str, summary: str, dedupe: str, row: dict) -> str:
        focus = uuid.uuid4().hex
        self.db.execute("INSERT INTO focus VALUES (?, ?, ?, ?, ?, ?, ?, ?, 'new')", (focus, rule, at, severity, title, summary, dedupe, json.dumps(row, default=str)))
        return focus

    def add_found(self, rule: str, at: float, found: list[tuple], focus: bool) -> None:
        """Signals, and focus events if wanted, of many rows (row as JSON, severity, title, summary, dedupe). Ids rise, so that tables and index grow at their ends."""
        run = f"{time.time_ns():016x}{secrets.token_hex(4)}"
        ids = [f"{run}{i:08x}" for i in range(len(found))]
        self.db.executemany("INSERT INTO signals VALUES (?, ?, ?, ?)", ((i, rule, at, f[0]) for i, f in zip(ids, found, strict=True)))
        if focus:
            self.db.executemany("INSERT INTO focus VALUES (?, ?, ?, ?, ?, ?, ?, ?, 'new')", ((i, rule, at, *f[1:], f[0]) for i, f in zip(ids, found, strict=True)))

    def focus_frame(self, spark: SparkSession) -> DataFrame:
        """All focus events as a table; the driver holds some thousands at a time."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        names = ("id", "rule", "at", "severity", "title", "summary", "dedupe", "row", "status")
        schema = pa.schema([(n, pa.float64() if n == "at" else pa.string()) for n in names])
        path, rows = f"{shared_folder(spark, 'focus')}/focus.parquet", self.db.execute(f"SELECT {', '.join(names)} FROM focus")
        with pq.ParquetWriter(path, schema) as out:
            while some := rows.fetchmany(50_000):
                out.write_table(pa.table(list(zip(*some, strict=True)), schema=schema))
        return spark.read.parquet(path)

    def focus_events(self, status: str | None = None, limit: int = 50) -> list[dict]:
        return self._focus("WHERE status = ? OR ? IS NULL ORDER BY at DESC, id DESC LIMIT ?", (status, status, limit))

    def poll(self, consumer: str, limit: int = 50) -> list[dict]:
        """What came after the consumer's cursor, oldest first; moves the cursor behind it."""
        at, last = self.db.execute("SELECT at, id FROM cursors WHERE consumer = ?", (consumer,)).fetchone() or (-1.0, "")
        got = self._focus("WHERE (at, id) > (?, ?) AND status != 'archived' ORDER BY at, id LIMIT ?", (at, last, limit))
        if got:
            self.db.execute("INSERT OR REPLACE INTO cursors VALUES (?, ?, ?)", (consumer, got[-1]["at"], got[-1]["id"]))
        return got

    def consume(self, focus: str) -> None:
        self._mark(focus, "consumed")

    def archive(self, focus: str) -> None:
        self._mark(focus, "archived")

    def _mark(self, focus: str, status: str) -> None:
        if not self.db.execute("UPDATE focus SET status = ? WHERE id = ?", (status, focus)).rowcount:
            raise KeyError(f"unknown focus event: {focus}")

    def _focus(self, tail: str, values: tuple) -> list[dict]:
        names = ("id", "rule", "at", "severity", "title", "summary", "dedupe", "row", "status")
        return [dict(zip(names, r, strict=True)) | {"row": json.loads(r[7])} for r in self.db.execute(f"SELECT {', '.join(names)} FROM focus {tail}", values)]

    def recent(self, rule: str, n: int = 10) -> list[dict]:
        return self._focus("WHERE rule = ? ORDER BY at DESC, id DESC LIMIT ?", (rule, n))


def window_bounds(state: dict, now: datetime, window_ms: int, slide_ms: int) -> tuple[str, str] | None:
    """The next closed processing-time window, or None before its end."""
    ms = int(now.timestamp() * 1000)
    end = state.get("next_window_end_ms") or ms - ms % slide_ms
    if end > ms:
        return None
    text = lambda x: datetime.fromtimestamp(x / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3]
    state["next_window_end_ms"] = end + slide_ms
    return text(end - window_ms), text(end)


def execute_once(spark: SparkSession, store: Store, rule: str, data: DataFrame, now: datetime | None = None, previous: DataFrame | None = None) -> dict:
    """Runs a rule over data (the view `input`, and current_snapshot; previous_snapshot is the last run's) and promotes its signals."""
    raw, state = store.rule(rule)
    spec, now = dsl.compile_rule(raw), now or datetime.now(UTC)
    if spec["execution"]["mode"] == "stream":
        bounds = window_bounds(state, now, spec["execution"]["window_ms"], spec["execution"]["slide_ms"])
        if bounds is None:
            return {"status": "waiting", "signals": 0, "focus_events": 0}
        data = data.where((F.col("ingested_at") >= bounds[0]) & (F.col("ingested_at") < bounds[1]))
    data.createOrReplaceTempView("input")
    data.createOrReplaceTempView("current_snapshot")
    (previous if previous is not None else data.limit(0)).createOrReplaceTempView("previous_snapshot")
    found = spark.sql(spec["sql"])
    asked = dsl.asked_rows(spec["condition"])
    kept = found.where(dsl.condition(spec["condition"], found.limit(asked).count() if asked > 1 else 1))  # a row that is there is one
    at = now.timestamp()
    signals = promoted = 0
    for some in _found(spark, kept, spec):
        if spec["promotion"]["cooldown_seconds"]:  # whether a row is promoted depends on those before it
            for f in some:
                store.add_found(rule, at, [f], due := _due(store, rule, spec["promotion"], f[4], at))
                promoted += due
        else:
            store.add_found(rule, at, some, True)
            promoted += len(some)
        signals += len(some)
    store.save_state(rule, state | {"last_run": at})
    return {"status": "done", "signals": signals, "focus_events": promoted}


def _found(spark: SparkSession, kept: DataFrame, spec: dict) -> Iterator[list[tuple]]:
    """_FOUND of the rows in their order, some thousands at a time. Executors make them, all at once, and write them to a shared folder."""
    import pyarrow.parquet as pq

    ship(spark)
    made = spark.createDataFrame(kept.rdd.mapPartitions(lambda rows: (_derived(spec, r.asDict(recursive=True)) for r in rows)), ", ".join(f"{n} string" for n in _FOUND))
    root = shared_folder(spark, "signals")
    made.write.option("maxRecordsPerFile", 0).parquet(f"{root}/found")
    for part in sorted(p for p in os.listdir(f"{root}/found") if p.startswith("part-")):
        with pq.ParquetFile(f"{root}/found/{part}") as f:
            for batch in f.iter_batches(20_000, columns=list(_FOUND)):
                yield list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    shutil.rmtree(root)


def _derived(spec: dict, row: dict) -> tuple:
    p, values = spec["promotion"], row | {"name": spec["name"]}
    dedupe = "|".join(str(row.get(k)) for k in p["key_fields"]) if p["key_fields"] else ""
    return json.dumps(row, default=str), severity(p, row), dsl.fill(p["title"], values), dsl.fill(p["summary"], values), dedupe


def severity(promotion: dict, row: dict) -> str:
    """That of the first rule {when: {field, op, value}, severity} that holds, else the default."""
    ops = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b, "not_in": lambda a, b: a not in b}
    for r in promotion["severity_rules"]:
        w, value = r["when"], row.get(r["when"]["field"])
        if value is not None and ops[w["op"]](value, w["value"]):
            return r["severity"]
    return promotion["severity"]


def _due(store: Store, rule: str, p: dict, dedupe: str, at: float) -> bool:
    """Whether the rule, or this row's key, had no focus event within the cooldown."""
    recent = store.recent(rule) if p["cooldown_seconds"] else ()
    return not any(0 <= at - old["at"] < p["cooldown_seconds"] and (not p["key_fields"] or old["dedupe"] == dedupe) for old in recent)


def promote(store: Store, rule: str, spec: dict, row: dict, at: float) -> bool:
    """Adds a focus event unless the rule, or this row's key, had one within the cooldown."""
    _, level, title, summary, dedupe = _derived(spec, row)
    if due := _due(store, rule, spec["promotion"], dedupe, at):
        store.add_focus(rule, at, level, title, summary, dedupe, row)
    return due


def run_for(spark: SparkSession, store: Store, rule: str, load, rounds: int, every: timedelta) -> list[dict]:
    """execute_once on load()'s rows, again and again."""
    out = []
    for i in range(rounds):
        out.append(execute_once(spark, store, rule, load()))
        if i + 1 < rounds:
            time.sleep(every.total_seconds())
    return out
