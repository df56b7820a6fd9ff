"""Tracked runs: a folder and an index of what was run, on what, with what result; previews, comparison and clean-up."""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either, repeats counted, that the other lacks, with change: removed or added."""
    return before.exceptAll(after).withColumn("change", F.lit("removed")).union(after.exceptAll(before).withColumn("change", F.lit("added")))


class RunStore:
    def __init__(self, root: str):
        os.makedirs(root, exist_ok=True)
        self.root = root
        self.db = sqlite3.connect(os.path.join(root, "runs.sqlite"), check_same_thread=False)
        self.db.executescript(
            "CREATE TABLE IF NOT EXISTS runs(id TEXT PRIMARY KEY, action TEXT, status TEXT, created REAL, finished REAL, facts TEXT);"
            "CREATE TABLE IF NOT EXISTS artifacts(id TEXT PRIMARY KEY, run TEXT, kind TEXT, path TEXT, rows INTEGER, created REAL);"
        )

    def create(self, action: str, **facts) -> str:
        run = uuid.uuid4().hex
        os.makedirs(self.path(run))
        self.db.execute("INSERT INTO runs VALUES (?, ?, 'running', ?, NULL, ?)", (run, action, time.time(), json.dumps(facts)))
        self.db.commit()
        return run

    def path(self, run: str, *more: str) -> str:
        return os.path.join(self.root, run, *more)

    def _append(self, run: str, name: str, record: dict) -> None:
        with open(self.path(run, name), "a") as f:
            f.write(json.dumps({"at": time.time()} | record, default=str) + "\n")

    def inputs(self, run: str, **inputs) -> None:
        with open(self.path(run, "inputs.json"), "w") as f:
            json.dump(inputs, f, default=str)

    def explain(self, run: str, text: str) -> None:
        with open(self.path(run, "explain.txt"), "w") as f:
            f.write(text)

    def progress(self, run: str, **facts) -> None:
        self._append(run, "progress.jsonl", facts)

    def log(self, run: str, message: str) -> None:
        self._append(run, "log.jsonl", {"message": message})

    def result(self, run: str, df: DataFrame) -> str:
        """Writes df as the run's result; the artifact's id."""
        path, artifact = self.path(run, "result"), uuid.uuid4().hex
        df.write.mode("overwrite").parquet(path)
        self.db.execute("INSERT INTO artifacts VALUES (?, ?, 'result', ?, ?, ?)", (artifact, run, path, df.sparkSession.read.parquet(path).count(), time.time()))
        self.db.commit()
        return artifact

    def finish(self, run: str, status: str = "succeeded", **facts) -> None:
        old = self.get(run)["facts"]
        self.db.execute("UPDATE runs SET status = ?, finished = ?, facts = ? WHERE id = ?", (status, time.time(), json.dumps(old | facts, default=str), run))
        self.db.commit()

    def get(self, run: str) -> dict:
        row = self.db.execute("SELECT id, action, status, created, finished, facts FROM runs WHERE id = ?", (run,)).fetchone()
        if row is None:
            raise KeyError(f"unknown run: {run}")
        return dict(zip(("id", "action", "status", "created", "finished"), row, strict=False)) | {"facts": json.loads(row[5])}

    def list(self, status: str | None = None, limit: int = 50) -> list[dict]:
        return [self.get(r[0]) for r in self.db.execute("SELECT id FROM runs WHERE status = ? OR ? IS NULL ORDER BY created DESC LIMIT ?", (status, status, limit))]

    def artifacts(self, run: str) -> list[dict]:
        names = ("id", "run", "kind", "path", "rows", "created")
        return [dict(zip(names, r, strict=True)) for r in self.db.execute(f"SELECT {', '.join(names)} FROM artifacts WHERE run = ? ORDER BY created", (run,))]

    def preview(self, spark: SparkSession, artifact: str, n: int = 20) -> list[dict]:
        row = self.db.execute("SELECT path FROM artifacts WHERE id = ?", (artifact,)).fetchone()
        if row is None:
            raise KeyError(f"unknown artifact: {artifact}")
        return [r.asDict(recursive=True) for r in spark.read.parquet(row[0]).limit(n).collect()]

    def compare(self, spark: SparkSession, a: str, b: str) -> dict:
        """What differs in two runs' facts, and the rows that differ in their results."""
        x, y = self.get(a)["facts"], self.get(b)["facts"]
        facts = {k: (x.get(k), y.get(k)) for k in sorted({*x, *y}) if x.get(k) != y.get(k)}
        results = [next((r["path"] for r in self.artifacts(run) if r["kind"] == "result"), None) for run in (a, b)]
        return {"facts": facts, "rows": diff(*(spark.read.parquet(p) for p in results)) if all(results) else None}

    def delete(self, run: str) -> None:
        self.get(run)
        shutil.rmtree(self.path(run), ignore_errors=True)
        self.db.execute("DELETE FROM artifacts WHERE run = ?", (run,))
        self.db.execute("DELETE FROM runs WHERE id = ?", (run,))
        self.db.commit()

    def cleanup(self, keep_seconds: float) -> int:
        old = [r[0] for r in self.db.execute("SELECT id FROM runs WHERE created < ? AND status != 'running'", (time.time() - keep_seconds,))]
        for run in old:
            self.delete(run)
        return len(old)
