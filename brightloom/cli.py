"""Command line: python -m brightloom.cli COMMAND ... Results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import embedding, keyword, vector
from .runs import RunStore
from .session import Session


def _show(df: DataFrame, limit: int) -> None:
    for r in df.limit(limit).collect():
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="brightloom")
    top.add_argument("--master", default="local[*]")
    top.add_argument("--limit", type=int, default=50)
    top.add_argument("--runs", help="folder of tracked runs")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **defaults):
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        for k, v in defaults.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if v is not None else str)
        return c

    command("file-sql", "path", "sql", table="input")
    command("probe", "path")
    command("vector-search", "path", "column", "query", top_k=10, metric="cosine")
    command("keyword-index", "path", "columns", "out")
    command("keyword-search", "index", "query", top_k=10, where=None)
    command("embedding-build", "path", "out", doc_id=None, dim=32, version="v1")
    command("embedding-query", "dataset", "query", top_k=10, where=None, metric="cosine", dim=32)
    command("run-list", status=None)
    command("run-show", "run")
    command("run-diff", "a", "b")
    command("run-delete", "run")
    command("run-cleanup", keep_seconds=604800.0)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    store = RunStore(a.runs) if a.runs else None
    if a.command.startswith("run-"):
        if store is None:
            raise SystemExit("--runs is missing")
        if a.command == "run-list":
            print(*(json.dumps(r) for r in store.list(a.status, a.limit)), sep="\n")
            return 0
        if a.command == "run-show":
            print(json.dumps(store.get(a.run) | {"artifacts": store.artifacts(a.run)}))
            return 0
        if a.command == "run-delete":
            store.delete(a.run)
            return 0
        if a.command == "run-cleanup":
            print(json.dumps({"deleted": store.cleanup(a.keep_seconds)}))
            return 0
    spark = spark or SparkSession.builder.master(a.master).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s = Session(spark)
    if a.command == "run-diff":
        got = store.compare(spark, a.a, a.b)
        print(json.dumps({"facts": got["facts"]}))
        if got["rows"] is not None:
            _show(got["rows"], a.limit)
    elif a.command == "file-sql":
        s.create_temp_view(a.table, s.read(a.path))
        run = store.create("file-sql", path=a.path, sql=a.sql) if store else None
        out = s.sql(a.sql)
        if run:
            store.explain(run, s.explain_sql(a.sql))
            store.result(run, out)
            store.finish(run)
        _show(out, a.limit)
    elif a.command == "probe":
        print(json.dumps(s.probe(a.path)))
    elif a.command == "vector-search":
        _show(vector.vector_query(s.read(a.path), a.column, vector.parse(a.query), a.top_k, a.metric), a.limit)
    elif a.command == "keyword-index":
        print(keyword.build_keyword_index([s.read(a.path)], a.columns.split(","), a.out))
    elif a.command == "keyword-search":
        _show(keyword.search_keyword_index(spark, a.index, a.query, a.top_k, a.where), a.limit)
    elif a.command == "embedding-build":
        rows = embedding.build_embedding_rows(s.read(a.path), a.doc_id)
        print(embedding.materialize_embeddings(rows, a.out, a.dim, a.version).count())
    elif a.command == "embedding-query":
        _show(embedding.query_embeddings(spark.read.parquet(a.dataset), a.query, a.top_k, a.where, a.metric, dim=a.dim).drop("embedding"), a.limit)
    return 0


if __name__ == "__main__":
    sys.exit(main())
