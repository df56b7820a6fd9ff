"""Sources, search, streams, embeddings, monitors and runs."""

import json
from datetime import UTC, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightloom.monitor import dsl, events, runtime
from brightloom.operators import embedding, keyword, vector
from brightloom.operators import relational as rel
from brightloom.runs import RunStore
from brightloom.session import Session
from brightloom.sources import files
from brightloom.sources.records import list_records
from brightloom.streaming import query as streams


def values(df):
    return [tuple(r) for r in df.collect()]


def test_quoted_csv(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes(b'id,a,b,c,d\n1,"a,b","line1\r\nline2",001,\n2,"plain","say ""hi""",42,\n3,short\n')
    got = values(files.read_csv(spark, str(tmp_path / "q.csv")))
    assert [r[:2] for r in got] == [(1, "a,b"), (2, "plain")]
    assert got[0][2].replace("\r\n", "\n") == "line1\nline2" and got[1][2] == 'say "hi"' and got[0][3] == "001" and got[0][4] is None


def test_lines(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1003|true|null|C:\\\\logs\\\\app\n\n1004|false|x|D:\\\\y\n")
    got = files.read_line_file(spark, str(tmp_path / "c.txt"), [("id", 0), ("ok", 1), ("note", 2), ("path", 3), ("none", 9)])
    assert values(got)[0] == (1003, True, None, "C:\\\\logs\\\\app", None)
    (tmp_path / "r.txt").write_text("uid=7 action=click latency=11\nnoise\nuid=8 action=view latency=13\n")
    got = files.read_line_file(spark, str(tmp_path / "r.txt"), [("uid", 1), ("action", 2), ("latency", 3)], "regex", regex_pattern=r"^uid=(\d+) action=(\w+) latency=(\d+)$")
    assert values(rel.filter_(got, "uid", ">", 7).limit(1)) == [(8, "view", 13)]


def test_json(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"user_id":1,"name":"al\\"ice\\t","vec":[1,2],"o":{"b":1}}\n{"user_id":2,"name":null,"vec":[3,4]}\n')
    got = values(files.read_json(spark, str(tmp_path / "j.jsonl")))
    assert got[0] == (1, 'al"ice\t', [1.0, 2.0], '{"b":1}') and got[1][1] is None
    (tmp_path / "a.json").write_text('[{"event":"open","cost":1.5},{"event":"close","cost":2}]')
    got = files.read_json(spark, str(tmp_path / "a.json"), format="json_array")
    assert values(rel.filter_(got, "cost", ">", 1.5)) == [("close", 2.0)]


def test_probe_and_read(spark, tmp_path):
    bodies = {"x.csv": "grp,val\nA,10\nA,20\nB,5\n", "x.txt": "A|10\nA|20\nB|5\n", "x.jsonl": '{"grp":"A","val":10}\n{"grp":"A","val":20}\n{"grp":"B","val":5}\n', "x.json": '[{"grp":"A","val":10},{"grp":"A","val":20},{"grp":"B","val":5}]'}
    kinds = {"x.csv": "csv", "x.txt": "line_split", "x.jsonl": "json_lines", "x.json": "json_array"}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
        assert files.probe(spark, str(tmp_path / name))["format"] == kinds[name]
        df = files.read(spark, str(tmp_path / name))
        assert sorted(values(df.groupBy(df.columns[0]).agg(F.sum(df.columns[1])))) == [("A", 30), ("B", 5)]


def test_materialize_rereads_only_changed_files(spark, tmp_path):
    path, calls = tmp_path / "m.csv", []
    path.write_text("a\n1\n")

    def reader():
        calls.append(1)
        return files.read_csv(spark, str(path))

    for _ in range(2):
        assert values(files.materialize(spark, str(path), reader, str(tmp_path / "root"))) == [(1,)]
    path.write_text("a\n1\n2\n")
    assert len(values(files.materialize(spark, str(path), reader, str(tmp_path / "root")))) == 2 and len(calls) == 2


def test_arrow_and_records(spark, tmp_path):
    t = pa.table({"id": [1, 2], "v": pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32(), 2))})
    assert values(files.from_arrow(spark, t)) == [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    pages = {None: {"items": [{"fields": {"n": 1, "o": {"name": "x"}}}], "has_more": True, "page_token": "p"}, "p": {"items": [{"fields": {"n": 2}}], "has_more": False}}
    assert sorted(r["n"] for r in list_records(spark, pages.get, str(tmp_path / "rec")).collect()) == [1, 2]
    g = spark.createDataFrame([('["a","b"]',), ('{"name":"a"}',), ("z",)], "f string")
    assert sorted(values(files.group_rows_count_by_field(g, "f"))) == [("a", 2), ("z", 1)]


def test_windows(spark):
    df = spark.createDataFrame([("2026-03-28T09:00:00",), ("2026-03-28T09:00:10",), ("2026-03-28T09:00:35",), (None,)], "ts string")
    got = rel.window_start(df, "ts", 60_000, slide_ms=30_000, as_text=True).where("ts IS NOT NULL").groupBy("window_start").count()
    assert sorted(values(got)) == [("2026-03-28T08:59:30", 2), ("2026-03-28T09:00:00", 3), ("2026-03-28T09:00:30", 1)]
    assert rel.window_start(df, "ts", 60_000).where("ts IS NULL").first()["window_start"] is None


def test_join_kinds(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([("1", "p"), (None, "q")], "k string, w string")
    c = spark.createDataFrame([(1, "p"), (None, "q"), (9, "r")], "k int, w string")
    assert rel.join(a, b, "k", "k").count() == 0 and rel.join(a, b, "k", "k", "left").count() == 3
    assert rel.join(a, c, "k", "k").count() == 1 and rel.join(a, c, "k", "k", null_safe=True).count() == 2
    assert rel.join(a, c, "k", "k", "full").count() == 5 and rel.join(a, c, "k", "k").columns == ["k", "v", "k_right", "w"]


def test_vectors(spark):
    df = spark.createDataFrame([(10, 0, [1.0, 0.0, 0.0]), (20, 1, [0.9, 0.1, 0.0]), (30, 1, [0.0, 1.0, 0.0]), (40, 1, None)], "id int, bucket int, v array<float>")
    assert values(vector.vector_query(df, "v", [1, 0, 0], 2))[0] == (0, 0.0)
    assert [r[0] for r in values(vector.vector_query(df, "v", [1, 0, 0], 9, "dot", id_column="id"))] == [10, 20, 30]
    assert values(vector.vector_query(df, "v", [0, 1, 0], 1, "l2", id_column="id")) == [(30, 0.0)]
    assert vector.hybrid_search(df.where("bucket = 1"), "v", [1, 0, 0], 2).first()["id"] == 20
    assert vector.hybrid_search(df, "v", [1, 0, 0], 9, "dot", 0.95).count() == 1
    text = spark.createDataFrame([(1, "[1 0 0]"), (2, "[0,1,0]")], "id int, v string")
    assert vector.vector_query(text, "v", "[0 1 0]", 1, id_column="id").first()["row_id"] == 2
    with pytest.raises(Exception, match="dimension mismatch"):
        vector.vector_query(df, "v", [1, 0], 1).collect()
    with pytest.raises(ValueError):
        vector.hybrid_search(df.withColumn("vector_score", F.lit(1)), "v", [1, 0, 0])


def test_cjk_keywords(spark):
    df = spark.createDataFrame([(1, "支付超时告警"), (2, "退款成功"), (3, "支付成功"), (4, "超时重试")], "id int, text string")
    got = [r["id"] for r in keyword.keyword_search(df, ["text"], "支付超时", 10).collect()]
    assert got[0] == 1 and got[1] in (3, 4) and 2 not in got


def test_tokens(spark):
    df = spark.createDataFrame([("Ab-1 支付 Ünïx カナ한국",), (None,), ("",)], "t string")
    got = sorted(df.select(keyword.tokens(F.col("t")).alias("k")).first()["k"])
    run = "カナ한국"
    assert got == sorted(["ab", "1", "n", "x", "支", "付", "支付", "支付", *run, *(run[i : i + 2] for i in range(3)), *(run[i : i + 3] for i in range(2)), run])
    assert [r[0] for r in df.select(F.size(keyword.tokens(F.col("t")))).collect()][1:] == [0, 0]


def test_hash_embedding(spark):
    import hashlib
    import struct

    def brute(text, dim):
        raw, c = [], 0
        while len(raw) < dim:
            raw += [x / 4294967295 * 2 - 1 for x in struct.unpack("<8I", hashlib.sha256(f"{text}\n{c}".encode()).digest())]
            c += 1
        n = sum(x * x for x in raw[:dim]) ** 0.5
        return [x / n for x in raw[:dim]]

    got = spark.range(1).select(embedding.hash_embedding(F.lit("héllo"), 12).alias("v")).first()["v"]
    assert got == pytest.approx(brute("héllo", 12), abs=1e-6)
    rows = spark.createDataFrame([("a", "v1", "1"), ("b", "v1", "1")], "doc_id string, embedding_version string, source_updated_at string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "doc_id string, source_updated_at string")
    assert sorted(r[0] for r in values(embedding.select_embedding_updates(now, rows, "v1"))) == ["b", "c"]


def test_overlap_search_hashes_a_text_once(spark):
    rows = spark.createDataFrame([(1, "small ring"), (2, "red part"), (3, None), (4, "zinc bolt"), (5, "支付 part")], "id int, t string")
    found = embedding.overlap_search(rows, "t", "red part", 4, tie="id")
    vectors = {r["t"] or "": r["v"] for r in rows.select("t", embedding.hash_embedding(F.coalesce("t", F.lit("")), 32).alias("v")).collect()}
    q = spark.range(1).select(embedding.hash_embedding(F.lit("red part"), 32).alias("v")).first()["v"]
    want = []
    for i, t in rows.collect():
        near = max(0.0, sum(a * b for a, b in zip(vectors[t or ""], q, strict=True)))
        share = len({"red", "part"} & set((t or "").split())) / 2
        if near > 0 or share > 0:
            want.append((i, pytest.approx(0.55 * share + 0.45 * near, abs=1e-6)))
    assert [(r["id"], r["score"]) for r in found.collect()] == sorted(want, key=lambda x: (-x[1].expected, x[0]))[:4]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def test_grounding_bundle_hashes_a_text_once(spark):
    part, nation = spark.createDataFrame([("small ring",), ("red part",)], "p string"), spark.createDataFrame([("FRANCE",), ("PERU",)], "n string")
    found = embedding.grounding_bundle({"part": (part, "p"), "nation": (nation, "n")}, "part of France", 1)
    assert [(r["kind"], r["item"]) for r in found.collect()] == [("part", '{"p":"red part"}'), ("nation", '{"n":"FRANCE"}')]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha2(") <= 2  # none where the rows are folded


def test_overlap_search_scores_each_text_once(spark):
    texts = ["small ring", "red part", "part of France", None, "", "zinc bolt"]
    rows = spark.createDataFrame([(None if i == 7 else 1000 - i, texts[i % 6]) for i in range(600)], "id int, t string")
    for query, k in (("small part of France", 3), ("red part", 250), ("nowhere", 130), ("red part", 1)):
        v = rows.select("id", "t", embedding.hash_embedding(F.coalesce("t", F.lit("")), 32).alias("v")).collect()
        q, words, want = embedding.embed_query(rows, query, 32), set(query.lower().split()), []
        for r in v:
            near, share = max(0.0, sum(a * b for a, b in zip(r["v"], q, strict=True))), len(words & set((r["t"] or "").lower().split())) / len(words)
            want.append((-(0.55 * share + 0.45 * near), -1 if r["id"] is None else r["id"], r["t"], near > 0 or share > 0))
        want = [(None if i < 0 else i, t, pytest.approx(-s, abs=1e-6)) for s, i, t, some in sorted(want, key=lambda x: (round(x[0], 6), x[1]))[:k] if some]
        found = embedding.overlap_search(rows, "t", query, k, tie="id")
        assert [(r["id"], r["t"], r["score"]) for r in found.collect()] == want and found.columns == ["id", "t", "keyword_score", "embedding_score", "score"]
        assert [r["score"] for r in embedding.overlap_search(rows, "t", query, k).collect()] == [w[2] for w in want]
    plan = embedding.overlap_search(rows, "t", "red part", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2(") < plan.index("RepartitionByExpression") < plan.index("Aggregate [")  # texts are grouped, then spread, then hashed


def test_hash_embedding_is_computed_once(spark):
    rows = spark.range(3).select(F.concat(F.lit("té"), "id").alias("t"))
    v = rows.select(embedding.hash_embedding(F.col("t"), 20).alias("v"))
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("sha2("), plan.count("SQRT("), plan.count("conv(")) == (1, 1, 1)
    assert [len(r["v"]) for r in v.collect()] == [20] * 3 and all(sum(x * x for x in r["v"]) == pytest.approx(1, abs=1e-5) for r in v.collect())


def test_embeddings_are_made_by_as_many_tasks_as_cores(spark, tmp_path):
    texts = spark.range(3000, numPartitions=1).select("id", (F.col("id") % 7).cast("string").alias("text"))
    texts.write.parquet(str(tmp_path / "rows"))  # one file, one row group: one task reads it
    rows = spark.read.parquet(str(tmp_path / "rows"))
    made = embedding.materialize_embeddings(rows, str(tmp_path / "out"), dim=8)
    got = made.select("*", F.input_file_name().alias("f")).collect()
    assert sorted((r["id"], r["text"]) for r in got) == [(i, str(i % 7)) for i in range(3000)]
    assert len({r["f"] for r in got}) == spark.sparkContext.defaultParallelism == 4 and len({(r["text"], tuple(r["embedding"])) for r in got}) == 7
    found = embedding.query_embeddings(made, "3", 4, dim=8, tie="id")
    assert [(r["id"], r["text"]) for r in found.collect()] == [(i, "3") for i in (3, 10, 17, 24)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:  # what fills as many splits by its size is not shuffled
        assert "Repartition" not in embedding._spread(rows)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_postings_are_counted_by_row(spark):
    def brute(rows):
        out = {}
        for i, t in rows:
            for w in t:
                out[w, i] = out.get((w, i), 0) + 1
        return sorted(((w, i, n) for (w, i), n in out.items()), key=repr)

    apart = [("1", ["b", "a", "b"]), ("2", []), ("3", ["a"]), (None, ["b", "b"])]
    for rows in (apart, [*apart, ("3", ["a", "c"]), (None, ["b"])]):
        docs = spark.createDataFrame(rows, "__doc_id string, __tokens array<string>")
        got = keyword._postings(docs)
        assert got.dtypes == [("term", "string"), ("__doc_id", "string"), ("tf", "bigint")] and sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert "Exchange" not in keyword._postings(spark.createDataFrame(apart, docs.schema))._jdf.queryExecution().executedPlan().toString()


def test_index_of_repeated_ids(spark, tmp_path):
    rows = [(1, "red part"), (1, "red red ring"), (2, "blue ring"), (None, "red"), (None, "red bolt")]
    path = keyword.build_keyword_index([spark.createDataFrame(rows, "d int, t string")], ["t"], str(tmp_path / "k"), doc_id_field="d")
    assert dict(map(tuple, spark.read.parquet(f"{path}/terms").collect())) == {"red": 2, "part": 1, "ring": 2, "blue": 1, "bolt": 1}
    assert sorted(map(tuple, spark.read.parquet(f"{path}/postings").where("term = 'red'").collect()), key=repr) == [("red", "1", 3), ("red", None, 2)]


def test_postings_sort_without_lambda(spark):
    rows = [("1", ["z", "支", "a", "z", "B", "é", "a", "z"]), ("2", [])]
    got = keyword._postings(spark.createDataFrame(rows, "__doc_id string, __tokens array<string>"))
    assert sorted((r["term"], r["tf"]) for r in got.collect()) == [("B", 1), ("a", 2), ("z", 3), ("é", 1), ("支", 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan


EVENTS = [[("09:00:00", "A"), ("09:00:10", "A"), ("09:00:30", "B")], [("09:00:40", "A"), ("09:00:50", "B")]]


def batches(spark, rows, schema):
    return streams.MemorySource(spark, [spark.createDataFrame(r, schema) for r in rows])


def test_running_window_count(spark):
    rows = [[(f"2026-03-28T{t}", k) for t, k in b] for b in EVENTS]
    sink = streams.MemorySink()
    q = streams.Stream(spark, batches(spark, rows, "ts string, key string")).window("ts", 60_000).group_by(["window_start", "key"]).count("n", stateful=True).start(sink)
    assert q.await_termination() == 2
    assert sorted((r["key"], r["n"]) for r in sink.last) == [("A", 3), ("B", 2)]
    p = q.progress()
    assert set(p) == set(streams.PROGRESS) and p["batches_processed"] == 2 and p["has_window"] and p["has_stateful_ops"]


def test_running_aggregates(spark):
    rows = [[("A", 10), ("A", 5), ("B", 7)], [("A", 3), ("B", 9)]]
    sink = streams.MemorySink()
    specs = [("SUM", "v", "s"), ("COUNT", None, "c"), ("MIN", "v", "lo"), ("MAX", "v", "hi"), ("AVG", "v", "m")]
    streams.Stream(spark, batches(spark, rows, "k string, v int")).group_by(["k"]).agg(specs, stateful=True).start(sink).await_termination()
    assert sorted(map(tuple, sink.last)) == [("A", 18.0, 3, 3, 10, 6.0), ("B", 16.0, 2, 7, 9, 8.0)]


def test_delivery_modes(spark, tmp_path):
    source = batches(spark, [[(1,)], [(2,)], [(3,)]], "v int")
    for mode, second, lines in (("at-least-once", 3, 5), ("best-effort", 2, 4)):
        out = tmp_path / f"{mode}.csv"
        start = lambda: streams.Stream(spark, source).start(streams.FileAppendSink(str(out)), checkpoint=str(tmp_path / mode), delivery=mode)  # noqa: B023, E731
        assert start().await_termination(max_batches=1) == 1
        assert start().await_termination() == second
        assert len(out.read_text().splitlines()) == lines and out.read_text().startswith("v\n1\n")


def test_window_eviction(spark):
    rows = [[("2026-03-28T09:00:00", 1)], [("2026-03-28T09:01:00", 2)], [("2026-03-28T09:02:00", 3)], [("2026-03-28T09:00:30", 4)]]
    sink = streams.MemorySink()
    s = streams.Stream(spark, batches(spark, rows, "ts string, v int")).window("ts", 60_000).group_by(["window_start"])
    s.agg([("SUM", "v", "s")], stateful=True, max_retained_windows=1).start(sink).await_termination()
    assert [tuple(b[0]) for b in sink.all] == [("2026-03-28T09:00:00", 1.0), ("2026-03-28T09:01:00", 2.0), ("2026-03-28T09:02:00", 3.0), ("2026-03-28T09:00:00", 4.0)]


def test_stream_order_limit_and_queue(spark):
    q = streams.QueueSource(spark, "id int, k string, v int")
    with pytest.raises(ValueError, match="unbounded"):
        streams.Stream(spark, q).order_by(["v"])
    q.push_rows([(1, "c", 5), (2, "a", 5), (3, "b", 9)])
    with pytest.raises(ValueError, match="schema"):
        q.push_arrow(pa.table({"x": [1]}))
    q.close()
    out = streams.QueueSink()
    streams.Stream(spark, q).order_by(["v", "k"], [False, True]).limit(2).start(out).await_termination()
    assert out.poll_arrow().column("id").to_pylist() == [3, 2] and out.closed and out.poll_arrow() is None
    got = []
    b = streams.BufferedSource(spark, "v int", emit_interval_seconds=100, emit_rows=2)
    for i in range(5):
        b.write((i,))
    b.close()
    streams.Stream(spark, b).start(streams.CallbackSink(lambda t: got.append(t.num_rows), emit_rows=4)).await_termination()
    assert got == [4, 1]


def test_stream_sql(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("batch-0001.csv", "key,value\nuserA,10\nuserA,5\n"), ("batch-0002.csv", "key,value\nuserB,20\nuserA,7\n")):
        (tmp_path / "in" / name).write_text(body)
        import os

        os.utime(tmp_path / "in" / name, (1_000_000 + int(name[6:10]),) * 2)
    s = Session(spark)
    s.sql(f"CREATE SOURCE TABLE src (key STRING, value INT) USING csv OPTIONS(path: '{tmp_path}/in', delimiter: ',')")
    s.sql(f"CREATE SINK TABLE snk (key STRING, s INT) USING csv OPTIONS(path: '{tmp_path}/out.csv')")
    q = s.start_stream_sql("INSERT INTO snk SELECT key, SUM(value) AS s FROM src WHERE value > 6 GROUP BY key HAVING s > 15")
    assert q.await_termination() == 2
    assert sorted((tmp_path / "out.csv").read_text().splitlines()[1:]) == ["userA,17.0", "userB,20.0"]
    text = s.explain_stream_sql("SELECT key, COUNT(*) AS n FROM src GROUP BY key")
    assert [x for x in text.split("\n") if x in ("logical", "physical", "strategy")] == ["logical", "physical", "strategy"]
    from brightloom.plans.errors import SqlError

    for bad in ("SELECT a.key FROM src a JOIN src b ON a.key = b.key", "SELECT key FROM src UNION ALL SELECT key FROM src", "SELECT key FROM src ORDER BY key", "SELECT key FROM src WHERE value > 1 AND value < 3", "SELECT key, COUNT(value) AS n FROM src GROUP BY key", "SELECT key FROM nope"):
        with pytest.raises(SqlError):
            s.stream_sql(bad)


def test_monitors(spark):
    store = runtime.Store()
    spec = {
        "name": "high", "template": "threshold", "parameters": {"table": "input", "field": "price", "op": ">", "value": 10},
        "condition": {"all": [{"min_rows": 1}, {"field": "symbol", "op": "in", "value": ["X", "Y"]}]},
        "promotion": {"severity": "info", "severity_rules": [{"when": {"field": "price", "op": ">", "value": 50}, "severity": "high"}], "title": "{name} {symbol}", "summary": "{price} {nope}", "key_fields": ["symbol"], "cooldown_seconds": 60},
    }
    rule = store.save_rule(spec)
    data = spark.createDataFrame([("X", 60), ("Y", 20), ("Z", 99), ("X", 5)], "symbol string, price int")
    at = datetime(2026, 1, 1, tzinfo=UTC)
    assert runtime.execute_once(spark, store, rule, data, at) == {"status": "done", "signals": 2, "focus_events": 2}
    assert runtime.execute_once(spark, store, rule, data, at.replace(second=30))["focus_events"] == 0
    assert runtime.execute_once(spark, store, rule, data, at.replace(minute=2))["focus_events"] == 2
    first = {e["title"]: e for e in store.focus_events()}
    assert first["high X"]["severity"] == "high" and first["high Y"]["severity"] == "info" and first["high X"]["summary"] == "60 {nope}"
    seen = store.poll("me", 3)
    assert len(seen) == 3 and len(store.poll("me")) == 1 and not store.poll("me")
    store.consume(seen[0]["id"])
    store.archive(seen[1]["id"])
    assert [len(store.focus_events(s)) for s in ("consumed", "archived", "new")] == [1, 1, 2]
    assert dsl.validate({"template": "nope"}) and not dsl.validate(spec)
    assert runtime.window_bounds(state := {}, at, 60_000, 30_000)[1].startswith("2026-01-01T00:00:00") and runtime.window_bounds(state, at, 60_000, 30_000) is None


def test_events(spark, tmp_path):
    payloads = spark.createDataFrame([(json.dumps({"ts": f"2026-01-0{i}", "kind": "trade", "symbol": "X", "price": i}),) for i in (1, 2, 3)], "payload_json string")
    rows = events.normalize(payloads, "feed", {"event_time": "ts", "event_type": "kind", "source_key": "symbol", "price": "price"})
    events.ingest(rows, str(tmp_path))
    got = events.between(events.read(spark, str(tmp_path), "feed"), "2026-01-02", "2026-01-04")
    assert sorted(r["price"] for r in got.collect()) == ["2", "3"]
    assert [r["price"] for r in events.between(events.read(spark, str(tmp_path)), limit=1).collect()] == ["3"]


def test_runs(spark, tmp_path):
    store = RunStore(str(tmp_path))
    made = []
    for n in (3, 4):
        run = store.create("sql", n=n)
        store.inputs(run, sql="x")
        store.log(run, "hello")
        artifact = store.result(run, spark.range(n))
        store.finish(run, rows=n)
        made.append(run)
    assert len(store.preview(spark, artifact)) == 4 and store.get(made[0])["status"] == "succeeded"
    got = store.compare(spark, *made)
    assert got["facts"]["n"] == (3, 4) and values(got["rows"]) == [(3, "added")]
    store.delete(made[0])
    assert [r["id"] for r in store.list()] == [made[1]] and store.cleanup(0) == 1


def test_capabilities():
    from brightloom.plans import capabilities as c

    assert {"LOWER", "CAST", "SUM"} <= {f["name"] for f in c.functions()} and set(c.capabilities()) == {"clauses", "left_out", "functions", "patterns"}
    assert c.search("keyword search text")[0]["name"] in ("KEYWORD SEARCH", "text search") and not c.search("zzz")


def test_own_state(spark):
    import pandas as pd

    def total(key, frames, state):
        n = (state.get[0] if state.exists else 0) + sum(int(f["v"].sum()) for f in frames)
        state.update((n,))
        yield pd.DataFrame({"k": [key[0]], "n": [n]})

    sink = streams.MemorySink()
    s = streams.Stream(spark, batches(spark, [[("a", 1), ("b", 5)], [("a", 2)]], "k string, v int")).with_state(["k"], total, "k string, n long", "n long")
    s.start(sink, state_backend="rocksdb").await_termination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [tuple(r) for r in sink.last] == [("a", 3)]


def test_monitor_takes_every_matching_row(spark):
    from brightloom.monitor import runtime

    events = spark.range(1500).selectExpr("id AS event_id", "double(id) AS value")
    store = runtime.Store()
    spec = {"name": "high", "sql": "SELECT event_id, value FROM input WHERE value >= 200 ORDER BY event_id", "promotion": {"title": "{event_id}", "severity_rules": []}}
    rule = store.save_rule(spec)
    got = runtime.execute_once(spark, store, rule, events)
    assert (got["signals"], got["focus_events"]) == (1300, 1300)
    assert sorted(int(e["title"]) for e in store.focus_events(limit=-1)) == list(range(200, 1500))
    assert store.db.execute("SELECT count(*) FROM signals").fetchone() == (1300,)


def test_monitor_min_rows_inside_trees(spark):
    from brightloom.monitor import dsl, runtime

    df = spark.createDataFrame([(1,), (4,), (None,)], "x int")
    kept = lambda tree: sorted(str(r["x"]) for r in df.where(dsl.condition(tree, df.count())).collect())
    over = {"field": "x", "op": ">", "value": 3}
    assert kept({"any": [{"min_rows": 5}, over]}) == ["4"] and kept({"any": [{"min_rows": 3}, over]}) == ["1", "4", "None"]
    assert kept({"not": {"min_rows": 5}}) == ["1", "4", "None"] and kept({"all": [{"not": {"min_rows": 2}}, over]}) == []
    assert kept({"field": "x", "op": "!=", "value": 1}) == ["4", "None"] and kept({"field": "x", "op": "not_in", "value": [1]}) == ["4", "None"]
    store = runtime.Store()
    for least, signals in ((3, 1), (4, 0)):  # counted over what the SQL returns, not over what is kept
        rule = store.save_rule({"name": "r", "sql": "SELECT * FROM input", "condition": {"all": [{"min_rows": least}, over]}})
        assert runtime.execute_once(spark, store, rule, df)["signals"] == signals


def test_keyword_tokens_are_ascii_words_and_cjk_grams(spark):
    from pyspark.sql import functions as F

    from brightloom.operators import keyword

    given = [("KKX İa B-2é3",), ("",), (None,), (" 退款 Ab",)]
    got = [r["t"] for r in spark.createDataFrame(given, "s string").select(keyword.tokens(F.col("s")).alias("t")).collect()]
    assert got == [["k", "x", "a", "b", "2", "3"], [], [], ["ab", "退", "款", "退款", "退款"]]
