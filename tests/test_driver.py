"""No rows of streams pass through the driver unless a program asks for them."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from brightloom.monitor import runtime
from brightloom.plans import catalog
from brightloom.streaming import query as streams

SF = "/root/testdata/sf0.01"


@pytest.fixture
def fetched(monkeypatch):
    """Rows that DataFrames have brought to the driver."""
    count = []
    for name in ("collect", "toArrow", "toLocalIterator"):
        real = getattr(DataFrame, name)

        def counted(self, *args, _real=real, **kw):
            got = _real(self, *args, **kw)
            got = got if hasattr(got, "__len__") else list(got)
            count.append(len(got))
            return got

        monkeypatch.setattr(DataFrame, name, counted)
    return count


@pytest.mark.parametrize(
    "name",
    [
        "stm_op_17_progress",
        "stm_src_03_queue",
        "stm_snk_02_file_append",
        "stm_op_11_retained_windows",
        "stm_op_01_rowwise",
        "stm_op_06_per_batch",
        "stm_op_02_limit",
        "stm_op_03_order_by",
        "stm_op_15_at_least_once",
        "stm_op_04_window_count",
        "stm_op_05_sliding",
        "stm_op_07_running",
        "stm_op_16_best_effort",
        "mon_07_promotion",
        "mon_05_execute",
    ],
)
def test_rows_stay_on_executors(spark, fetched, name):
    out = catalog.queries()[name](spark, SF)
    assert sum(fetched) <= 1000  # of 10,000 events
    out.write.format("noop").mode("overwrite").save()
    assert sum(fetched) <= 1000


def test_batches_of_many_files(spark):
    parts = [spark.range(10, numPartitions=3).select("id"), spark.range(10, 11).coalesce(1).select("id"), spark.range(0).select("id")]
    source = streams.MemorySource(spark, parts)
    assert source.files == 3
    sink = streams.MemorySink()
    assert streams.Stream(spark, source).order_by(["id"], [False]).start(sink).await_termination() == 3
    assert [[r["id"] for r in b] for b in sink.all] == [list(range(9, -1, -1)), [10], []] and (sink.batches, sink.rows, sink.last) == (3, 11, [])
    assert sorted(map(tuple, sink.frame("at").collect())) == [*((i, 0) for i in range(10)), (10, 1)]
    assert source.batch(spark).count() == 11


def test_memory_sink_keeps_any_columns(spark):
    sink = streams.MemorySink()
    sink.write(spark.createDataFrame([(1, None, 2.5)], "a int, b string, c double").select("a", F.col("b").alias("a"), F.lit(None).alias("a b"), "c"), 0)
    assert [tuple(r) for r in sink.last] == [(1, None, None, 2.5)] and sink.last[0].__fields__ == ["a", "a", "a b", "c"]


def test_queue_takes_frames(spark):
    q = streams.QueueSource(spark, "id long", files=3)
    q.push(spark.range(5, numPartitions=2))
    q.push_rows([(7,)])
    q.push(spark.range(10, 30, numPartitions=9))
    q.close()
    sink = streams.MemorySink()
    assert streams.Stream(spark, q).start(sink).await_termination() == 3
    assert [sorted(r["id"] for r in b) for b in sink.all] == [[*range(5)], [7], [*range(10, 30)]]
    with pytest.raises(RuntimeError):
        q.push(spark.range(1))


def test_appended_lines_are_those_of_str(spark, tmp_path):
    t = datetime.datetime(2024, 1, 2, 3, 4, 5, 600)
    rows = [(1, "a", True, 1e16, t), (None, None, None, None, None), (3, "c,\"d\"", False, 0.1, t)]
    df = spark.createDataFrame(rows, "i long, s string, b boolean, x double, t timestamp_ntz").repartitionByRange(3, F.col("s").asc_nulls_last())
    for names in (["i", "s", "b"], ["i", "s", "b", "x", "t"]):
        out = tmp_path / f"{len(names)}.csv"
        for batch in (0, 1):
            streams.FileAppendSink(str(out)).write(df.select(names), batch)
        lines = [",".join("" if v is None else str(v) for v in r[: len(names)]) for r in (rows[0], rows[2], rows[1])]
        assert out.read_text().splitlines() == [",".join(names), *lines, *lines]


def test_focus_frame_and_cooldown(spark):
    store, df = runtime.Store(""), spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "i int, k string").repartition(3).orderBy("i")
    promotion = {"title": "{i} {k}", "severity_rules": [{"when": {"field": "i", "op": ">", "value": 3}, "severity": "high"}]}
    free = store.save_rule({"name": "free", "sql": "SELECT * FROM input ORDER BY i", "promotion": promotion})
    keyed = store.save_rule({"name": "keyed", "sql": "SELECT * FROM input ORDER BY i", "promotion": promotion | {"key_fields": ["k"], "cooldown_seconds": 60}})
    assert [runtime.execute_once(spark, store, r, df)["focus_events"] for r in (free, keyed)] == [6, 2]
    got = [(e["title"], e["severity"], e["row"]) for e in store.poll("me")]
    assert got == [*((f"{i} {'ab'[i % 2]}", "high" if i > 3 else "info", {"i": i, "k": "ab"[i % 2]}) for i in range(6)), ("0 a", "info", {"i": 0, "k": "a"}), ("1 b", "info", {"i": 1, "k": "b"})]
    assert sorted((r["id"], r["title"], r["at"]) for r in store.focus_frame(spark).collect()) == sorted((e["id"], e["title"], e["at"]) for e in store.focus_events(limit=-1))
    assert runtime.Store("").focus_frame(spark).count() == 0
