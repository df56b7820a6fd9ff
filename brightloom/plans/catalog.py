"""The registered queries over the test tables, one or more for each operator, with the DuckDB form where SQL has one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..monitor import dsl, events, runtime
from ..operators import embedding, keyword, vector
from ..operators import relational as rel
from ..operators.relational import Bool, Compare, Ref
from ..functions import aggregates
from ..plugins import Outcome, Plugin
from ..session import Session
from ..sources import files
from ..streaming import query as streams
from . import capabilities

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _add(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _ORACLE[name] = sql
        return f

    return add


def _sql(name: str, text: str, oracle: str, tables: str, prepare: Callable | None = None) -> None:
    """A query of the SQL dialect over temp views of the tables."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        s = Session(spark)
        for t in tables.split():
            s.create_temp_view(t, _t(spark, d, t))
        if prepare:
            prepare(s, spark, d)
        return s.sql(text)

    _add(name, oracle)(run)


def _round(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) + 0.0 for n in names})


def _folder(spark: SparkSession) -> str:
    return streams.shared_folder(spark, "catalog")


# flagship and relational core


@_add(
    "flagship_pricing",
    "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS sum_price, count(*) AS n, round(avg(l_discount), 6) AS avg_disc FROM lineitem "
    "WHERE l_discount >= 0.05 AND l_quantity < 24 GROUP BY ALL ORDER BY sum_price DESC LIMIT 10",
)
def flagship(spark, d):
    s = Session(spark)
    s.create_temp_view("lineitem", _t(spark, d, "lineitem"))
    out = s.sql(
        "SELECT l_returnflag, l_linestatus, SUM(l_extendedprice) AS sum_price, COUNT(*) AS n, AVG(l_discount) AS avg_disc FROM lineitem "
        "WHERE l_discount >= 0.05 AND l_quantity < 24 GROUP BY l_returnflag, l_linestatus ORDER BY sum_price DESC LIMIT 10"
    )
    return _round(_round(out, "sum_price", places=2), "avg_disc")


@_add("q1_shape", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def q1(spark, d):
    out = aggregates.aggregate(
        rel.filter_(_t(spark, d, "lineitem"), "l_shipdate", "<=", "1998-09-02"), ["l_returnflag", "l_linestatus"],
        [("SUM", "l_quantity", "sum_qty"), ("SUM", "l_extendedprice", "sum_price"), ("AVG", "l_discount", "avg_disc"), ("COUNT", None, "n")],
    )
    return _round(_round(out, "sum_qty", "sum_price", places=2), "avg_disc")


@_add("q6_shape", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount >= 0.03 AND l_quantity < 24 HAVING count(*) > 0")
def q6(spark, d):
    kept = rel.where(_t(spark, d, "lineitem"), Bool("and", (Compare("l_shipdate", ">=", "1994-01-01"), Compare("l_shipdate", "<", "1997-01-01"), Compare("l_discount", ">=", 0.03), Compare("l_quantity", "<", 24))))
    return _round(aggregates.aggregate(kept.withColumn("v", F.col("l_extendedprice") * F.col("l_discount")), [], [("SUM", "v", "revenue")]), "revenue", places=2)


@_add("q3_shape", "SELECT o_orderkey, round(sum(l_extendedprice), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '1996-06-01' AND l_shipdate > TIMESTAMP '1994-01-01' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10")
def q3(spark, d):
    o = rel.filter_(_t(spark, d, "orders"), "o_orderdate", "<", "1996-06-01").select("o_orderkey")
    li = rel.filter_(_t(spark, d, "lineitem"), "l_shipdate", ">", "1994-01-01").select("l_orderkey", "l_extendedprice")
    out = aggregates.aggregate(rel.join(o, li, "o_orderkey", "l_orderkey"), ["o_orderkey"], [("SUM", "l_extendedprice", "revenue")])
    return rel.top_n(_round(out, "revenue", places=2), ["revenue", "o_orderkey"], 10, [False, True])


@_add("q18_shape", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 100")
def q18(spark, d):
    out = aggregates.aggregate(_t(spark, d, "orders"), ["o_custkey"], [("SUM", "o_totalprice", "total"), ("COUNT", None, "n")])
    return rel.top_n(_round(out, "total", places=2), ["total", "o_custkey"], 100, [False, True])


_simple = {
    "prj_01_select": (lambda t: rel.select(t("nation"), ["n_name", "n_nationkey"], ["name", "id"]), "SELECT n_name AS name, n_nationkey AS id FROM nation"),
    "prj_01_select_by_indices": (lambda t: rel.select_by_indices(t("region"), [1, 0], ["name", "id"]), "SELECT r_name AS name, r_regionkey AS id FROM region"),
    "prj_04_copy_column": (lambda t: rel.with_column(t("region"), "copy", "r_name"), "SELECT *, r_name AS copy FROM region"),
    "prj_05_with_function": (lambda t: rel.with_column(t("nation"), "low", function="LOWER", args=[Ref("n_name")]), "SELECT *, lower(n_name) AS low FROM nation"),
    "prj_06_drop": (lambda t: rel.drop(t("nation"), "n_regionkey"), "SELECT n_nationkey, n_name FROM nation"),
    "flt_01_comparison": (lambda t: rel.filter_(t("orders"), "o_totalprice", ">", 200000.0).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000"),
    "flt_02_tree": (
        lambda t: rel.where(t("lineitem"), Bool("and", (Bool("or", (Compare("l_returnflag", "=", "A"), Compare("l_returnflag", "=", "R"))), Compare("l_quantity", ">", 45)))).select("l_orderkey", "l_linenumber"),
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'A' OR l_returnflag = 'R') AND l_quantity > 45",
    ),
    "flt_03_not": (lambda t: rel.where(t("orders"), rel.invert(Compare("o_orderstatus", "=", "F"))).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "flt_04_columns": (lambda t: rel.filter_(t("lineitem"), "l_partkey", "<", Ref("l_suppkey")).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey"),
    "flt_05_null": (
        lambda t: rel.filter_(rel.join(t("documents"), t("labels"), "doc_id", "doc_id", "left"), "quality", "=", None).select("doc_id"),
        "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL",
    ),
    "flt_05_not_null": (
        lambda t: rel.filter_(rel.join(t("documents"), t("labels"), "doc_id", "doc_id", "left"), "quality", "!=", None).select("doc_id"),
        "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL",
    ),
    "flt_q10_cross_type": (lambda t: rel.filter_(t("nation"), "n_name", "=", 1), "SELECT * FROM nation WHERE false"),
    "join_01_inner": (lambda t: rel.join(t("nation"), t("region"), "n_regionkey", "r_regionkey"), "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_02_left": (lambda t: rel.join(t("documents"), t("labels"), "doc_id", "doc_id", "left").select("doc_id", "quality", "toxic"), "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "join_03_right": (lambda t: rel.join(t("labels"), t("documents"), "doc_id", "doc_id", "right").select("doc_id_right", "toxic"), "SELECT d.doc_id AS doc_id_right, toxic FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id"),
    "join_04_null_safe": (
        lambda t: rel.join(t("nation").select(F.nullif("n_regionkey", F.lit(1)).alias("k"), "n_name"), t("region").select(F.nullif("r_regionkey", F.lit(1)).alias("j"), "r_name"), "k", "j", null_safe=True),
        "SELECT * FROM (SELECT nullif(n_regionkey, 1) AS k, n_name FROM nation) JOIN (SELECT nullif(r_regionkey, 1) AS j, r_name FROM region) ON k IS NOT DISTINCT FROM j",
    ),
    "join_05_duplicate_names": (
        lambda t: rel.join(t("documents"), t("labels"), "doc_id", "doc_id").select("doc_id", "doc_id_right", "toxic"), "SELECT d.doc_id, l.doc_id AS doc_id_right, toxic FROM documents d JOIN labels l USING (doc_id)"
    ),
    "join_08_semi": (lambda t: t("documents").join(t("labels"), "doc_id", "left_semi").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "join_08_anti": (lambda t: t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "agg_01_group": (
        lambda t: _round(aggregates.aggregate(t("orders"), ["o_orderpriority", "o_orderstatus"], [("SUM", "o_totalprice", "total"), ("COUNT", "o_orderkey", "n")]), "total", places=2),
        "SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY ALL",
    ),
    "agg_02_grouped_sum": (lambda t: _round(aggregates.aggregate(t("customer"), ["c_mktsegment"], [("SUM", "c_acctbal", "total")]), "total", places=2), "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1"),
    "agg_03_sum_all_null": (
        lambda t: aggregates.aggregate(t("nation").select("n_regionkey", F.nullif("n_regionkey", F.lit(2)).alias("v")), ["n_regionkey"], [("SUM", "v", "total"), ("AVG", "v", "mean"), ("MIN", "v", "low")]),
        "SELECT n_regionkey, coalesce(sum(CAST(nullif(n_regionkey, 2) AS DOUBLE)), 0) AS total, coalesce(avg(nullif(n_regionkey, 2)), 0) AS mean, min(nullif(n_regionkey, 2)) AS low FROM nation GROUP BY 1",
    ),
    "agg_04_count_rows": (
        lambda t: aggregates.aggregate(rel.join(t("documents"), t("labels"), "doc_id", "doc_id", "left"), ["lang"], [("COUNT", "quality", "n")]), "SELECT lang, count(*) AS n FROM documents GROUP BY 1"
    ),
    "agg_05_avg": (lambda t: _round(aggregates.aggregate(t("part"), ["p_brand"], [("AVG", "p_retailprice", "mean")]), "mean"), "SELECT p_brand, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1"),
    "agg_06_min_max": (
        lambda t: aggregates.aggregate(t("part"), ["p_type"], [("MIN", "p_name", "first"), ("MAX", "p_size", "most")]), "SELECT p_type, min(p_name) AS first, max(p_size) AS most FROM part GROUP BY 1"
    ),
    "agg_07_global": (
        lambda t: _round(aggregates.aggregate(t("supplier"), [], [("SUM", "s_acctbal", "total"), ("COUNT", None, "n")]), "total", places=2), "SELECT round(sum(s_acctbal), 2) AS total, count(*) AS n FROM supplier"
    ),
    "agg_07_global_empty": (lambda t: aggregates.aggregate(t("supplier").where("false"), [], [("COUNT", None, "n")]), "SELECT count(*) AS n FROM supplier WHERE false HAVING count(*) > 0"),
    "agg_high_cardinality": (
        lambda t: _round(aggregates.aggregate(t("lineitem"), ["l_orderkey", "l_linenumber"], [("SUM", "l_quantity", "q")]), "q", places=2), "SELECT l_orderkey, l_linenumber, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL"
    ),
    "agg_13_distinct_extended": (lambda t: t("orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n")), "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1"),
    "win_02_tumbling": (
        lambda t: aggregates.aggregate(rel.window_start(t("events"), "ts", 3_600_000), ["window_start", "event_type"], [("COUNT", None, "n")]),
        "SELECT CAST((epoch_us(ts) // 1000) // 3600000 * 3600000 AS BIGINT) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    ),
    "win_03_sliding": (
        lambda t: aggregates.aggregate(rel.window_start(t("events"), "ts", 3_600_000, slide_ms=1_500_000), ["window_start"], [("COUNT", None, "n")]),
        "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([(epoch_us(ts) // 1000) // 1500000 * 1500000 - i * 1500000 for i in [0, 1, 2]]) AS w, (epoch_us(ts) // 1000) AS ms FROM events) WHERE ms < w + 3600000 GROUP BY 1",
    ),
    "srt_01_order_limit": (lambda t: rel.order_by(t("customer"), ["c_acctbal", "c_custkey"], [False, True]).limit(50).select("c_custkey"), "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50"),
    "srt_01_nulls_last": (
        lambda t: rel.top_n(rel.join(t("documents"), t("labels"), "doc_id", "doc_id", "left").select("doc_id", "quality"), ["quality", "doc_id"], 120, [False, True]),
        "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY quality DESC NULLS LAST, d.doc_id LIMIT 120",
    ),
    "srt_03_top_n": (lambda t: rel.top_n(t("lineitem"), ["l_extendedprice", "l_orderkey", "l_linenumber"], 25, [False, True, True]).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25"),
    "srt_02_limit_zero": (lambda t: t("nation").limit(0), "SELECT * FROM nation LIMIT 0"),
    "srt_06_repartition": (lambda t: t("nation").repartition(4), "SELECT * FROM nation"),
    "set_01_union_all": (
        lambda t: rel.union(t("nation").select(F.col("n_name").alias("name")), t("region").select("r_name")), "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"
    ),
    "set_02_union": (lambda t: rel.union(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select("s_nationkey"), distinct=True), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "set_05_except_extended": (lambda t: t("customer").select(F.col("c_custkey").alias("k")).exceptAll(t("orders").select("o_custkey")), "SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders"),
    "src_18_group_rows": (lambda t: files.group_rows_count_by_field(t("events"), "event_type"), "SELECT event_type AS key, count(*) AS count FROM events GROUP BY 1"),
    "ext_04_normalize_columns": (
        lambda t: files.normalize_columns(t("region").toDF("Region Key", "1st name")), "SELECT r_regionkey AS region_key, r_name AS c_1st_name FROM region"
    ),
}
for _name, (_f, _oracle) in _simple.items():
    _add(_name, _oracle)(lambda spark, d, f=_f: f(lambda n: _t(spark, d, n)))

# scalar functions, through the dialect

_strip = r"E' \t\n\x0B\x0C\r'"
_scalar = [
    ("str_01_lower", "LOWER(n_name)", "lower(n_name)", "nation"), ("str_02_upper", "UPPER(event_type)", "upper(event_type)", "events"),
    ("str_03_trim", "TRIM(CONCAT('  ', n_name, ' '))", "trim('  ' || n_name || ' ')", "nation"), ("str_04_ltrim", "LTRIM(CONCAT('  ', n_name, ' '))", "ltrim('  ' || n_name || ' ')", "nation"),
    ("str_05_rtrim", "RTRIM(CONCAT('  ', n_name, ' '))", "rtrim('  ' || n_name || ' ')", "nation"), ("str_06_length", "LENGTH(text)", "CAST(length(text) AS BIGINT)", "documents"),
    ("str_07_reverse", "REVERSE(n_name)", "reverse(n_name)", "nation"), ("str_08_concat", "CONCAT(n_name, '-', n_nationkey)", "n_name || '-' || n_nationkey", "nation"),
    ("str_09_concat_ws", "CONCAT_WS('/', n_name, n_regionkey, 'x')", "n_name || '/' || n_regionkey || '/' || 'x'", "nation"), ("str_10_left", "LEFT(n_name, 3)", "left(n_name, 3)", "nation"),
    ("str_11_right", "RIGHT(n_name, 3)", "right(n_name, 3)", "nation"), ("str_12_substr", "SUBSTR(n_name, 2, 3)", "substr(n_name, 2, 3)", "nation"),
    ("str_12_substr_clamped", "SUBSTR(n_name, 0, 2)", "substr(n_name, 1, 2)", "nation"), ("str_13_position", "POSITION('A', n_name)", "CAST(position('A' IN n_name) AS BIGINT)", "nation"),
    ("str_14_replace", "REPLACE(n_name, 'A', 'b')", "replace(n_name, 'A', 'b')", "nation"), ("cnv_01_cast_string", "CAST(n_nationkey AS STRING)", "CAST(n_nationkey AS VARCHAR)", "nation"),
    ("cnv_01_cast_int", "CAST(s_acctbal AS INT)", "CAST(trunc(s_acctbal) AS BIGINT)", "supplier"), ("cnv_01_cast_double", "CAST(n_nationkey AS DOUBLE)", "CAST(n_nationkey AS DOUBLE)", "nation"),
    ("cnv_01_cast_bool", "CAST(CAST(n_nationkey AS STRING) AS BOOL)", "lower(CAST(n_nationkey AS VARCHAR)) IN ('true', '1')", "nation"), ("num_01_abs", "ABS(c_acctbal)", "abs(c_acctbal)", "customer"),
    ("num_02_ceil", "CEIL(c_acctbal)", "ceil(c_acctbal) + 0.0", "customer"), ("num_03_floor", "FLOOR(c_acctbal)", "floor(c_acctbal)", "customer"), ("num_04_round", "ROUND(c_acctbal)", "round(c_acctbal, 0) + 0.0", "customer"),
    ("dat_01_year", "YEAR(o_orderdate)", "year(o_orderdate)", "orders"), ("dat_02_month", "MONTH(o_orderdate)", "month(o_orderdate)", "orders"), ("dat_03_day", "DAY(ts)", "day(ts)", "events"),
    ("dat_04_iso_year", "ISO_YEAR(o_orderdate)", "isoyear(o_orderdate)", "orders"), ("dat_05_iso_week", "ISO_WEEK(o_orderdate)", "week(o_orderdate)", "orders"),
    ("dat_06_week", "WEEK(o_orderdate)", "week(o_orderdate)", "orders"), ("dat_07_yearweek", "YEARWEEK(o_orderdate)", "isoyear(o_orderdate) * 100 + week(o_orderdate)", "orders"),
    ("tim_05_unix_timestamp", "UNIX_TIMESTAMP(ts)", "(epoch_us(ts) // 1000) // 1000", "events"), ("fun_01_nested", "LEN(UPPER(SUBSTR(n_name, 1, 4)))", "CAST(length(upper(substr(n_name, 1, 4))) AS BIGINT)", "nation"),
]
_keys = {"nation": "n_nationkey", "events": "event_id", "documents": "doc_id", "supplier": "s_suppkey", "customer": "c_custkey", "orders": "o_orderkey"}
for _name, _dialect, _duck, _table in _scalar:
    _cast = "" if _name.startswith(("str", "num", "cnv")) else "BIGINT"
    _shown = f"CAST({_duck} AS BIGINT)" if _cast else _duck
    if _name.startswith("num"):
        _sql(_name, f"SELECT {_keys[_table]}, {_dialect} AS v FROM {_table}", f"SELECT {_keys[_table]}, CAST({_duck} AS DOUBLE) + 0.0 AS v FROM {_table}", _table)
    else:
        _sql(_name, f"SELECT {_keys[_table]}, {_dialect} AS v FROM {_table}", f"SELECT {_keys[_table]}, {_shown} AS v FROM {_table}", _table)

# the dialect

_sql("prj_02_star", "SELECT * FROM region", "SELECT * FROM region", "region")
_sql("prj_03_alias_star", "SELECT r.* FROM region r", 'SELECT r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM region', "region")
_sql("prj_07_no_from", "SELECT 1 AS one, 'x' AS s, UPPER('abc') AS u, UNIX_TIMESTAMP('2026-01-01') AS t", "SELECT CAST(1 AS INTEGER) AS one, 'x' AS s, 'ABC' AS u, CAST(1767225600 AS BIGINT) AS t", "")
_sql("prj_08_default_names", "SELECT o_orderstatus, COUNT(*), MAX(o_orderkey) FROM orders GROUP BY o_orderstatus", 'SELECT o_orderstatus, count(*) AS "count", max(o_orderkey) AS max_o_orderkey FROM orders GROUP BY 1', "orders")
_sql("tim_03_today_length", "SELECT LENGTH(TODAY()) AS n, LENGTH(NOW()) AS m", "SELECT CAST(10 AS BIGINT) AS n, CAST(19 AS BIGINT) AS m", "")
_sql("flt_06_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12", "orders")
_sql("flt_06_having_aggregate", "SELECT c_mktsegment, MAX(c_acctbal) AS m FROM customer GROUP BY c_mktsegment HAVING MAX(c_acctbal) > 100 AND c_mktsegment != 'BUILDING'", "SELECT c_mktsegment, max(c_acctbal) AS m FROM customer GROUP BY 1 HAVING max(c_acctbal) > 100 AND c_mktsegment <> 'BUILDING'", "customer")
_sql("sql_join", "SELECT n.n_name AS nation, r.r_name AS region FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name != 'ASIA'", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'", "nation region")
_sql("sql_left_join", "SELECT d.doc_id AS doc_id, l.toxic AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id)", "documents labels")
_sql("agg_08_group_by_function", "SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate)", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1", "orders")
_sql("set_03_chained_union", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer", "nation region customer")
_sql("sql_not_or", "SELECT n_nationkey FROM nation WHERE NOT n_regionkey = 1 AND (n_nationkey < 5 OR n_nationkey >= 20)", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 1 AND (n_nationkey < 5 OR n_nationkey >= 20)", "nation")
_sql("sql_order_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20", "customer")


def _users(s: Session, *_):
    s.sql("CREATE TABLE users (user_id INT, region STRING, score INT)")
    s.sql("INSERT INTO users VALUES (1, 'apac', 25), (2, 'emea', 18), (3, 'na', 34)")
    s.sql("INSERT INTO users (user_id, score) VALUES (4, 7)")
    s.sql("CREATE TABLE archive (user_id INT, region STRING, score INT)")
    s.sql("INSERT INTO archive SELECT user_id, region, score FROM users WHERE score > 20")


_values = "(VALUES (1, 'apac', 25), (2, 'emea', 18), (3, 'na', 34), (4, NULL, 7)) t(user_id, region, score)"
_sql("src_22_insert_values", "SELECT * FROM users", f"SELECT user_id::BIGINT AS user_id, region, score::BIGINT AS score FROM {_values}", "", _users)
_sql("src_23_insert_select", "SELECT * FROM archive", f"SELECT user_id::BIGINT AS user_id, region, score::BIGINT AS score FROM {_values} WHERE score > 20", "", _users)
_sql("flt_05_sql_null", "SELECT user_id FROM users WHERE region = NULL", f"SELECT user_id::BIGINT AS user_id FROM {_values} WHERE region IS NULL", "", _users)
_sql("src_09_empty_table", "SELECT COUNT(*) AS n FROM nothing", "SELECT count(*) AS n FROM nation WHERE false HAVING count(*) > 0", "", lambda s, *_: s.sql("CREATE TABLE nothing (a INT, b STRING)"))


@_add("src_24_status", "SELECT true AS ok, 'inserted' AS message, CAST(2 AS BIGINT) AS affected_rows")
def status(spark, d):
    s = Session(spark)
    s.sql("CREATE TABLE t (a INT)")
    return s.sql("INSERT INTO t VALUES (1), (2)")


# search

_DUCK_Q = "CAST([" + ", ".join(str(round(0.1 * (i % 7) - 0.3, 1)) for i in range(64)) + "] AS FLOAT[])"
_Q = [round(0.1 * (i % 7) - 0.3, 1) for i in range(64)]
_e, _q = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))", f"list_transform({_DUCK_Q}, lambda x: CAST(x AS DOUBLE))"
_dot, _norm = f"list_inner_product({_e}, {_q})", f"(sqrt(list_inner_product({_e}, {_e})) * sqrt(list_inner_product({_q}, {_q})))"
_cos, _l2 = f"1 - least(greatest({_dot} / {_norm}, -1), 1)", f"list_distance({_e}, {_q})"
for _metric, _score, _way in (("cosine", _cos, "ASC"), ("dot", _dot, "DESC"), ("l2", _l2, "ASC")):
    _add(f"vec_query_{_metric}", f"SELECT vec_id AS row_id, round({_score}, 6) + 0.0 AS score FROM embeddings ORDER BY {_score} {_way}, vec_id LIMIT 10")(
        lambda spark, d, m=_metric: _round(vector.vector_query(_t(spark, d, "embeddings"), "embedding", _Q, 10, m, id_column="vec_id"), "score")
    )


@_add("hyb_01_filtered", f"SELECT vec_id, label, round(vector_score, 6) + 0.0 AS vector_score FROM (SELECT vec_id, label, {_cos} AS vector_score FROM embeddings WHERE label = 1 ORDER BY 3, vec_id LIMIT 20) WHERE vector_score <= 0.95")
def hybrid(spark, d):
    kept = rel.filter_(_t(spark, d, "embeddings"), "label", "=", 1)
    return _round(vector.hybrid_search(kept, "embedding", _Q, 20, "cosine", 0.95, tie="vec_id").select("vec_id", "label", "vector_score"), "vector_score")


@_add("hyb_01_sql", f"SELECT vec_id, round({_dot}, 6) + 0.0 AS vector_score FROM embeddings WHERE label = 2 ORDER BY {_dot} DESC LIMIT 5")
def hybrid_sql(spark, d):
    s = Session(spark)
    s.create_temp_view("embeddings", _t(spark, d, "embeddings"))
    return _round(s.sql(f"SELECT vec_id, vector_score FROM embeddings WHERE label = 2 HYBRID SEARCH embedding QUERY '[{' '.join(map(str, _Q))}]' METRIC dot TOP_K 5"), "vector_score")


@_add("vec_06_explain")
def explain_vector(spark, d):
    return spark.createDataFrame([(vector.explain_vector_query(_t(spark, d, "embeddings"), "embedding", _Q, 10),)], "plan string")


@_add("hyb_03_explain")
def explain_hybrid(spark, d):
    return spark.createDataFrame([(vector.explain_hybrid_search(_t(spark, d, "embeddings"), "embedding", _Q, 10, "dot", 0.1),)], "plan string")


_WORDS = "[lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9]+')]"


def _bm25(where: str, terms: tuple[str, ...], top: int) -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    return (
        f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents {where}), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d), t AS (SELECT col0 AS term FROM (VALUES {values})), "
        "f AS (SELECT doc_id, len(w) AS l, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, t), g AS (SELECT term, count(*) AS df FROM f WHERE tf > 0 GROUP BY 1), "
        "r AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS k FROM f JOIN g USING (term), s WHERE tf > 0 GROUP BY 1) "
        f"SELECT doc_id, round(k, 6) AS keyword_score FROM r ORDER BY round(k, 9) DESC, doc_id LIMIT {top}"
    )


@_add("key_01_bm25", _bm25("WHERE lang = 'en'", ("attion", "license", "clown"), 10))
def bm25(spark, d):
    kept = rel.filter_(_t(spark, d, "documents"), "lang", "=", "en").select("doc_id", "text")
    terms = keyword.query_terms(spark, "attion License clown")
    found = keyword.bm25(kept.withColumn("__tokens", keyword.tokens(F.col("text"))), terms)
    return _round(found.select("doc_id", "keyword_score").orderBy(F.round("keyword_score", 9).desc(), "doc_id").limit(10), "keyword_score")


@_add("key_02_cjk_tokens")
def cjk(spark, d):
    rows = spark.createDataFrame([(1, "支付超时 error-42"), (2, "退款")], "id int, text string")
    return rows.select("id", keyword.tokens(F.col("text")).alias("tokens"))


@_add("key_04_keyword_then_hybrid")
def keyword_hybrid(spark, d):
    s = Session(spark)
    docs = rel.join(_t(spark, d, "documents").select("doc_id", "text", "lang"), _t(spark, d, "embeddings"), "doc_id", "vec_id")
    s.create_temp_view("docs", docs)
    return s.sql(f"SELECT doc_id, keyword_score, vector_score FROM docs WHERE lang = 'en' KEYWORD SEARCH(text) QUERY 'attion license' TOP_K 20 HYBRID SEARCH embedding QUERY '[{' '.join(map(str, _Q))}]' TOP_K 5")


@_add("key_06_index_search", _bm25("", ("attion", "license"), 10).replace("SELECT doc_id, round", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, round"))
def index_search(spark, d):
    path = keyword.build_keyword_index([_t(spark, d, "documents").select("doc_id", "text", "lang")], ["text"], _folder(spark), doc_id_field="doc_id")
    found = keyword.search_keyword_index(spark, path, "attion license", 1000)
    return _round(found.select(F.col("__doc_id").alias("doc_id"), "keyword_score").orderBy(F.round("keyword_score", 9).desc(), F.col("doc_id").cast("long")).limit(10), "keyword_score")


@_add("key_07_index_search_where", _bm25("WHERE lang = 'en'", ("attion", "license"), 10).replace("SELECT doc_id, round", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, round"))
def index_search_where(spark, d):
    path = keyword.build_keyword_index([_t(spark, d, "documents").select("doc_id", "text", "lang")], ["text"], _folder(spark), doc_id_field="doc_id")
    found = keyword.search_keyword_index(spark, path, "attion license", 1000, where="lang = 'en'")
    return _round(found.select(F.col("__doc_id").alias("doc_id"), "keyword_score").orderBy(F.round("keyword_score", 9).desc(), F.col("doc_id").cast("long")).limit(10), "keyword_score")


@_add("emb_01_template", "SELECT part.p_partkey, 'title: ' || p_name || chr(10) || 'tags: ' || p_brand AS rendered FROM part")
def template(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("tags"))
    return p.select("p_partkey", embedding.render_text_template(p).alias("rendered"))


@_add("emb_03_updates", "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 = 0")
def updates(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("2").alias("source_updated_at"), F.col("doc_id").alias("n"))
    old = rows.where("n % 3 = 0").select("doc_id", F.lit("v1").alias("embedding_version"), F.when(F.col("n") % 5 == 0, "1").otherwise("2").alias("source_updated_at"))
    return embedding.select_embedding_updates(rows, old, "v1").select("doc_id")


@_add("emb_04_hash", "SELECT n_name, CAST(8 AS INTEGER) AS dim, 1.0::DOUBLE AS norm FROM nation")
def hashed(spark, d):
    v = _t(spark, d, "nation").select("n_name", embedding.hash_embedding(F.col("n_name"), 8).alias("v"))
    return v.select("n_name", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@_add("emb_06_materialize", "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(16 AS INTEGER) AS dimension, CAST(16 AS INTEGER) AS size FROM part")
def materialized(spark, d):
    rows = embedding.build_embedding_rows(_t(spark, d, "part").select("p_partkey", F.col("p_name").alias("title")), doc_id="p_partkey")
    return embedding.materialize_embeddings(rows, _folder(spark), dim=16).select("doc_id", "dimension", F.size("embedding").alias("size"))


@_add("emb_07_query")
def emb_query(spark, d):
    rows = embedding.build_embedding_rows(_t(spark, d, "part").select("p_partkey", "p_brand", F.col("p_name").alias("title")), doc_id="p_partkey")
    return embedding.query_embeddings(embedding.materialize_embeddings(rows, _folder(spark), dim=16), "title: red part", 5, where="p_brand IS NOT NULL", dim=16, tie="p_partkey").select("doc_id", "vector_score")


@_add("sea_01_overlap")
def overlap(spark, d):
    return embedding.overlap_search(_t(spark, d, "part"), "p_name", "small red part", 5, tie="p_partkey").select("p_partkey", "score")


@_add("sea_02_grounding")
def grounding(spark, d):
    return embedding.grounding_bundle({"part": (_t(spark, d, "part"), "p_name"), "nation": (_t(spark, d, "nation"), "n_name")}, "small part of France", 3)


# file sources


def _csv(spark, d, table: str, **options) -> str:
    path = f"{_folder(spark)}/{table}"
    files.save_csv(_t(spark, d, table).coalesce(1).select(*options.get("columns", ["*"])), path)
    return path


@_add("src_01_csv", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv(spark, d):
    return files.read_csv(spark, _csv(spark, d, "customer"))


@_add("src_02_line_split", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS id FROM nation")
def line_split(spark, d):
    path = f"{_folder(spark)}/lines"
    _t(spark, d, "nation").select(F.concat_ws("|", "n_nationkey", "n_name")).write.text(path)
    return files.read_line_file(spark, path, [("name", 1), ("id", 0)], "split", "|")


@_add("src_03_line_regex", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey >= 10")
def line_regex(spark, d):
    path = f"{_folder(spark)}/lines"
    _t(spark, d, "nation").select(F.concat(F.lit("id="), "n_nationkey", F.lit(" name="), "n_name")).write.text(path)
    return files.read_line_file(spark, path, [("id", 1), ("name", 2)], "regex", regex_pattern=r"^id=(\d\d) name=(.*)$")


@_add("src_04_json_lines", "SELECT vec_id, CAST(label AS BIGINT) AS label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 3) + 0.0 AS total FROM embeddings")
def json_lines(spark, d):
    path = f"{_folder(spark)}/objects"
    _t(spark, d, "embeddings").write.json(path)
    got = files.read_json(spark, path, ["vec_id", "embedding", "label"])
    return got.select("vec_id", "label", (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3) + 0.0).alias("total"))


@_add("src_05_json_array", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def json_array(spark, d):
    path = f"{_folder(spark)}/objects"
    one = _t(spark, d, "region").agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))))
    one.write.text(path)
    return files.read_json(spark, path, None, "json_array")


@_add("src_06_probe")
def probe(spark, d):
    got = files.probe(spark, _csv(spark, d, "nation"))
    return spark.createDataFrame([(got["kind"], got["format"], got["confidence"])], "kind string, format string, confidence string")


@_add("src_07_read", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def auto(spark, d):
    return files.read(spark, _csv(spark, d, "nation"))


@_add("src_08_arrow", "SELECT * FROM nation")
def arrow(spark, d):
    return files.from_arrow(spark, _t(spark, d, "nation").toArrow())


@_add("src_10_external_table", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def external(spark, d):
    s = Session(spark)
    s.sql(f"CREATE TABLE c USING csv OPTIONS(path: '{_csv(spark, d, 'customer')}', delimiter: ',')")
    return s.sql("SELECT c_nationkey, COUNT(*) AS n FROM c GROUP BY c_nationkey")


@_add("src_14_materialize", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def materialize(spark, d):
    path, root = _csv(spark, d, "region"), _folder(spark)
    s = Session(spark, materialize_dir=root)
    s.read_csv(path, materialize=True)
    return s.read_csv(path, materialize=True)


@_add("src_19_save_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def saved(spark, d):
    return files.read_csv(spark, _csv(spark, d, "supplier", columns=["s_suppkey", "s_name"]), infer_types=False)


# streams: each runs to its end, the last row of a key is compared


def _parts(spark, d) -> list[DataFrame]:
    """The events in four batches by time."""
    e = _t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return [e.where(F.col("event_id") % 4 == i) for i in range(4)]


def _rows(spark, sink: streams.MemorySink, schema, number: str | None = None) -> DataFrame:
    """What all batches emitted, as a table."""
    empty = spark.createDataFrame([], schema)
    return sink.frame(number) if sink.batches else empty.withColumn(number, F.lit(0).cast("long")) if number else empty


def _last(spark, sink: streams.MemorySink, keys: list[str], schema) -> DataFrame:
    """The row that the last batch emitted for each key."""
    rows = _rows(spark, sink, schema, "__batch")
    values = [c for c in rows.columns if c not in keys and c != "__batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "__batch").alias("__last")).select(*keys, "__last.*")


@_add("stm_op_07_running", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def running(spark, d):
    sink = streams.MemorySink()
    s = streams.Stream(spark, streams.MemorySource(spark, _parts(spark, d))).group_by(["event_type"]).agg(
        [("COUNT", None, "n"), ("SUM", "value", "total"), ("MIN", "value", "low"), ("MAX", "value", "high"), ("AVG", "value", "mean")], stateful=True
    )
    s.start(sink).await_termination()
    out = _last(spark, sink, ["event_type"], "event_type string, n long, total double, low double, high double, mean double")
    return _round(_round(out, "total", places=2), "low", "high", "mean")


@_add("stm_op_04_window_count", "SELECT strftime(to_timestamp((epoch_us(ts) // 1000) // 86400000 * 86400) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed(spark, d):
    sink = streams.MemorySink()
    streams.Stream(spark, streams.MemorySource(spark, _parts(spark, d))).window("ts", 86_400_000).group_by(["window_start", "event_type"]).count("n", stateful=True).start(sink).await_termination()
    return _last(spark, sink, ["window_start", "event_type"], "window_start string, event_type string, n long")


@_add("stm_op_01_rowwise", "SELECT event_id, upper(event_type) AS kind FROM events WHERE value > 50")
def rowwise(spark, d):
    sink = streams.MemorySink()
    s = streams.Stream(spark, streams.MemorySource(spark, _parts(spark, d))).filter("value", ">", 50).with_column("kind", function="UPPER", args=[Ref("event_type")]).select(["event_id", "kind"])
    s.start(sink).await_termination()
    return _rows(spark, sink, "event_id long, kind string")


@_add("stm_op_06_per_batch", "SELECT event_id % 4 AS batch, event_type, count(*) AS n FROM events GROUP BY ALL")
def per_batch(spark, d):
    sink = streams.MemorySink()
    s = streams.Stream(spark, streams.MemorySource(spark, _parts(spark, d))).transform(lambda df: df.withColumn("batch", F.col("event_id") % 4)).group_by(["batch", "event_type"]).count("n")
    s.start(sink).await_termination()
    return _rows(spark, sink, "batch long, event_type string, n long")


@_add("stm_sql_02_insert", "SELECT user_id, round(sum(value), 2) AS total FROM events WHERE value > 6 GROUP BY 1 HAVING sum(value) > 100")
def stream_insert(spark, d):
    folder, out = _folder(spark), f"{_folder(spark)}/out.csv"
    e = _t(spark, d, "events").select("user_id", "value")
    e.coalesce(1).write.option("header", True).csv(f"{folder}/w")
    os.makedirs(f"{folder}/in")
    for f in os.listdir(f"{folder}/w"):
        if f.endswith(".csv"):
            os.replace(f"{folder}/w/{f}", f"{folder}/in/{f}")
    s = Session(spark)
    s.sql(f"CREATE SOURCE TABLE src (user_id INT, value DOUBLE) USING csv OPTIONS(path: '{folder}/in', delimiter: ',')")
    s.sql(f"CREATE SINK TABLE snk (user_id INT, total DOUBLE) USING csv OPTIONS(path: '{out}', delimiter: ',')")
    s.start_stream_sql("INSERT INTO snk SELECT user_id, SUM(value) AS total FROM src WHERE value > 6 GROUP BY user_id HAVING total > 100").await_termination()
    got = spark.read.option("header", True).schema("user_id long, total double").csv(out)
    return _round(got.groupBy("user_id").agg(F.max("total").alias("total")), "total", places=2)


@_add("stm_sql_03_explain")
def stream_explain(spark, d):
    folder = _folder(spark)
    files.save_csv(_t(spark, d, "nation").coalesce(1), f"{folder}/in")
    s = Session(spark)
    s.sql(f"CREATE SOURCE TABLE src (n_nationkey INT, n_name STRING, n_regionkey INT) USING csv OPTIONS(path: '{folder}/in')")
    return spark.createDataFrame([(s.explain_stream_sql("SELECT n_regionkey, COUNT(*) AS n FROM src GROUP BY n_regionkey"),)], "plan string")


# monitors


@_add("mon_02_read_events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10'")
def read_events(spark, d):
    e = _t(spark, d, "events").withColumn("event_time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return events.between(e, "2024-01-03T00:00:00", "2024-01-10T00:00:00").select("event_id")


for _kind, _spec, _oracle in (
    ("threshold", {"table": "events", "field": "value", "op": ">", "value": 90}, "SELECT event_id FROM events WHERE value > 90"),
    ("window_count", {"table": "events", "group_by": ["user_id"], "min_count": 12}, "SELECT user_id, count(*) AS event_count FROM events GROUP BY 1 HAVING count(*) >= 12"),
    ("ranking", {"table": "events", "field": "value", "top_k": 5, "tie": "event_id"}, "SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 5"),
):

    def _monitor(spark, d, kind=_kind, spec=_spec):
        _t(spark, d, "events").createOrReplaceTempView("events")
        out = spark.sql(dsl.template_sql(kind, spec))
        return out if kind == "window_count" else out.select("event_id")

    _add(f"mon_03_{_kind}", _oracle)(_monitor)


@_add("mon_03_change", "SELECT user_id, round(abs(b - a), 4) AS delta FROM (SELECT user_id, sum(value) FILTER (event_id % 2 = 0) AS a, sum(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1) WHERE abs(b - a) >= 100")
def change(spark, d):
    e = _t(spark, d, "events")
    e.where("event_id % 2 = 0").groupBy("user_id").agg(F.sum("value").alias("x")).createOrReplaceTempView("previous_snapshot")
    e.where("event_id % 2 = 1").groupBy("user_id").agg(F.sum("value").alias("x")).createOrReplaceTempView("current_snapshot")
    return spark.sql(dsl.template_sql("change", {"key": "user_id", "field": "x", "delta": 100})).select("user_id", F.round("delta", 4).alias("delta"))


@_add("mon_04_condition", "SELECT event_id FROM events WHERE (event_type IN ('click', 'view') AND value >= 80) OR NOT value > 2 OR (SELECT count(*) FROM events) >= 1000000000")
def monitor_condition(spark, d):
    tree = {"any": [{"all": [{"field": "event_type", "op": "in", "value": ["click", "view"]}, {"field": "value", "op": ">=", "value": 80}]}, {"not": {"field": "value", "op": ">", "value": 2}}, {"min_rows": 1_000_000_000}, {"all": [{"not": {"min_rows": 1}}]}]}
    e = _t(spark, d, "events")
    return e.where(dsl.condition(tree, e.count())).select("event_id")


@_add("run_02_diff", "SELECT n_nationkey, 'removed' AS change FROM nation WHERE n_nationkey < 2 UNION ALL SELECT n_nationkey, 'added' FROM nation WHERE n_nationkey >= 23")
def run_diff(spark, d):
    from ..runs import diff

    n = _t(spark, d, "nation").select("n_nationkey")
    return diff(n.where("n_nationkey < 23"), n.where("n_nationkey >= 2"))

_STREAM_COLS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


@_add("stm_op_05_sliding", "SELECT strftime(to_timestamp(w / 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS window_start, count(*) AS n FROM (SELECT unnest([epoch_us(ts) // 1000 // 43200000 * 43200000 - i * 43200000 for i in [0, 1]]) AS w FROM events) GROUP BY 1")
def sliding(spark, d):
    sink = streams.MemorySink()
    streams.Stream(spark, streams.MemorySource(spark, _parts(spark, d))).window("ts", 86_400_000, slide_ms=43_200_000).group_by(["window_start"]).count("n", stateful=True).start(sink).await_termination()
    return _last(spark, sink, ["window_start"], "window_start string, n long")


_SPLITS = ("2024-01-08 12:00:00", "2024-01-15 12:00:00", "2024-01-22 12:00:00")


@_add(
    "stm_op_11_retained_windows",
    # the first batch comes again at the end, when its windows' state is gone: they start anew
    f"SELECT strftime(to_timestamp(epoch_us(ts) // 86400000000 * 86400) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS window_start, count(*) AS n, round(max(value), 6) AS high FROM events "
    f"WHERE ts < TIMESTAMP '{_SPLITS[0]}' OR ts >= TIMESTAMP '{_SPLITS[0][:10]}' + INTERVAL 1 DAY GROUP BY 1",
)
def retained(spark, d):
    e = _t(spark, d, "events")
    bounds = [None, *_SPLITS, None]
    parts = [e.where(" AND ".join(["true", *([f"ts >= '{a}'"] if a else []), *([f"ts < '{b}'"] if b else [])])) for a, b in zip(bounds, bounds[1:], strict=False)]
    sink = streams.MemorySink()
    s = streams.Stream(spark, streams.MemorySource(spark, [*parts, parts[0]])).window("ts", 86_400_000).group_by(["window_start"])
    s.agg([("COUNT", None, "n"), ("MAX", "value", "high")], stateful=True, max_retained_windows=2).start(sink).await_termination()
    return _round(_last(spark, sink, ["window_start"], "window_start string, n long, high double"), "high")


@_add("stm_op_02_limit", "SELECT b AS batch, CAST(5 AS BIGINT) AS n FROM (VALUES (CAST(0 AS BIGINT)), (1), (2), (3)) t(b)")
def stream_limit(spark, d):
    sink = streams.MemorySink()
    streams.Stream(spark, streams.MemorySource(spark, _parts(spark, d))).limit(5).start(sink).await_termination()
    return _rows(spark, sink, _STREAM_COLS).groupBy((F.col("event_id") % 4).alias("batch")).agg(F.count(F.lit(1)).alias("n"))


@_add("stm_op_03_order_by", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_id % 4 ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3")
def stream_order(spark, d):
    sink = streams.MemorySink()
    streams.Stream(spark, streams.MemorySource(spark, _parts(spark, d))).order_by(["value", "event_id"], [False, True]).limit(3).start(sink).await_termination()
    return _rows(spark, sink, _STREAM_COLS).select("event_id")


@_add("stm_op_17_progress")
def progress(spark, d):
    q = streams.Stream(spark, streams.MemorySource(spark, _parts(spark, d))).start(streams.MemorySink())
    q.await_termination()
    return spark.createDataFrame([(q.snapshot_json(),)], "progress string")


@_add("mon_05_execute", "SELECT count(*) AS signals FROM events WHERE value > 99")
def monitor_run(spark, d):
    store = runtime.Store("")
    rule = store.save_rule({"name": "high", "template": "threshold", "parameters": {"table": "input", "field": "value", "op": ">", "value": 99}})
    return spark.createDataFrame([(runtime.execute_once(spark, store, rule, _t(spark, d, "events"))["signals"],)], "signals long")


@_add("mon_07_promotion", "SELECT event_id, CASE WHEN value > 99.5 THEN 'high' ELSE 'info' END AS severity FROM events WHERE value > 99")
def promotion(spark, d):
    store = runtime.Store("")
    spec = {"name": "high", "sql": "SELECT event_id, value FROM input WHERE value > 99 ORDER BY event_id", "promotion": {"title": "{event_id}", "severity_rules": [{"when": {"field": "value", "op": ">", "value": 99.5}, "severity": "high"}]}}
    runtime.execute_once(spark, store, store.save_rule(spec), _t(spark, d, "events"))
    return store.focus_frame(spark).select(F.col("title").cast("long").alias("event_id"), "severity")


@_add("join_03_full", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def full(spark, d):
    return rel.join(_t(spark, d, "supplier").select("s_suppkey"), _t(spark, d, "customer").select("c_custkey"), "s_suppkey", "c_custkey", "full")


@_add("stm_src_03_queue", "SELECT event_id, value FROM events")
def stream_queue(spark, d):
    e = _t(spark, d, "events").select("event_id", "value")
    q = streams.QueueSource(spark, e.schema, files=spark.sparkContext.defaultParallelism)
    few = F.coalesce(F.col("event_id").between(0, 999), F.lit(False))  # what a driver would push itself; the rest stays on executors
    q.push_arrow(e.where(few & (F.col("event_id") % 2 == 0)).toArrow())
    q.push_rows([tuple(r) for r in e.where(few & (F.col("event_id") % 2 == 1)).collect()])
    q.push(e.where(~few))
    q.close()
    sink = streams.MemorySink()
    streams.Stream(spark, q).start(sink).await_termination()
    return _rows(spark, sink, "event_id long, value double")


@_add("stm_snk_02_file_append", "SELECT event_id, event_type FROM events")
def stream_file(spark, d):
    out = f"{_folder(spark)}/out.csv"
    parts = [p.select("event_id", "event_type") for p in _parts(spark, d)]
    streams.Stream(spark, streams.MemorySource(spark, parts)).start(streams.FileAppendSink(out)).await_termination()
    return spark.read.option("header", True).schema("event_id long, event_type string").csv(out)


def _restarted(spark, d, **how):
    source, at, out = streams.MemorySource(spark, [p.select("event_id") for p in _parts(spark, d)]), _folder(spark), f"{_folder(spark)}/out.csv"
    for most in (1, None):
        streams.Stream(spark, source).start(streams.FileAppendSink(out), checkpoint=at, **how).await_termination(max_batches=most)
    return spark.read.option("header", True).schema("event_id long").csv(out).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@_add("stm_op_15_at_least_once", "SELECT event_id, count(*) AS n FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 4 = 0) GROUP BY 1")
def replayed(spark, d):
    return _restarted(spark, d)


@_add("stm_op_16_best_effort", "SELECT event_id, CAST(1 AS BIGINT) AS n FROM events")
def resumed(spark, d):
    return _restarted(spark, d, delivery="best-effort")


@_add("key_05_build_index", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY 1")
def build_index(spark, d):
    path = keyword.build_keyword_index([_t(spark, d, "documents").select("doc_id", "text")], ["text"], _folder(spark), doc_id_field="doc_id")
    return spark.read.parquet(f"{path}/terms")


@_add("mon_01_ingest", "SELECT CAST(event_id AS VARCHAR) AS source_key, event_type FROM events")
def ingest(spark, d):
    e = _t(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", "ts")).alias("payload_json"))
    root = _folder(spark)
    events.ingest(events.normalize(e, "feed", {"event_time": "ts", "event_type": "event_type", "source_key": "event_id"}), root)
    return events.read(spark, root, "feed").select("source_key", "event_type")


@_add("job_01_submit", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def submitted(spark, d):
    s = Session(spark)
    s.create_temp_view("orders", _t(spark, d, "orders"))
    rows = s.submit("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", retries=1).result()
    return spark.createDataFrame([tuple(r) for r in rows], "o_orderstatus string, n long")


@_add("ext_02_plugin_rewrite", "SELECT r_name FROM region")
def rewritten(spark, d):
    s = Session(spark)
    s.create_temp_view("region", _t(spark, d, "region"))
    s.plugins.register(Plugin("rename", {"before_parse": lambda c: Outcome(sql=c["sql"].replace("areas", "region"))}))
    return s.sql("SELECT r_name FROM areas")


@_add("ext_03_catalog_search")
def capability_search(spark, d):
    return spark.createDataFrame([(e["kind"], e["name"]) for e in capabilities.search("nearest vectors of a subset")], "kind string, name string")


def _extended(name: str, text: str, oracle: str, tables: str) -> None:
    """A statement beyond the dialect, forwarded to Spark SQL."""

    def run(spark, d):
        s = Session(spark, extended=True)
        for t in tables.split():
            s.create_temp_view(t, _t(spark, d, t))
        return s.sql(text)

    _add(name, oracle)(run)


_extended("win_01_analytic_extended", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer", "customer")
_extended("flt_08_extended", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9 AND p_name LIKE '%a%' AND p_brand IS NOT NULL", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9 AND p_name LIKE '%a%' AND p_brand IS NOT NULL", "part")
_extended("sql_cte_extended", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10) SELECT c_name, n FROM big JOIN customer ON c_custkey = o_custkey", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10) SELECT c_name, n FROM big JOIN customer ON c_custkey = o_custkey", "orders customer")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
