"""The SQL dialect: golden values and the four kinds of error."""

import pytest

from brightloom.plans.errors import SqlError, SqlSemanticError, SqlSyntaxError, SqlTableKindError, SqlUnsupportedError
from brightloom.plugins import Outcome, Plugin, PluginBlocked
from brightloom.session import Session


@pytest.fixture
def s(spark):
    s = Session(spark)
    s.sql("CREATE TABLE users (user_id INT, region STRING, score INT)")
    s.sql("INSERT INTO users VALUES (1, 'apac', 25), (2, 'emea', 18), (3, 'na', 34)")
    s.sql("CREATE TABLE users_archive (user_id INT, region STRING, score INT)")
    s.sql("INSERT INTO users_archive VALUES (2, 'emea', 18), (4, 'latam', 21)")
    s.sql("CREATE TABLE actions (user_id INT, action_name STRING)")
    s.sql("INSERT INTO actions VALUES (1, 'view'), (1, 'buy'), (3, 'view')")
    s.sql("CREATE TABLE mixed (id INT, label STRING, flag BOOL, amount DOUBLE, missing STRING)")
    s.sql("INSERT INTO mixed VALUES (1, 'a', TRUE, 3.5, NULL), (2, 'b', FALSE, 4.25, NULL)")
    s.sql("CREATE TABLE prices (trade_date STRING, open DOUBLE, close DOUBLE, open_text STRING)")
    s.sql("INSERT INTO prices VALUES ('2026-01-01', 10.25, 9.75, '10.25'), ('2026-01-02', 8.50, 8.75, '8.50'), ('2026-01-03', 7.10, 6.05, '7.10')")
    return s


def values(df):
    return [tuple(r) for r in df.collect()]


GOLDEN = [
    ("SELECT region, score FROM users WHERE score > 20 ORDER BY score DESC", [("na", 34), ("apac", 25)]),
    ("SELECT * FROM users ORDER BY user_id LIMIT 1", [(1, "apac", 25)]),
    ("SELECT region, SUM(score) AS total FROM users GROUP BY region HAVING total > 20 ORDER BY region", [("apac", 25.0), ("na", 34.0)]),
    ("SELECT COUNT(*) AS n FROM users WHERE score > 1000", []),
    ("SELECT user_id FROM users UNION ALL SELECT user_id FROM users_archive", [(1,), (2,), (3,), (2,), (4,)]),
    ("SELECT user_id, region FROM users WHERE (region = 'apac' OR region = 'na') AND NOT score = 34", [(1, "apac")]),
    ("SELECT id FROM mixed WHERE missing = NULL ORDER BY id", [(1,), (2,)]),
    ("SELECT id FROM mixed WHERE flag = TRUE", [(1,)]),
    ("SELECT id FROM mixed WHERE label = 1", []),
    ("SELECT trade_date FROM prices WHERE open > close ORDER BY trade_date", [("2026-01-01",), ("2026-01-03",)]),
    ("SELECT LEFT(CAST(open AS STRING), 4) AS p FROM prices WHERE trade_date = '2026-01-01'", [("10.2",)]),
    ("SELECT CAST(open_text AS DOUBLE) AS v FROM prices WHERE trade_date = '2026-01-01'", [(10.25,)]),
    ("SELECT UPPER(region) AS a, TRIM('  spaced  ') AS b, CONCAT(region, '-', user_id) AS c, SUBSTR(region, 2, 2) AS d, LEFT(region, 2) AS e, RIGHT(region, 2) AS f, POSITION('a', region) AS g, REVERSE(region) AS h, REPLACE(region, 'a', 'A') AS i, LEN(region) AS j FROM users WHERE user_id = 1",
     [("APAC", "spaced", "apac-1", "pa", "ap", "ac", 1, "capa", "ApAc", 4)]),
    ("SELECT UNIX_TIMESTAMP('2026-01-01') AS t, LENGTH(TODAY()) AS n", [(1767225600, 10)]),
    ("SELECT YEAR('1767225600000') AS y, YEARWEEK('2026-01-01') AS w, ISO_YEAR('2027-01-01') AS i, WEEK('2027-01-01') AS k", [(2026, 202601, 2026, 53)]),
    ("SELECT CONCAT('a', NULL) AS a, CONCAT_WS('-', 'a', NULL, 'b') AS b, SUBSTR('abc', 0, 2) AS c, SUBSTR('abc', 9) AS d, LEFT('abc', -1) AS e", [(None, None, "ab", "", "")]),
    ("SELECT ABS(-1.5) AS a, CEIL(1.2) AS b, FLOOR(-1.2) AS c, ROUND(2.5) AS d, ROUND(-2.5) AS e, CAST(2.9 AS INT) AS f, CAST('yes' AS BOOL) AS g, CAST('1' AS BOOL) AS h", [(1.5, 2.0, -2.0, 3.0, -3.0, 2, False, True)]),
    ("SELECT MIN(region) AS lo, MAX(score) AS hi, AVG(score) AS mean, COUNT(region) AS n FROM users", [("apac", 34, 77 / 3, 3)]),
]


@pytest.mark.parametrize("text,want", GOLDEN)
def test_golden(s, text, want):
    got = values(s.sql(text))
    assert (got if "ORDER BY" in text else sorted(got, key=repr)) == (want if "ORDER BY" in text else sorted(want, key=repr))


def test_union_and_joins(s):
    assert len(values(s.sql("SELECT user_id, region, score FROM users UNION SELECT user_id, region, score FROM users_archive"))) == 4
    got = values(s.sql("SELECT u.user_id AS id, a.action_name AS act FROM users u LEFT JOIN actions a ON u.user_id = a.user_id"))
    assert sorted(got, key=repr) == sorted([(1, "view"), (1, "buy"), (2, None), (3, "view")], key=repr)
    assert s.sql("SELECT u.*, a.action_name FROM users u INNER JOIN actions a ON a.user_id = u.user_id").columns == ["u.user_id", "u.region", "u.score", "action_name"]


def test_union_tells_delimiters_apart(s, spark):
    s.create_temp_view("l", spark.createDataFrame([("alpha\x1fbeta", "gamma")], "a string, b string"))
    s.create_temp_view("r", spark.createDataFrame([("alpha", "beta\x1fgamma")], "a string, b string"))
    assert len(values(s.sql("SELECT a, b FROM l UNION SELECT a, b FROM r"))) == 2


def test_default_names(s):
    assert s.sql("SELECT LOWER(region), LENGTH(region), user_id FROM users").columns == ["lower_region", "length_region", "user_id"]
    assert s.sql("SELECT region, SUM(score), COUNT(*), AVG(score) FROM users GROUP BY region").columns == ["region", "sum_score", "count", "avg_score"]
    assert s.sql("SELECT 1, 'x', UPPER('y'), NOW()").columns == ["expr1", "expr2", "upper_y", "now_4"]


def test_unicode_identifiers(s, spark):
    s.create_temp_view("cn", spark.createDataFrame([("杭州", "北京"), ("杭州", "上海"), ("深圳", "广州")], '`始发市` string, `目的市` string'))
    got = values(s.sql('SELECT "目的市" FROM cn WHERE "始发市" = \'杭州\''))
    assert sorted(got) == sorted([("北京",), ("上海",)])


def test_insert(s):
    status = s.sql("INSERT INTO users (region, user_id) VALUES ('x', 9)").first()
    assert tuple(status) == (True, "inserted", 1)
    assert values(s.sql("SELECT region, score FROM users WHERE user_id = 9")) == [("x", None)]
    s.sql("INSERT INTO users_archive SELECT user_id, LOWER(region), score FROM users WHERE score > 30")
    assert len(values(s.sql("SELECT * FROM users_archive"))) == 3


BAD = [
    ("SELECT user_id FROM users WHERE SUM(score) > 1", SqlUnsupportedError, "aggregate"),
    ("SELECT user_id, SUM(score) FROM users GROUP BY region", SqlSemanticError, "grouped"),
    ("SELECT nope FROM users", SqlSemanticError, "column not found"),
    ("SELECT user_id FROM users WHERE score = nope", SqlSemanticError, "column not found"),
    ("SELECT *, region FROM users", SqlUnsupportedError, "SELECT *"),
    ("SELECT u.user_id FROM users u JOIN actions a ON u.user_id > a.user_id", SqlUnsupportedError, "non-equality"),
    ("SELECT user_id FROM users u JOIN actions a ON u.user_id = a.user_id", SqlSemanticError, "ambiguous column"),
    ("SELECT user_id FROM users UNION ALL SELECT user_id, region FROM users", SqlSemanticError, "same column count"),
    ("SELECT user_id FROM users UNION ALL SELECT user_id FROM users ORDER BY user_id", SqlUnsupportedError, "UNION"),
    ("SELECT user_id FROM users INTERSECT SELECT user_id FROM users", SqlUnsupportedError, "INTERSECT"),
    ("SELECT user_id FROM users EXCEPT SELECT user_id FROM users", SqlUnsupportedError, "EXCEPT"),
    ("SELECT DISTINCT region FROM users", SqlUnsupportedError, "DISTINCT"),
    ("SELECT COUNT(DISTINCT region) FROM users", SqlUnsupportedError, "DISTINCT"),
    ("SELECT STDDEV(score) FROM users", SqlUnsupportedError, "aggregate function STDDEV"),
    ("SELECT user_id FROM users LIMIT 1 + 1", SqlUnsupportedError, "LIMIT"),
    ("SELECT user_id + 1 FROM users", SqlUnsupportedError, "arithmetic"),
    ("SELECT user_id FROM users WHERE region LIKE 'a%'", SqlUnsupportedError, "LIKE"),
    ("SELECT user_id FROM users WHERE user_id IN (1)", SqlUnsupportedError, "IN"),
    ("SELECT user_id FROM users WHERE region IS NULL", SqlUnsupportedError, "IS NULL"),
    ("SELECT user_id FROM users WHERE score = 1 + 1", SqlUnsupportedError, "right side"),
    ("SELECT user_id FROM users WHERE NOT (score = 1 AND score = 2)", SqlUnsupportedError, "NOT"),
    ("SELECT ROW_NUMBER() OVER (ORDER BY score) FROM users", SqlError, "not supported"),
    ("WITH x AS (SELECT 1) SELECT * FROM x", SqlUnsupportedError, "CTE"),
    ("SELECT * FROM (SELECT 1)", SqlUnsupportedError, "subquery"),
    ("SELECT NOPE(region) FROM users", SqlUnsupportedError, "function NOPE"),
    ("SELECT LEFT(region) FROM users", SqlSyntaxError, "LEFT expects"),
    ("SELECT 1 FROM users", SqlUnsupportedError, "literal projection"),
    ("SELECT region FROM users GROUP BY region", SqlSemanticError, "aggregate"),
    ("SELECT SUM(region) AS x FROM users", SqlSemanticError, "not numeric"),
    ("SELECT region FROM users ORDER BY score", SqlSemanticError, "ORDER BY"),
    ("SELECT region FROM users OFFSET 3", SqlUnsupportedError, "OFFSET"),
    ("SELECT SUM(score) AS a, MAX(score) AS a FROM users", SqlSemanticError, "duplicate alias"),
    ("SELECT region, COUNT(*) AS n FROM users WINDOW BY score EVERY 60000 AS w GROUP BY region", SqlUnsupportedError, "WINDOW BY"),
    ("SELECT region FROM users u JOIN actions a ON u.user_id = a.user_id HYBRID SEARCH score QUERY '[1 0]'", SqlUnsupportedError, "does not support JOIN"),
    ("SELECT region, COUNT(*) AS n FROM users HYBRID SEARCH score QUERY '[1 0]' GROUP BY region", SqlUnsupportedError, "does not support aggregate"),
    ("INSERT INTO users VALUES (1)", SqlSemanticError, "count mismatch"),
    ("INSERT INTO users (nope) VALUES (1)", SqlSemanticError, "not found"),
    ("INSERT INTO users (region, region) VALUES ('a', 'b')", SqlSyntaxError, "duplicate"),
    ("INSERT INTO users VALUES (1 + 1, 'a', 2)", SqlUnsupportedError, "arithmetic"),
    ("UPDATE users SET score = 1", SqlUnsupportedError, "unsupported SQL statement"),
    ("SELEC 1", SqlSyntaxError, "syntax error"),
    ("SELECT 城 FROM users", SqlUnsupportedError, "non-ASCII"),
    ("CREATE TABLE users (a INT)", SqlSemanticError, "exists"),
    ("CREATE TABLE x USING parquet OPTIONS(path: 'y')", SqlSyntaxError, "csv, line, or json"),
]


@pytest.mark.parametrize("text,kind,part", BAD)
def test_errors(s, text, kind, part):
    with pytest.raises(kind, match=None) as e:
        s.sql(text)
    assert part in str(e.value)


def test_table_kinds(s, tmp_path):
    (tmp_path / "in").mkdir()
    s.sql(f"CREATE SOURCE TABLE src (a INT) USING csv OPTIONS(path: '{tmp_path}/in', delimiter: ',')")
    s.sql(f"CREATE SINK TABLE snk (a INT) USING csv OPTIONS(path: '{tmp_path}/out.csv')")
    for text, part in (("INSERT INTO src VALUES (1)", "read-only"), ("SELECT * FROM snk", "SINK"), ):
        with pytest.raises(SqlTableKindError, match=part):
            s.sql(text)
    with pytest.raises(SqlTableKindError):
        s.create_temp_view("snk", s.spark.range(1))
    s.sql("INSERT INTO snk SELECT user_id FROM users WHERE user_id = 1")
    assert (tmp_path / "out.csv").read_text() == "user_id\n1\n"


def test_external_tables(s, tmp_path):
    (tmp_path / "t.csv").write_text('id,name,code\n1,"a,b",007\n2,c\n3,"say ""hi""",042\n')
    s.sql(f"CREATE TABLE t USING csv OPTIONS(path: '{tmp_path}/t.csv')")
    assert values(s.sql("SELECT id, name, code FROM t ORDER BY id")) == [(1, "a,b", "007"), (3, 'say "hi"', "042")]
    (tmp_path / "l.txt").write_text("1001|ok|12.5\n1002|fail|9.5\n")
    s.sql(f"CREATE TABLE l (user_id INT, state STRING, score DOUBLE) USING line OPTIONS(path: '{tmp_path}/l.txt', mode: 'split', split_delimiter: '|')")
    assert values(s.sql("SELECT state FROM l WHERE score > 10")) == [("ok",)]
    with pytest.raises(SqlSemanticError):
        s.sql(f"CREATE TABLE bad (x INT) USING csv OPTIONS(path: '{tmp_path}/t.csv')")


def test_extended_mode_forwards_to_spark(spark):
    s = Session(spark, extended=True)
    s.create_temp_view("nums", spark.range(5))
    assert values(s.sql("SELECT sum(id + 1) AS t FROM nums WHERE id IN (1, 2)")) == [(5,)]


def test_explain_has_three_sections(s):
    text = s.explain_sql("SELECT region, COUNT(*) AS n FROM users WHERE score > 1 GROUP BY region ORDER BY n LIMIT 2")
    assert [x for x in text.split("\n") if x in ("logical", "physical", "strategy")] == ["logical", "physical", "strategy"]


def test_plugins(s):
    s.plugins.register(Plugin("rewrite", {"before_parse": lambda c: Outcome(sql=c["sql"].replace("everyone", "users"))}))
    assert len(values(s.sql("SELECT user_id FROM everyone"))) == 3
    s.plugins.register(Plugin("guard", {"before_parse": lambda c: Outcome("block", reason="no archive") if "archive" in c["sql"] else None}, priority=5))
    with pytest.raises(PluginBlocked, match="no archive"):
        s.sql("SELECT * FROM users_archive")
    s.plugins.unregister("guard")
    s.plugins.register(Plugin("bad", {"after_parse": lambda c: 1 / 0}, auto_disable_after=1))
    s.sql("SELECT user_id FROM users")
    assert not next(p for p in s.plugins.plugins if p.name == "bad").enabled


def test_jobs(s):
    assert s.submit("SELECT user_id FROM users WHERE user_id = 2", tag="t1").result(60)[0][0] == 2


def test_keyword_then_hybrid(s, spark):
    rows = [(10, "payment timeout", "gateway timeout on payment", "open", [1.0, 0.0, 0.0]), (20, "payment delayed", "late", "open", [0.9, 0.1, 0.0]), (30, "refund", "payment timeout", "closed", [0.0, 1.0, 0.0])]
    s.create_temp_view("docs", spark.createDataFrame(rows, "id int, title string, body string, status string, embedding array<float>"))
    assert values(s.sql("SELECT id FROM docs WHERE status = 'open' KEYWORD SEARCH(title, body) QUERY 'payment timeout' TOP_K 2"))[0] == (10,)
    got = values(s.sql("SELECT id FROM docs WHERE status = 'open' KEYWORD SEARCH(title, body) QUERY 'payment timeout' TOP_K 2 HYBRID SEARCH embedding QUERY '[0.9 0.1 0]' METRIC cosine TOP_K 1"))
    assert got == [(20,)]
