"""Every registered query of the library proper beside its DuckDB form, at the smallest size; and scalar functions by properties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brightloom.plans import catalog
from brightloom.session import Session
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    if name in catalog.oracle_sql():
        assert compare(df, con, catalog.oracle_sql()[name]) is None
    else:
        assert df.count() > 0


TEXT = st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.none() | TEXT, st.integers(-3, 9), st.integers(-3, 9)), min_size=1, max_size=20))
def test_string_functions(spark, rows):
    s = Session(spark)
    s.create_temp_view("t", spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, a int, b int"))
    got = s.sql("SELECT i, LENGTH(s) AS n, SUBSTR(s, a, b) AS sub, LEFT(s, a) AS l, RIGHT(s, a) AS r, TRIM(s) AS t, CONCAT(s, a) AS c, CONCAT_WS('-', s, 'x', s) AS w FROM t").collect()
    space = " \t\n\x0b\x0c\r"
    for r in got:
        s_, a, b = rows[r["i"]]
        if s_ is None:
            assert (r["n"], r["sub"], r["l"], r["r"], r["t"], r["c"], r["w"]) == (None,) * 7
            continue
        at = max(a, 1) - 1
        assert r["n"] == len(s_) and r["sub"] == s_[at : at + max(b, 0)] and r["l"] == s_[: max(a, 0)] and r["r"] == (s_[-a:] if a > 0 else "")
        assert r["t"] == s_.strip(space) and r["c"] == f"{s_}{a}" and r["w"] == f"{s_}-x-{s_}"
