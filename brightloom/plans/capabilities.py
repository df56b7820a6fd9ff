"""What the SQL dialect can do, as data: its clauses, functions and query patterns, and a keyword search over them."""

from __future__ import annotations

import re

from ..functions import aggregates, scalar

CLAUSES = {
    "SELECT": "columns, alias.*, *, scalar functions, aggregates; AS names them", "JOIN": "one INNER or LEFT JOIN on one equality", "WHERE": "comparisons with AND, OR, NOT; = NULL finds nulls",
    "GROUP BY": "columns or scalar functions of them", "HAVING": "aggregates in SELECT, or their names", "ORDER BY": "output columns; nulls last", "LIMIT": "an integer", "UNION": "UNION and UNION ALL by position",
    "KEYWORD SEARCH": "KEYWORD SEARCH(columns) QUERY 'text' TOP_K n: BM25", "HYBRID SEARCH": "HYBRID SEARCH column QUERY '[..]' METRIC m TOP_K n SCORE_THRESHOLD x: vectors after the filter",
    "WINDOW BY": "streams: WINDOW BY column EVERY ms SLIDE ms AS name", "CREATE TABLE": "in memory, or USING csv, line or json OPTIONS(path: ...); SOURCE and SINK for streams", "INSERT": "VALUES of literals, or SELECT by position",
}
LEFT_OUT = ("CTE", "subquery", "SELECT DISTINCT", "INTERSECT", "EXCEPT", "window functions", "arithmetic", "LIKE", "IN", "BETWEEN", "IS NULL", "CASE", "RIGHT or FULL JOIN")
PATTERNS = {
    "filter and sort": "SELECT a, b FROM t WHERE a > 1 ORDER BY b DESC LIMIT 10", "totals by group": "SELECT k, SUM(v) AS total FROM t GROUP BY k HAVING total > 10",
    "lookup with misses": "SELECT l.id AS id, r.name AS name FROM l LEFT JOIN r ON l.id = r.id", "nearest vectors of a subset": "SELECT id, vector_score FROM t WHERE kind = 'x' HYBRID SEARCH embedding QUERY '[1 0]' TOP_K 5",
    "text search": "SELECT id, keyword_score FROM t KEYWORD SEARCH(title, body) QUERY 'words' TOP_K 10", "counts in a window of a stream": "INSERT INTO sink SELECT w, k, COUNT(*) AS n FROM src WINDOW BY ts EVERY 60000 AS w GROUP BY w, k",
}


def functions() -> list[dict]:
    """name, least and most arguments (None: any number), result type."""
    made = [{"name": n, "least": f.least, "most": f.most, "type": f.type.simpleString(), "kind": "scalar"} for n, f in scalar.FUNCTIONS.items()]
    made.append({"name": "CAST", "least": 2, "most": 2, "type": "|".join(sorted(set(scalar.CASTS))), "kind": "scalar"})
    return made + [{"name": n, "least": 1, "most": 1, "type": "bigint" if n == "COUNT" else "double", "kind": "aggregate"} for n in aggregates.NAMES]


def capabilities() -> dict:
    return {"clauses": CLAUSES, "left_out": LEFT_OUT, "functions": functions(), "patterns": PATTERNS}


def search(query: str, top_k: int = 5) -> list[dict]:
    """Functions, clauses and patterns that share most words with the query."""
    words = set(re.findall(r"[a-z0-9]+", query.lower()))
    entries = [{"kind": "function", "name": f["name"], "text": f"{f['name']} {f['type']}"} for f in functions()]
    entries += [{"kind": "clause", "name": n, "text": f"{n} {t}"} for n, t in CLAUSES.items()] + [{"kind": "pattern", "name": n, "text": f"{n} {t}"} for n, t in PATTERNS.items()]
    scored = [(len(words & set(re.findall(r"[a-z0-9]+", e["text"].lower().replace("_", " ")))), e) for e in entries]
    return [e for n, e in sorted(scored, key=lambda x: -x[0]) if n][:top_k]
