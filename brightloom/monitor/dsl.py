"""Rule templates and the rule language of monitors. Conditions compile to Columns; nothing is evaluated as code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = ("threshold", "change", "ranking", "window_count")
_OPS = {
    "==": lambda c, v: c.eqNullSafe(v), "!=": lambda c, v: ~c.eqNullSafe(v), ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)), "not_in": lambda c, v: F.coalesce(~c.isin(list(v)), F.lit(True)),
}


def _name(n: str) -> str:
    return "`" + str(n).replace("`", "``") + "`"


def _literal(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def template_sql(kind: str, spec: dict) -> str:
    """Spark SQL of a rule template."""
    if kind == "threshold":
        op = {"==": "="}.get(spec["op"], spec["op"])
        if op not in ("=", "!=", ">", ">=", "<", "<="):
            raise ValueError(f"unsupported operator: {spec['op']}")
        return f"SELECT * FROM {_name(spec['table'])} WHERE {_name(spec['field'])} {op} {_literal(spec['value'])}"
    if kind == "ranking":
        tie = f", {_name(spec['tie'])}" if spec.get("tie") else ""
        return f"SELECT * FROM {_name(spec['table'])} ORDER BY {_name(spec['field'])} {'ASC' if spec.get('ascending') else 'DESC'} NULLS LAST{tie} LIMIT {int(spec.get('top_k', 10))}"
    if kind == "window_count":
        keys = ", ".join(map(_name, spec["group_by"]))
        return f"SELECT {keys}, count(*) AS event_count FROM {_name(spec['table'])} GROUP BY {keys} HAVING count(*) >= {int(spec['min_count'])}"
    if kind == "change":
        key, field = _name(spec["key"]), _name(spec["field"])
        now, before = _name(spec.get("current", "current_snapshot")), _name(spec.get("previous", "previous_snapshot"))
        return (
            f"SELECT c.*, p.{field} AS previous_value, abs(c.{field} - p.{field}) AS delta FROM {now} c JOIN {before} p ON c.{key} = p.{key} "
            f"WHERE abs(c.{field} - p.{field}) >= {_literal(spec['delta'])}"
        )
    raise ValueError(f"unknown template: {kind}")


def condition(tree: dict, rows: int = 0) -> Column:
    """A tree of all, any, not, min_rows and {field, op, value} as a Column. rows: how many rows the rule's SQL returned.

    A null differs from every value but null, is in no list, and meets no order comparison.
    """
    if "min_rows" in tree:
        return F.lit(rows >= int(tree["min_rows"]))
    if "all" in tree:
        return reduce(lambda a, b: a & b, (condition(t, rows) for t in tree["all"]), F.lit(True))
    if "any" in tree:
        return reduce(lambda a, b: a | b, (condition(t, rows) for t in tree["any"]), F.lit(False))
    if "not" in tree:
        return ~condition(tree["not"], rows)
    if tree.get("op") not in _OPS:
        raise ValueError(f"unsupported operator: {tree.get('op')}")
    return F.coalesce(_OPS[tree["op"]](F.col(_name(tree["field"])), tree["value"]), F.lit(False))


def asked_rows(tree: dict) -> int:
    """The largest min_rows anywhere in the tree: no more rows need be counted."""
    inner = [asked_rows(t) for k in ("all", "any") for t in tree.get(k, [])] + ([asked_rows(tree["not"])] if "not" in tree else [])
    return max([int(tree.get("min_rows", 0)), *inner])


def validate(spec: dict) -> list[str]:
    """What is wrong with a version 1 rule."""
    wrong = []
    if spec.get("version", "v1") not in ("v1", 1):
        wrong.append("version must be v1")
    if not spec.get("name"):
        wrong.append("name is missing")
    execution = spec.get("execution", {})
    if execution.get("mode", "batch") not in ("batch", "stream"):
        wrong.append("execution.mode must be batch or stream")
    if not spec.get("sql") and spec.get("template") not in TEMPLATES:
        wrong.append("sql or a known template is needed")
    if "promotion" in spec and not isinstance(spec["promotion"], dict):
        wrong.append("promotion must be an object")
    try:
        condition(spec.get("condition", {"all": []}))
    except (ValueError, KeyError, TypeError) as e:
        wrong.append(f"condition: {e}")
    return wrong


def compile_rule(spec: dict) -> dict:
    """The rule with its SQL, its condition's row bound and defaults filled in."""
    wrong = validate(spec)
    if wrong:
        raise ValueError("; ".join(wrong))
    execution = {"mode": "batch", "window_ms": 60_000, "slide_ms": 60_000} | spec.get("execution", {})
    return spec | {
        "sql": spec.get("sql") or template_sql(spec["template"], spec.get("parameters", {})), "execution": execution, "condition": spec.get("condition", {"min_rows": 1}),
        "promotion": {"severity": "info", "severity_rules": [], "title": "{name}", "summary": "", "key_fields": [], "cooldown_seconds": 0} | spec.get("promotion", {}),
    }


def fill(template: str, values: dict) -> str:
    """{field} replaced by its value; unknown fields stay."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], template)
