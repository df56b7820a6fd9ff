"""Statements to DataFrames. The order is scan, join, where, keyword, hybrid, window, group, having, project, order, limit, union."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates, scalar
from ..operators import keyword as keyword_op
from ..operators import relational as rel
from ..operators import vector
from .errors import SqlSemanticError, SqlUnsupportedError
from .parser import Aggregate, Call, Condition, Hybrid, Item, Keyword, Literal, Name, Query, Select, Star


def default_alias(node, position: int) -> str:
    """What an item without AS is called; position counts from 0."""
    if isinstance(node, Name):
        return node.name
    if isinstance(node, Literal):
        return f"expr{position + 1}"
    if isinstance(node, Aggregate):
        return "count" if node.name == "COUNT" or node.column is None else f"{node.name.lower()}_{node.column.name}"
    base = {"LEN": "length", "CHAR_LENGTH": "length", "CHARACTER_LENGTH": "length", "SUBSTRING": "substr", "CURRENT_DATE": "today", "CURRENTTIMESTAMP": "current_timestamp"}.get(node.name, node.name.lower())
    first = node.args[0] if node.args else None
    if isinstance(first, Name):
        return f"{base}_{first.qualifier}_{first.name}" if first.qualifier else f"{base}_{first.name}"
    if isinstance(first, Literal) and isinstance(first.value, str):
        return f"{base}_{first.value}"
    return f"{base}_{position + 1}"


class Scope:
    """The columns of the row source: (qualifier, name) to the name in df."""

    def __init__(self, df: DataFrame, sources: list[tuple[str, list[str], list[str]]]):
        self.df, self.sources = df, sources

    def find(self, n: Name) -> str:
        hits = [real for alias, names, reals in self.sources if not n.qualifier or n.qualifier == alias for name, real in zip(names, reals, strict=True) if name == n.name]
        if n.qualifier and all(n.qualifier != alias for alias, _, _ in self.sources):
            raise SqlSemanticError(f"unknown table or alias: {n.qualifier}")
        if not hits:
            raise SqlSemanticError(f"column not found: {n}")
        if len(hits) > 1:
            raise SqlSemanticError(f"ambiguous column: {n}")
        return hits[0]

    def expression(self, node) -> scalar.Arg:
        if isinstance(node, Name):
            return rel.expression(self.df, rel.Ref(self.find(node)))
        if isinstance(node, Literal):
            return rel.expression(self.df, node.value)
        if node.name == "CAST":
            kind = scalar.CASTS[node.args[1].value]
            return scalar.Arg(scalar.cast(self.expression(node.args[0]), kind), scalar.CAST_TYPES[kind])
        return scalar.call(node.name, *(self.expression(a) for a in node.args))

    def predicate(self, tree, resolve: Callable | None = None):
        """The tree over real column names."""
        if isinstance(tree, rel.Bool):
            return rel.Bool(tree.op, tuple(self.predicate(p, resolve) for p in tree.parts))
        left = resolve(tree.left) if resolve else self.find(tree.left)
        right = tree.right.value if isinstance(tree.right, Literal) else rel.Ref(resolve(tree.right) if resolve else self.find(tree.right))
        return rel.Compare(left, tree.op, right)


class Planner:
    """table(name) gives the DataFrame of a readable table, and raises for the others."""

    def __init__(self, table: Callable[[str], DataFrame], spark):
        self.table, self.spark = table, spark

    def query(self, q: Query) -> DataFrame:
        if q.unions:
            for s in (q.first, *(s for _, s in q.unions)):
                if s.order or s.limit is not None:
                    raise SqlUnsupportedError("ORDER BY or LIMIT with UNION")
                if s.hybrid or s.keyword or s.window:
                    raise SqlUnsupportedError("HYBRID SEARCH, KEYWORD SEARCH or WINDOW BY with UNION")
        out = self.select(q.first)
        for distinct, s in q.unions:
            other = self.select(s)
            if len(other.columns) != len(out.columns):
                raise SqlSemanticError("UNION inputs must have the same column count")
            out = rel.union(out, other, distinct)
        return out

    def select(self, s: Select) -> DataFrame:
        if s.window:
            raise SqlUnsupportedError("WINDOW BY in batch SQL")
        if s.table is None:
            return self._no_table(s)
        scope = self.scope(s)
        if s.where is not None:
            scope.df = rel.where(scope.df, scope.predicate(s.where))
        self._search(s, scope)
        grouped = bool(s.group) or any(isinstance(i.node, Aggregate) for i in s.items)
        if s.having is not None and not grouped:
            raise SqlSemanticError("HAVING needs GROUP BY or an aggregate")
        out = self.aggregate(s, scope) if grouped else self.project(s.items, scope)
        return self.finish(s, out)

    def finish(self, s: Select, out: DataFrame) -> DataFrame:
        if s.order:
            for key, _ in s.order:
                if key.name not in out.columns and str(key) not in out.columns:
                    raise SqlSemanticError(f"ORDER BY column must be in the output: {key}")
            names = [str(k) if str(k) in out.columns else k.name for k, _ in s.order]
            out = rel.order_by(out, names, [up for _, up in s.order])
        return out if s.limit is None else out.limit(s.limit)

    def _no_table(self, s: Select) -> DataFrame:
        if s.where is not None or s.group or s.having is not None or s.keyword or s.hybrid:
            raise SqlSemanticError("SELECT without FROM takes only literals and scalar functions")
        one = self.spark.range(1)
        scope, cols = Scope(one, []), []
        for i, item in enumerate(s.items):
            if isinstance(item.node, (Name, Star, Aggregate)):
                raise SqlSemanticError("SELECT without FROM takes only literals and scalar functions")
            cols.append(scope.expression(item.node).col.alias(item.alias or (f"expr{i + 1}" if isinstance(item.node, Literal) else default_alias(item.node, i))))
        return self.finish(s, one.select(*cols))

    def scope(self, s: Select) -> Scope:
        left = self.table(s.table.name)
        names = left.columns
        if s.join is None:
            return Scope(left, [(s.table.alias or s.table.name, names, names)])
        if s.hybrid or s.keyword:
            raise SqlUnsupportedError(f"{'HYBRID' if s.hybrid else 'KEYWORD'} SEARCH does not support JOIN")
        right = self.table(s.join.table.name)
        la, ra = s.table.alias or s.table.name, s.join.table.alias or s.join.table.name
        both = Scope(left, [(la, names, names), (ra, right.columns, right.columns)])

        def side(n: Name) -> tuple[str, str]:
            both.find(n)
            return next((alias, n.name) for alias, cols, _ in both.sources if n.name in cols and n.qualifier in ("", alias))

        (a, x), (b, y) = side(s.join.left), side(s.join.right)
        if {a, b} != {la, ra}:
            raise SqlSemanticError("JOIN must compare a column of each side")
        l_on, r_on = (x, y) if a == la else (y, x)
        joined = rel.join(left, right, l_on, r_on, s.join.how)
        return Scope(joined, [(la, names, joined.columns[: len(names)]), (ra, right.columns, joined.columns[len(names) :])])

    def _search(self, s: Select, scope: Scope) -> None:
        grouped = s.group or any(isinstance(i.node, Aggregate) for i in s.items)
        for what, clause in (("KEYWORD", s.keyword), ("HYBRID", s.hybrid)):
            if clause and grouped:
                raise SqlUnsupportedError(f"{what} SEARCH does not support aggregate")
        alias, names, reals = scope.sources[0]
        if isinstance(s.keyword, Keyword):
            scope.df = keyword_op.keyword_search(scope.df, [scope.find(c) for c in s.keyword.columns], s.keyword.query, s.keyword.top_k)
            scope.sources = [(alias, [*names, "keyword_score"], [*reals, "keyword_score"])]
            alias, names, reals = scope.sources[0]
        if isinstance(s.hybrid, Hybrid):
            h = s.hybrid
            scope.df = vector.hybrid_search(scope.df, scope.find(h.column), vector.parse(h.query), h.top_k, h.metric, h.threshold)
            scope.sources = [(alias, [*names, "vector_score"], [*reals, "vector_score"])]

    def project(self, items: list[Item], scope: Scope) -> DataFrame:
        if any(isinstance(i.node, Star) and not i.node.qualifier for i in items):
            if len(items) > 1:
                raise SqlUnsupportedError("SELECT * cannot be mixed with other items")
            return scope.df
        cols: list[Column] = []
        for i, item in enumerate(items):
            if isinstance(item.node, Star):
                found = [s for s in scope.sources if s[0] == item.node.qualifier]
                if not found:
                    raise SqlSemanticError(f"unknown table or alias: {item.node.qualifier}")
                cols += [scope.df[f"`{real}`"].alias(f"{item.node.qualifier}.{name}") for name, real in zip(found[0][1], found[0][2], strict=True)]
            elif isinstance(item.node, Literal):
                raise SqlUnsupportedError("literal projection with FROM")
            else:
                cols.append(scope.expression(item.node).col.alias(item.alias or default_alias(item.node, i)))
        return scope.df.select(*cols)

    def aggregate(self, s: Select, scope: Scope) -> DataFrame:
        if not any(isinstance(i.node, Aggregate) for i in s.items):
            raise SqlSemanticError("GROUP BY needs at least one aggregate")
        df, keys = scope.df, {}
        for i, g in enumerate(s.group):
            node = Name(scope.find(g)) if isinstance(g, Name) else g
            if isinstance(g, Literal):
                raise SqlUnsupportedError("GROUP BY literal")
            if isinstance(g, Name):
                keys[str(node)] = node.name
            else:
                df = df.withColumn(f"__group_expr_{i}", scope.expression(g).col)
                keys[repr(self._real(g, scope))] = f"__group_expr_{i}"
        out, specs, seen = [], [], set()
        for i, item in enumerate(s.items):
            if isinstance(item.node, (Star, Literal)):
                raise SqlSemanticError("non-aggregate items must be grouped")
            alias = item.alias or default_alias(item.node, i)
            if alias in seen:
                raise SqlSemanticError(f"duplicate alias: {alias}")
            seen.add(alias)
            if isinstance(item.node, Aggregate):
                column = scope.find(item.node.column) if item.node.column else None
                specs.append((item.node.name, column, f"__agg_{i}"))
                out.append((f"__agg_{i}", alias, (item.node.name, column)))
            else:
                key = str(Name(scope.find(item.node))) if isinstance(item.node, Name) else repr(self._real(item.node, scope))
                if key not in keys:
                    raise SqlSemanticError(f"non-aggregate items must be grouped: {alias}")
                out.append((keys[key], alias, item.node))
        try:
            made = aggregates.aggregate(df, list(dict.fromkeys(keys.values())), specs)
        except ValueError as e:
            raise SqlSemanticError(str(e)) from None
        result = made.select(*(F.col(f"`{real}`").alias(alias) for real, alias, _ in out))
        if s.having is not None:
            result = rel.where(result, scope.predicate(s.having, lambda n: self._having(n, out, scope)))
        return result

    def _having(self, n, out, scope: Scope) -> str:
        if isinstance(n, Aggregate):
            spec = (n.name, scope.find(n.column) if n.column else None)
            for _, alias, what in out:
                if what == spec or (n.name == "COUNT" and isinstance(what, tuple) and what[0] == "COUNT"):
                    return alias
            raise SqlSemanticError("an aggregate in HAVING must be in SELECT")
        for _, alias, what in out:
            if n.name == alias or (isinstance(what, Name) and what.name == n.name):
                return alias
        raise SqlSemanticError(f"column not found: {n}")

    def _real(self, node, scope: Scope):
        """The expression with names resolved, to compare it with another."""
        if isinstance(node, Name):
            return Name(scope.find(node))
        return Call(node.name, tuple(self._real(a, scope) for a in node.args)) if isinstance(node, Call) else node


def steps(q: Query) -> list[str]:
    """The logical plan in words, a line a step."""
    out = []
    for i, s in enumerate((q.first, *(s for _, s in q.unions))):
        out.append(f"Scan {s.table.name}" if s.table else "OneRow")
        out += [f"Join {s.join.how} {s.join.table.name} on {s.join.left} = {s.join.right}"] if s.join else []
        out += ["Filter " + show(s.where)] if s.where is not None else []
        out += [f"KeywordSearch top_k={s.keyword.top_k}"] if s.keyword else []
        out += [f"HybridSearch metric={s.hybrid.metric} top_k={s.hybrid.top_k}"] if s.hybrid else []
        out += [f"WindowAssign {s.window.column} every={s.window.every} slide={s.window.slide} as {s.window.out}"] if s.window else []
        aggs = [x.node for x in s.items if isinstance(x.node, Aggregate)]
        out += [f"Aggregate keys=[{', '.join(map(str, s.group))}] aggs=[{', '.join(f'{a.name}({a.column or '*'})' for a in aggs)}]"] if aggs else []
        out += ["Having " + show(s.having)] if s.having is not None else []
        out.append("Project " + ", ".join(x.alias or ("*" if isinstance(x.node, Star) else default_alias(x.node, k)) for k, x in enumerate(s.items)))
        out += ["OrderBy " + ", ".join(f"{k} {'ASC' if up else 'DESC'}" for k, up in s.order)] if s.order else []
        out += [f"Limit {s.limit}"] if s.limit is not None else []
        if i:
            out.append("Union " + ("DISTINCT" if q.unions[i - 1][0] else "ALL"))
    return out


def show(tree) -> str:
    if isinstance(tree, rel.Bool):
        return "(" + f" {tree.op.upper()} ".join(map(show, tree.parts)) + ")"
    if isinstance(tree, Condition):
        left = f"{tree.left.name}({tree.left.column or '*'})" if isinstance(tree.left, Aggregate) else str(tree.left)
        return f"{left} {tree.op} {tree.right if isinstance(tree.right, Name) else repr(tree.right.value)}"
    return str(tree)
