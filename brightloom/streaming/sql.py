"""Stream SQL: SELECT over SOURCE tables and INSERT INTO a SINK table."""

from __future__ import annotations

from ..operators import relational as rel
from ..plans.errors import SqlSemanticError, SqlTableKindError, SqlUnsupportedError
from ..plans.parser import Aggregate, Condition, Insert, Literal, Name, Query, Select, Star
from ..plans.planner import Planner, Scope, default_alias, steps
from .query import Stream, StreamQuery


def _checked(session, q: Query) -> Select:
    s = q.first
    if q.unions:
        raise SqlUnsupportedError("UNION in stream SQL")
    if s.join:
        raise SqlUnsupportedError("JOIN in stream SQL")
    if s.keyword or s.hybrid:
        raise SqlUnsupportedError("search in stream SQL")
    if s.table is None or any(isinstance(i.node, Literal) for i in s.items):
        raise SqlUnsupportedError("literal projection in stream SQL")
    for tree in (s.where, s.having):
        if isinstance(tree, rel.Bool):
            raise SqlUnsupportedError("stream SQL predicates are one comparison")
    if any(isinstance(i.node, Aggregate) and i.node.name == "COUNT" and i.node.column for i in s.items):
        raise SqlUnsupportedError("stream SQL COUNT takes *")
    if s.table.name not in session.sources:
        raise SqlTableKindError(f"stream SQL source must be created with CREATE SOURCE TABLE: {s.table.name}")
    return s


def plan(session, q: Query) -> Stream:
    """The stream of a SELECT: where, window, running aggregate, having, project, order, limit."""
    if not isinstance(q, Query):
        raise SqlSemanticError("stream SQL takes a SELECT")
    s = _checked(session, q)
    planner, source, alias = Planner(session.table, session.spark), session.sources[s.table.name], s.table.alias or s.table.name

    def scope(df) -> Scope:
        return Scope(df, [(alias, df.columns, df.columns)])

    sample = session.spark.createDataFrame([], source.batch(session.spark).schema)
    out = Stream(session.spark, source)

    def step(f, **kw) -> None:
        nonlocal out, sample
        sample = f(sample)  # names are checked now, not when the stream runs
        out = out._with(f, **kw)

    if s.where is not None:
        step(lambda df: rel.where(df, scope(df).predicate(s.where)))
    if s.window:
        w = s.window
        step(lambda df: rel.window_start(df, scope(df).find(w.column), w.every, w.out, w.slide if w.slide != w.every else 0, as_text=True), window=w.out)
    aggs = [(i, x) for i, x in enumerate(s.items) if isinstance(x.node, Aggregate)]
    if s.group or aggs:
        if not s.group:
            raise SqlUnsupportedError("stream SQL aggregates need GROUP BY")
        checked = planner.aggregate(s, scope(sample))
        keys = []
        for i, g in enumerate(s.group):
            if isinstance(g, Name):
                keys.append(scope(sample).find(g))
            else:
                step(lambda df, g=g, i=i: df.withColumn(f"__group_expr_{i}", scope(df).expression(g).col))
                keys.append(f"__group_expr_{i}")
        specs = [(x.node.name, scope(sample).find(x.node.column) if x.node.column else None, f"__agg_{i}") for i, x in aggs]
        out = out.group_by(keys).agg(specs, stateful=True)
        shown = []
        for i, x in enumerate(s.items):
            real = f"__agg_{i}" if isinstance(x.node, Aggregate) else scope(sample).find(x.node) if isinstance(x.node, Name) else keys[[repr(g) for g in s.group].index(repr(x.node))]
            shown.append((real, x.alias or default_alias(x.node, i), (x.node.name, scope(sample).find(x.node.column) if x.node.column else None) if isinstance(x.node, Aggregate) else x.node))
        base, sample = scope(sample), checked
        step(lambda df: rel.select(df, [r for r, _, _ in shown], [a for _, a, _ in shown]) if df.columns != checked.columns else df)
        if s.having is not None:
            tree = base.predicate(s.having, lambda n: planner._having(n, shown, base))
            step(lambda df: rel.where(df, tree))
    elif not (len(s.items) == 1 and isinstance(s.items[0].node, Star)):
        step(lambda df: planner.project(s.items, scope(df)))
    if s.order:
        names, up = [k.name for k, _ in s.order], [u for _, u in s.order]
        for n in names:
            if n not in sample.columns:
                raise SqlSemanticError(f"ORDER BY column must be in the output: {n}")
        try:
            out = out.order_by(names, up)
        except ValueError as e:
            raise SqlUnsupportedError(str(e)) from None
    return out if s.limit is None else out.limit(s.limit)


def _insert(session, i) -> None:
    if not isinstance(i, Insert) or i.query is None:
        raise SqlSemanticError("start_stream_sql takes INSERT INTO sink SELECT ...")
    if i.columns:
        raise SqlUnsupportedError("column list in stream INSERT")
    if i.table not in session.sinks:
        raise SqlTableKindError(f"stream SQL sink must be created with CREATE SINK TABLE: {i.table}")


def start(session, i, **options) -> StreamQuery:
    _insert(session, i)
    return plan(session, i.query).start(session.sinks[i.table], plugins=session.plugins, **options).start()


def explain(session, statement, **options) -> str:
    """The sections logical, physical and strategy."""
    q = statement.query if isinstance(statement, Insert) else statement
    if isinstance(statement, Insert):
        _insert(session, statement)
    stream = plan(session, q)
    frame = stream.frame()
    spark = session.spark
    text = frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    facts = {
        "selected_mode": "spark", "requested_mode": options.get("execution_mode", "auto"), "reason": "every mode runs as Spark tasks", "actor_eligible": False, "transport_mode": "spark-shuffle",
        "stateful": stream.running is not None, "window": stream.window_column or "none", "output_mode": "update" if stream.running else "append", "checkpoint_delivery_mode": options.get("delivery", "at-least-once"),
        "used_shared_memory": False, "estimated_state_size_bytes": 0, "estimated_batch_cost": 0, "backpressure_max_queue_batches": 1,
    }
    tail = [f"  Sink {statement.table}"] if isinstance(statement, Insert) else []
    return "\n".join(["logical", *(f"  {x}" for x in steps(q)), *tail, "physical", text.strip(), "strategy", *(f"  {k}={v}" for k, v in facts.items())])


def condition_of(tree: Condition) -> rel.Compare:
    return rel.Compare(tree.left.name, tree.op, tree.right.value if isinstance(tree.right, Literal) else rel.Ref(tree.right.name))
