"""The SQL v1 grammar: text to statements. A recursive-descent parser with the search, window and table extensions built in."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..functions import scalar
from ..operators.relational import INVERSE, Bool
from .errors import SqlSyntaxError, SqlUnsupportedError

_TOKEN = re.compile(
    r"\s+|--[^\n]*|(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\")"
    r"|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<op><>|!=|<=|>=|==|\|\||[-+*/%(),.;=<>:])|(?P<bad>.)"
)
AGGREGATES = ("SUM", "COUNT", "AVG", "MIN", "MAX")
_LEFT_OUT = {
    "STDDEV", "VARIANCE", "VAR_SAMP", "STDDEV_POP", "STRING_AGG", "ARRAY_AGG", "MEDIAN", "PERCENTILE_CONT", "APPROX_COUNT_DISTINCT",
}
_CLAUSES = {
    "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "JOIN", "LEFT", "INNER", "RIGHT", "FULL", "CROSS", "ON", "KEYWORD", "HYBRID", "WINDOW",
    "AS", "ASC", "DESC", "NULLS", "USING", "OPTIONS",
}


@dataclass(frozen=True)
class Name:
    name: str
    qualifier: str = ""

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    name: str
    column: Name | None


@dataclass(frozen=True)
class Star:
    qualifier: str = ""


@dataclass(frozen=True)
class Item:
    node: Any
    alias: str = ""


@dataclass(frozen=True)
class Condition:
    """left is a Name or an Aggregate; right a Literal or a Name."""

    left: Any
    op: str
    right: Any


@dataclass
class Table:
    name: str
    alias: str = ""


@dataclass
class Join:
    table: Table
    how: str
    left: Name
    right: Name


@dataclass
class Keyword:
    columns: list[Name]
    query: str
    top_k: int = 10


@dataclass
class Hybrid:
    column: Name
    query: str
    metric: str = "cosine"
    top_k: int = 10
    threshold: float | None = None


@dataclass
class WindowBy:
    column: Name
    every: int
    slide: int
    out: str


@dataclass
class Select:
    items: list[Item]
    table: Table | None = None
    join: Join | None = None
    where: Any = None
    group: list = field(default_factory=list)
    having: Any = None
    keyword: Keyword | None = None
    hybrid: Hybrid | None = None
    window: WindowBy | None = None
    order: list[tuple[Name, bool]] = field(default_factory=list)
    limit: int | None = None


@dataclass
class Query:
    first: Select
    unions: list[tuple[bool, Select]] = field(default_factory=list)


@dataclass
class Create:
    name: str
    kind: str
    columns: list[tuple[str, str]]
    provider: str = ""
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class Insert:
    table: str
    columns: list[str]
    rows: list[list[Any]] | None = None
    query: Query | None = None


def parse(text: str) -> Query | Create | Insert:
    return _Parser(text).statement()


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind == "bad":
                if not m[0].isascii():
                    raise SqlUnsupportedError(f"unquoted non-ASCII identifier: {m[0]}")
                raise SqlSyntaxError(f"syntax error at or near {m[0]!r}")
            if kind:
                self.tokens.append((kind, m[0]))
        while self.tokens and self.tokens[-1][1] == ";":
            self.tokens.pop()
        self.at = 0

    # tokens

    def peek(self, k: int = 0) -> str:
        i = self.at + k
        return "" if i >= len(self.tokens) else self.tokens[i][1].upper() if self.tokens[i][0] in ("word", "op") else self.tokens[i][1]

    def kind(self, k: int = 0) -> str:
        return self.tokens[self.at + k][0] if self.at + k < len(self.tokens) else ""

    def take(self, *words: str) -> bool:
        """Consumes the words if they come next."""
        if all(self.kind(i) in ("word", "op") and self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            self.fail()

    def fail(self) -> None:
        near = self.tokens[self.at][1] if self.at < len(self.tokens) else "end of input"
        raise SqlSyntaxError(f"syntax error at or near {near!r}")

    def identifier(self) -> str:
        kind = self.kind()
        if kind == "quoted":
            self.at += 1
            return self.tokens[self.at - 1][1][1:-1].replace('""', '"')
        if kind != "word":
            self.fail()
        self.at += 1
        return self.tokens[self.at - 1][1]

    def string(self, what: str) -> str:
        if self.kind() != "string":
            raise SqlSyntaxError(what)
        self.at += 1
        return self.tokens[self.at - 1][1][1:-1].replace("''", "'")

    def number(self, what: str) -> float:
        sign = -1 if self.take("-") else 1
        if self.kind() != "number":
            raise SqlSyntaxError(what)
        self.at += 1
        x = self.tokens[self.at - 1][1]
        return sign * (int(x) if x.isdigit() else float(x))

    # statements

    def statement(self):
        head = self.peek()
        if head == "SELECT":
            out = self.query()
        elif head == "CREATE":
            out = self.create()
        elif head == "INSERT":
            out = self.insert()
        elif head == "WITH":
            raise SqlUnsupportedError("CTE (WITH)")
        elif head in ("UPDATE", "DELETE", "DROP", "ALTER", "MERGE", "TRUNCATE", "EXPLAIN"):
            raise SqlUnsupportedError("unsupported SQL statement.")
        else:
            self.fail()
        if self.at < len(self.tokens):
            self.fail()
        return out

    def query(self) -> Query:
        q = Query(self.select())
        while True:
            if self.take("UNION"):
                all_ = self.take("ALL")
                if not all_:
                    self.take("DISTINCT")
                q.unions.append((not all_, self.select()))
            elif self.peek() in ("INTERSECT", "EXCEPT"):
                raise SqlUnsupportedError(self.peek())
            else:
                return q

    def select(self) -> Select:
        self.need("SELECT")
        if self.take("DISTINCT"):
            raise SqlUnsupportedError("SELECT DISTINCT")
        s = Select([self.item()])
        while self.take(","):
            s.items.append(self.item())
        if self.take("FROM"):
            s.table = self.table()
            if self.take(","):
                raise SqlUnsupportedError("more than one FROM table")
            s.join = self.join()
            if s.join and self.join():
                raise SqlUnsupportedError("more than one JOIN")
        while True:
            if self.take("WHERE"):
                s.where = self.condition(having=False)
            elif self.take("KEYWORD", "SEARCH"):
                s.keyword = self.keyword()
            elif self.take("HYBRID", "SEARCH"):
                s.hybrid = self.hybrid()
            elif self.take("WINDOW", "BY"):
                s.window = self.window()
            elif self.take("GROUP", "BY"):
                s.group = [self.scalar()]
                while self.take(","):
                    s.group.append(self.scalar())
            elif self.take("HAVING"):
                s.having = self.condition(having=True)
            elif self.take("ORDER", "BY"):
                s.order = [self.order_key()]
                while self.take(","):
                    s.order.append(self.order_key())
            elif self.take("LIMIT"):
                if self.kind() != "number" or not self.peek().isdigit() or self.peek(1) in ("+", "-", "*", "/"):
                    raise SqlUnsupportedError("LIMIT must be an integer literal")
                s.limit = int(self.number(""))
            elif self.take("OFFSET"):
                if self.number("OFFSET must be numeric.") != 0:
                    raise SqlUnsupportedError("OFFSET")
            else:
                return s

    def table(self) -> Table:
        if self.peek() == "(":
            raise SqlUnsupportedError("subquery in FROM")
        t = Table(self.identifier())
        if self.take("AS") or (self.kind() in ("word", "quoted") and self.peek() not in _CLAUSES):
            t.alias = self.identifier()
        return t

    def join(self) -> Join | None:
        if self.take("LEFT"):
            self.take("OUTER")
            how = "left"
            self.need("JOIN")
        elif self.take("INNER", "JOIN") or self.take("JOIN"):
            how = "inner"
        elif self.peek() in ("RIGHT", "FULL", "CROSS", "NATURAL"):
            raise SqlUnsupportedError(f"{self.peek()} JOIN")
        else:
            return None
        t = self.table()
        self.need("ON")
        left = self.name()
        if self.peek() in ("<", ">", "<=", ">=", "!=", "<>"):
            raise SqlUnsupportedError("non-equality JOIN")
        if not (self.take("=") or self.take("==")):
            self.fail()
        right = self.name()
        if self.peek() in ("AND", "OR"):
            raise SqlUnsupportedError("JOIN on more than one key")
        return Join(t, how, left, right)

    def item(self) -> Item:
        if self.take("*"):
            return Item(Star())
        if self.kind() in ("word", "quoted") and self.peek(1) == "." and self.peek(2) == "*":
            q = self.identifier()
            self.at += 2
            return Item(Star(q))
        node = self.scalar(aggregates=True)
        if self.take("AS"):
            return Item(node, self.identifier())
        if self.kind() == "quoted" or (self.kind() == "word" and self.peek() not in _CLAUSES):
            return Item(node, self.identifier())
        return Item(node)

    def name(self) -> Name:
        a = self.identifier()
        return Name(self.identifier(), a) if self.take(".") else Name(a)

    def order_key(self) -> tuple[Name, bool]:
        key = self.name()
        if self.peek() == "(":
            raise SqlUnsupportedError("ORDER BY expression")
        up = not self.take("DESC")
        if up:
            self.take("ASC")
        if self.take("NULLS"):
            self.at += 1
        return key, up

    # expressions

    def scalar(self, aggregates: bool = False):
        node = self.primary(aggregates)
        if self.peek() in ("+", "-", "*", "/", "%", "||") and self.kind() == "op":
            raise SqlUnsupportedError("arithmetic expression")
        return node

    def primary(self, aggregates: bool):
        if self.kind() == "string":
            return Literal(self.string(""))
        if self.kind() == "number" or (self.peek() == "-" and self.kind(1) == "number"):
            return Literal(self.number(""))
        for word, value in (("NULL", None), ("TRUE", True), ("FALSE", False)):
            if self.take(word):
                return Literal(value)
        word = self.peek()
        if self.kind() == "word":
            if word == "CASE":
                raise SqlUnsupportedError("CASE")
            if word == "CAST" and self.peek(1) == "(":
                self.at += 2
                arg = self.scalar()
                self.need("AS")
                kind = self.identifier().upper()
                self.need(")")
                if kind not in scalar.CASTS:
                    raise SqlUnsupportedError(f"CAST to {kind}")
                return Call("CAST", (arg, Literal(kind)))
            if word in ("CURRENT_TIMESTAMP", "CURRENT_DATE") and self.peek(1) != "(":
                self.at += 1
                return Call(word, ())
            if self.peek(1) == "(":
                return self.call(word, aggregates)
        if self.peek() == "(":
            if self.peek(1) == "SELECT":
                raise SqlUnsupportedError("subquery")
            self.fail()
        return self.name()

    def call(self, word: str, aggregates: bool):
        self.at += 2
        if word in AGGREGATES:
            if not aggregates:
                raise SqlUnsupportedError(f"aggregate function {word} here")
            if self.take("DISTINCT"):
                raise SqlUnsupportedError(f"{word}(DISTINCT)")
            if self.take("*"):
                if word != "COUNT":
                    raise SqlSyntaxError(f"{word}(*) is not valid")
                column = None
            else:
                if self.kind() not in ("word", "quoted") or self.peek(1) not in (")", "."):
                    raise SqlUnsupportedError("Aggregate argument must be a column or '*'.")
                column = self.name()
            self.need(")")
            if self.peek() == "OVER":
                raise SqlUnsupportedError("window functions (OVER)")
            return Aggregate(word, column)
        args = []
        if not self.take(")"):
            args.append(self.scalar())
            while self.take(","):
                args.append(self.scalar())
            self.need(")")
        if self.peek() == "OVER":
            raise SqlUnsupportedError("window functions (OVER)")
        if word in _LEFT_OUT:
            raise SqlUnsupportedError(f"aggregate function {word}")
        try:
            scalar.lookup(word).check(word, len(args))
        except KeyError:
            raise SqlUnsupportedError(f"function {word}") from None
        except ValueError as e:
            raise SqlSyntaxError(str(e)) from None
        return Call(scalar.ALIASES.get(word, word), tuple(args))

    def condition(self, having: bool):
        parts = [self.conjunction(having)]
        while self.take("OR"):
            parts.append(self.conjunction(having))
        return parts[0] if len(parts) == 1 else Bool("or", tuple(parts))

    def conjunction(self, having: bool):
        parts = [self.comparison(having)]
        while self.take("AND"):
            parts.append(self.comparison(having))
        return parts[0] if len(parts) == 1 else Bool("and", tuple(parts))

    def comparison(self, having: bool):
        if self.take("NOT"):
            inner = self.comparison(having)
            if isinstance(inner, Bool):
                raise SqlUnsupportedError("NOT over a compound predicate")
            return Condition(inner.left, INVERSE[inner.op], inner.right)
        if self.peek() == "(" and self.peek(1) != "SELECT":
            self.at += 1
            inner = self.condition(having)
            self.need(")")
            return inner
        if self.peek() == "EXISTS" or (self.peek() == "(" and self.peek(1) == "SELECT"):
            raise SqlUnsupportedError("subquery in a predicate")
        if self.kind() == "word" and self.peek(1) == "(" and self.peek() in AGGREGATES and not having:
            raise SqlUnsupportedError("aggregate in WHERE")
        left = self.primary(aggregates=having)
        if not isinstance(left, (Name, Aggregate)):
            raise SqlUnsupportedError("predicate left side must be a column")
        for word in ("LIKE", "ILIKE", "IN", "BETWEEN", "IS", "NOT", "+", "-", "*", "/", "%", "||"):
            if self.peek() == word:
                raise SqlUnsupportedError({"IS": "IS NULL", "NOT": "NOT LIKE/IN/BETWEEN"}.get(word, word if word.isalpha() else "arithmetic expression"))
        op = self.peek()
        if op not in ("=", "==", "!=", "<>", "<", ">", "<=", ">="):
            self.fail()
        self.at += 1
        if self.peek() == "(" and self.peek(1) == "SELECT":
            raise SqlUnsupportedError("subquery in a predicate")
        right = self.primary(aggregates=False) if not (self.kind() == "word" and self.peek(1) == "(") else None
        if right is None or self.peek() in ("+", "-", "*", "/", "%", "||"):
            raise SqlUnsupportedError("predicate right side must be a literal or a column")
        return Condition(left, {"==": "=", "<>": "!="}.get(op, op), right)

    # extensions

    def keyword(self) -> Keyword:
        self.need("(")
        columns = [self.name()]
        while self.take(","):
            columns.append(self.name())
        self.need(")")
        self.need("QUERY")
        k = Keyword(columns, self.string("KEYWORD SEARCH QUERY must be a quoted string literal."))
        if self.take("TOP_K"):
            k.top_k = int(self.number("KEYWORD SEARCH TOP_K must be numeric."))
        return k

    def hybrid(self) -> Hybrid:
        column = self.name()
        self.need("QUERY")
        h = Hybrid(column, self.string("HYBRID SEARCH QUERY must be a quoted vector literal."))
        while True:
            if self.take("METRIC"):
                h.metric = self.identifier()
            elif self.take("TOP_K"):
                h.top_k = int(self.number("HYBRID SEARCH TOP_K must be numeric."))
            elif self.take("SCORE_THRESHOLD"):
                h.threshold = float(self.number("HYBRID SEARCH SCORE_THRESHOLD must be numeric."))
            else:
                return h

    def window(self) -> WindowBy:
        column = self.name()
        self.need("EVERY")
        every = int(self.number("WINDOW EVERY must be numeric."))
        slide = int(self.number("WINDOW SLIDE must be numeric.")) if self.take("SLIDE") else every
        if every <= 0 or slide <= 0 or slide > every:
            raise SqlSyntaxError("stream SQL WINDOW SLIDE must be > 0 and <= EVERY")
        self.need("AS")
        return WindowBy(column, every, slide, self.identifier())

    def create(self) -> Create:
        self.need("CREATE")
        kind = "source" if self.take("SOURCE") else "sink" if self.take("SINK") else "regular"
        self.need("TABLE")
        c = Create(self.identifier(), kind, [])
        if self.take("("):
            while True:
                name = self.identifier()
                dtype = self.identifier().upper()
                if self.take("("):
                    while not self.take(")"):
                        self.at += 1
                if any(n == name for n, _ in c.columns):
                    raise SqlSyntaxError(f"duplicate column: {name}")
                c.columns.append((name, dtype))
                if not self.take(","):
                    break
            self.need(")")
        if self.take("USING"):
            c.provider = self.identifier().lower()
            if c.provider not in ("csv", "line", "json"):
                raise SqlSyntaxError("CREATE TABLE type/provider must be csv, line, or json")
        if self.take("OPTIONS"):
            self.need("(")
            while not self.take(")"):
                key = self.identifier() if self.kind() != "string" else self.string("")
                if not (self.take(":") or self.take("=")):
                    raise SqlSyntaxError("OPTIONS entries must be key: value pairs.")
                self.at += 1
                kind_, value = self.tokens[self.at - 1]
                c.options[key.lower()] = value[1:-1].replace("''", "'") if kind_ in ("string", "quoted") else value
                self.take(",")
        if not c.columns and not c.options:
            self.fail()
        return c

    def insert(self) -> Insert:
        self.need("INSERT")
        self.need("INTO")
        out = Insert(self.identifier(), [])
        if self.take("("):
            out.columns.append(self.identifier())
            while self.take(","):
                out.columns.append(self.identifier())
            self.need(")")
            if len(set(out.columns)) != len(out.columns):
                raise SqlSyntaxError("duplicate column in INSERT")
        if self.take("VALUES"):
            out.rows = []
            while True:
                self.need("(")
                row = [self.value()]
                while self.take(","):
                    row.append(self.value())
                self.need(")")
                out.rows.append(row)
                if not self.take(","):
                    return out
        out.query = self.query()
        return out

    def value(self):
        node = self.scalar()
        if not isinstance(node, Literal):
            raise SqlUnsupportedError("VALUES must be literals")
        return node.value
