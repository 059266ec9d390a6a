"""Recursive descent for statements, precedence climbing for expressions; one parser for all dialects."""

from __future__ import annotations

from . import nodes as N
from .lexer import DIALECTS, SqlError, tokens

# Binding strengths, words that end an alias, hints, interval units.
BINDING = {
    "OR": 4, "AND": 5, "&": 7, "|": 7, "^": 7, "=": 8, "<>": 8, "!=": 8, "<": 8, "<=": 8, ">": 8, ">=": 8, "!<": 8,
    "!>": 8, "+": 9, "-": 9, "||": 9, "*": 10, "/": 10, "%": 10,
}
NOT, IS, COMPARE, CAST, SUBSCRIPT = 6, 7, 8, 11, 12
JSON = ("->", "->>", "#>", "#>>", "@>", "<@", "?", "?|", "?&")
RESERVED = set(
    "SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH UNION INTERSECT EXCEPT ON JOIN INNER LEFT RIGHT FULL CROSS "
    "NATURAL USING AND OR NOT IN IS LIKE BETWEEN CASE WHEN THEN ELSE END AS INTO VALUES SET WITH OPTION RETURNING OUTPUT "
    "WINDOW FOR DESC ASC TOP DISTINCT ALL EXISTS NULL LATERAL INSERT UPDATE DELETE MERGE OVER".split()
)
TRUE_WORDS, FALSE_WORDS = ("TRUE", "T", "YES", "ON"), ("FALSE", "F", "NO", "OFF")
TABLE_HINTS = set(
    "NOLOCK ROWLOCK UPDLOCK HOLDLOCK TABLOCK TABLOCKX PAGLOCK READCOMMITTED READCOMMITTEDLOCK READPAST READUNCOMMITTED "
    "REPEATABLEREAD SERIALIZABLE SNAPSHOT XLOCK NOWAIT".split()
)
UNITS = set(
    "MICROSECOND SECOND MINUTE HOUR DAY WEEK MONTH QUARTER YEAR SECOND_MICROSECOND MINUTE_MICROSECOND MINUTE_SECOND "
    "HOUR_MICROSECOND HOUR_SECOND HOUR_MINUTE DAY_MICROSECOND DAY_SECOND DAY_MINUTE DAY_HOUR YEAR_MONTH".split()
)
# end of fixed values


class Parser:
    def __init__(self, text: str, dialect: str = "ansi") -> None:
        if dialect not in DIALECTS:
            raise SqlError(f"unknown dialect {dialect}; known are {', '.join(DIALECTS)}")
        self.dialect = DIALECTS[dialect]
        self.tokens = tokens(text, self.dialect)
        self.at = self.positional = 0

    # tokens

    @property
    def now(self):
        return self.tokens[self.at]

    def ahead(self, k: int = 1):
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def is_(self, *words: str) -> bool:
        """Whether the next tokens are these words or operators."""
        return all((t := self.ahead(i)).word == w or t.kind == "op" and t.text == w for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError(f"expected {' '.join(words)} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def name(self) -> str:
        t = self.now
        if t.kind == "quoted" or t.kind == "id" and t.word not in RESERVED:
            self.at += 1
            return t.text
        raise SqlError(f"expected a name at {t.at}, found {t.text or 'the end'!r}")

    def names(self) -> tuple[str, ...]:
        out = [self.name()]
        while self.take("."):
            out.append(self.name())
        if len(out) > 3:
            raise SqlError(f"too many parts in {'.'.join(out)}")
        return tuple(out)

    def listed(self, one) -> tuple:
        out = [one()]
        while self.take(","):
            out.append(one())
        return tuple(out)

    def in_parens(self, one) -> tuple:
        self.need("(")
        out = self.listed(one)
        self.need(")")
        return out

    # expressions

    def expr(self, least: int = 0) -> N.Node:
        left = self.operand()
        while True:
            t = self.now
            op = t.word or (t.text if t.kind == "op" else "")
            negated = op == "NOT" and self.ahead().word in ("LIKE", "IN", "BETWEEN")
            if negated:
                op = self.ahead().word
            if op == "::" and CAST >= least:
                self.at += 1
                left = N.Cast(left, self.type())
            elif op == "[" and SUBSCRIPT >= least:
                left = self.subscript(left)
            elif self.dialect.json and op in JSON and COMPARE > least:
                self.at += 1
                left = N.Json(op, left, self.expr(COMPARE))
            elif op in ("LIKE", "IN", "BETWEEN") and COMPARE > least:
                self.at += 1 + negated
                left = self.predicate(op, left, negated)
            elif op == "IS" and IS > least:
                self.at += 1
                negated = self.take("NOT")
                self.need("NULL")
                left = N.IsNull(left, negated)
            elif op in BINDING and BINDING[op] > least:
                self.at += 1
                if BINDING[op] == COMPARE and self.now.word in ("ANY", "SOME", "ALL") and self.ahead().text == "(":
                    quantifier = "ALL" if self.now.word == "ALL" else "ANY"
                    self.at += 1
                    (array,) = self.in_parens(self.expr)
                    left = N.Call(f"{quantifier} {op}", (left, array))
                else:
                    op = {"!=": "<>", "!<": ">=", "!>": "<="}.get(op, op)
                    left = N.Bin(op, left, self.expr(BINDING[op] if op in BINDING else COMPARE))
            else:
                return left

    def predicate(self, op: str, left: N.Node, negated: bool) -> N.Node:
        if op == "LIKE":
            pattern = self.expr(COMPARE)
            out = N.Like(left, pattern, self.expr(COMPARE) if self.take("ESCAPE") else None)
            return N.Un("NOT", out) if negated else out
        if op == "BETWEEN":
            low = self.expr(COMPARE)
            self.need("AND")
            return N.Between(left, low, self.expr(COMPARE), negated)
        self.need("(")
        if self.now.word in ("SELECT", "WITH"):
            items = self.query()
        else:
            items = () if self.is_(")") else self.listed(self.expr)
        self.need(")")
        return N.In(left, items, negated)

    def subscript(self, left: N.Node) -> N.Node:
        self.need("[")
        low = None if self.is_(":") else self.expr()
        if self.take(":"):
            out = N.Index(left, low, None if self.is_("]") else self.expr(), True)
        else:
            out = N.Index(left, low)
        self.need("]")
        return out

    def operand(self) -> N.Node:
        t = self.now
        word = t.word
        if t.kind == "number":
            self.at += 1
            return N.Lit(int(t.text) if t.text.isdigit() else _decimal(t.text))
        if t.kind == "string":
            self.at += 1
            return N.Lit(t.text)
        if t.kind == "param":
            self.at += 1
            return N.Param(t.text)
        if self.take("?"):
            self.positional += 1
            return N.Param(f"?{self.positional - 1}")
        if self.take("NOT"):
            return N.Un("NOT", self.expr(NOT))
        for sign in "+-~":
            if self.take(sign):
                return N.Un(sign, self.expr(10))
        if self.take("("):
            if self.now.word in ("SELECT", "WITH"):
                out = N.Sub(self.query())
            else:
                out = self.expr()
                if self.is_(","):
                    raise SqlError(f"row values are not supported, at {self.now.at}")
            self.need(")")
            return out
        if self.take("*"):
            return N.Star()
        if self.take("EXISTS"):
            self.need("(")
            out = N.Exists(self.query())
            self.need(")")
            return out
        if self.take("CASE"):
            return self.case()
        if word == "CAST" and self.ahead().text == "(":
            self.at += 2
            arg = self.expr()
            self.need("AS")
            out = N.Cast(arg, self.type())
            self.need(")")
            return out
        if word == "INTERVAL":
            self.at += 1
            value = self.expr(COMPARE)
            if self.now.word not in UNITS:
                raise SqlError(f"expected a unit of time at {self.now.at}")
            self.at += 1
            return N.Interval(value, self.tokens[self.at - 1].word)
        if word == "ARRAY" and self.ahead().text == "[":
            self.at += 2
            items = () if self.is_("]") else self.listed(self.expr)
            self.need("]")
            return N.Array(items)
        if self.take("NULL"):
            return N.Lit(None)
        if word in TRUE_WORDS + FALSE_WORDS and self.ahead().text not in (".", "("):
            self.at += 1
            return N.Lit(word in TRUE_WORDS)
        if t.kind in ("id", "quoted") and self.ahead().text == "(" and (t.kind == "quoted" or word not in RESERVED or word in ("LEFT", "RIGHT", "VALUES")):
            self.at += 1
            return self.call(t.text.upper())
        if word == "DATE" and self.ahead().kind == "string" or word == "TIMESTAMP" and self.ahead().kind == "string":
            self.at += 2
            return N.Cast(N.Lit(self.tokens[self.at - 1].text), N.Type(word))
        parts = [self.name()]
        while self.is_(".") and self.ahead().text != "*":
            self.at += 1
            parts.append(self.name())
        if self.take(".", "*"):
            return N.Star(tuple(parts))
        if len(parts) > 3:
            raise SqlError(f"too many parts in {'.'.join(parts)}")
        return N.Col(tuple(parts))

    def case(self) -> N.Node:
        base = None if self.is_("WHEN") else self.expr()
        whens = []
        while self.take("WHEN"):
            condition = self.expr()
            self.need("THEN")
            whens.append((condition, self.expr()))
        default = self.expr() if self.take("ELSE") else None
        self.need("END")
        return N.Case(base, tuple(whens), default)

    def call(self, name: str) -> N.Node:
        self.need("(")
        distinct = self.take("DISTINCT")
        if not distinct:
            self.take("ALL")
        args = () if self.is_(")") else self.listed(self.expr)
        self.need(")")
        over = self.window() if self.take("OVER") else None
        return N.Call(name, args, distinct, over)

    def window(self) -> N.Window:
        self.need("(")
        partition = self.listed(self.expr) if self.take("PARTITION", "BY") else ()
        order = self.listed(self.order_item) if self.take("ORDER", "BY") else ()
        frame = None
        if self.now.word in ("ROWS", "RANGE", "GROUPS"):
            mode = self.now.word
            self.at += 1
            if self.take("BETWEEN"):
                start = self.bound()
                self.need("AND")
                end = self.bound()
            else:
                start, end = self.bound(), (None, "CURRENT ROW")
            frame = N.Frame(mode, start, end)
        self.need(")")
        return N.Window(partition, order, frame)

    def bound(self) -> tuple:
        if self.take("CURRENT", "ROW"):
            return None, "CURRENT ROW"
        size = None if self.take("UNBOUNDED") else self.expr(COMPARE)
        for side in ("PRECEDING", "FOLLOWING"):
            if self.take(side):
                return size, side
        raise SqlError(f"expected PRECEDING or FOLLOWING at {self.now.at}")

    def type(self) -> N.Type:
        name = self.name().upper()
        if name == "DOUBLE":
            self.take("PRECISION")
        args: tuple = ()
        if self.take("("):
            args = self.listed(lambda: self.name().upper() if self.now.kind == "id" else int(self.number()))
            self.need(")")
        dims = 0
        while self.take("["):
            self.need("]")
            dims += 1
        return N.Type(name, args, dims)

    def number(self) -> str:
        if self.now.kind != "number":
            raise SqlError(f"expected a number at {self.now.at}")
        self.at += 1
        return self.tokens[self.at - 1].text

    # queries

    def query(self) -> N.Query:
        ctes, recursive = (), False
        if self.take("WITH"):
            recursive = self.take("RECURSIVE")
            ctes = self.listed(self.cte)
        first, rest = self.branch(), []
        while self.now.word in ("UNION", "INTERSECT", "EXCEPT"):
            op = self.now.word
            self.at += 1
            if self.take("ALL"):
                op += " ALL"
            else:
                self.take("DISTINCT")
            rest.append((op, self.branch()))
        order = self.listed(self.order_item) if self.take("ORDER", "BY") else ()
        limit = offset = None
        while True:
            if self.take("LIMIT"):
                limit = self.expr()
                if self.take(","):
                    limit, offset = self.expr(), limit
            elif self.take("OFFSET"):
                offset = self.expr()
                self.take("ROWS") or self.take("ROW")
            elif self.take("FETCH"):
                self.take("FIRST") or self.need("NEXT")
                limit = N.Lit(1) if self.now.word in ("ROW", "ROWS") else self.expr()
                self.take("ROWS") or self.need("ROW")
                self.need("ONLY")
            else:
                break
        if self.take("OPTION"):
            hints = self.option_hints()
            if isinstance(first, N.Select):
                first = N.replace(first, hints=first.hints + hints)
        return N.Query(first, tuple(rest), ctes, recursive, order, limit, offset)

    def option_hints(self) -> tuple:
        self.need("(")
        out, words = [], []
        while not self.is_(")"):
            if self.take(","):
                out.append(" ".join(words))
                words = []
            else:
                words.append(self.now.text.upper())
                self.at += 1
        self.need(")")
        return tuple([*out, " ".join(words)])

    def cte(self) -> N.Cte:
        name = self.name()
        columns = self.in_parens(self.name) if self.is_("(") else ()
        self.need("AS", "(")
        query = self.query()
        self.need(")")
        return N.Cte(name, columns, query)

    def branch(self) -> N.Node:
        if self.take("("):
            out = self.query()
            self.need(")")
            return out
        return self.select()

    def select(self) -> N.Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        if not distinct:
            self.take("ALL")
        top = None
        if self.take("TOP"):
            count = self.in_parens(self.expr)[0] if self.is_("(") else self.operand()
            percent = self.take("PERCENT")
            top = N.Top(count, percent, self.take("WITH", "TIES"))
        items = self.listed(self.item)
        into = self.name() if self.take("INTO") else None
        source, joins = (), ()
        if self.take("FROM"):
            source = self.listed(self.table)
            joins = self.joins()
        where = self.expr() if self.take("WHERE") else None
        group: tuple = ()
        if self.take("GROUP", "BY"):
            group = self.listed(self.group_item)
            if self.take("WITH", "ROLLUP"):
                group = (N.Grouping("ROLLUP", group),)
        having = self.expr() if self.take("HAVING") else None
        return N.Select(items, distinct, top, into, source, joins, where, group, having)

    def group_item(self) -> N.Node:
        for kind in ("ROLLUP", "CUBE"):
            if self.is_(kind, "("):
                self.at += 1
                return N.Grouping(kind, self.in_parens(self.expr))
        if self.take("GROUPING", "SETS"):
            return N.Grouping("GROUPING SETS", self.in_parens(self.grouping_set))
        return self.expr()

    def grouping_set(self) -> tuple:
        if self.take("("):
            out = () if self.is_(")") else self.listed(self.expr)
            self.need(")")
            return out
        return (self.expr(),)

    def alias(self) -> str | None:
        if self.take("AS"):
            if self.now.kind == "string":
                self.at += 1
                return self.tokens[self.at - 1].text
            return self.name()
        t = self.now
        if t.kind == "quoted" or t.kind == "id" and t.word not in RESERVED:
            return self.name()
        return None

    def item(self) -> N.Item:
        return N.Item(self.expr(), self.alias())

    def order_item(self) -> N.Order:
        expr = self.expr()
        desc = self.take("DESC")
        if not desc:
            self.take("ASC")
        nulls = None
        if self.take("NULLS"):
            nulls = "FIRST" if self.take("FIRST") else "LAST"
            if nulls == "LAST":
                self.need("LAST")
        return N.Order(expr, desc, nulls)

    def table(self) -> N.Node:
        if self.take("("):
            query = self.query()
            self.need(")")
            alias = self.alias()
            columns = self.in_parens(self.name) if alias and self.is_("(") else ()
            if alias is None:
                raise SqlError(f"a derived table needs an alias, at {self.now.at}")
            return N.Derived(query, alias, columns)
        parts = self.names()
        alias = self.alias()
        hints: tuple = ()
        if self.is_("WITH", "(") or self.is_("(") and self.ahead().word in TABLE_HINTS:
            self.take("WITH")
            hints = self.option_hints()
        return N.Table(parts, alias, hints)

    def joins(self) -> tuple:
        out = []
        while True:
            kind = None
            for words, name in ((("JOIN",), "INNER"), (("INNER", "JOIN"), "INNER"), (("CROSS", "JOIN"), "CROSS")):
                if self.take(*words):
                    kind = name
            for side in ("LEFT", "RIGHT", "FULL"):
                if kind is None and (self.take(side, "OUTER", "JOIN") or self.take(side, "JOIN")):
                    kind = side
            if kind is None:
                return tuple(out)
            right = self.table()
            on, using = None, ()
            if self.take("ON"):
                on = self.expr()
            elif self.take("USING"):
                using = self.in_parens(self.name)
            elif kind != "CROSS":
                self.need("ON")
            out.append(N.Join(kind, right, on, using))

    # statements

    def script(self) -> list[N.Node]:
        out = []
        while self.now.kind != "end":
            if not self.take(";"):
                out.append(self.statement())
                if self.now.kind != "end" and not self.is_(";") and self.now.word not in _STARTS:
                    raise SqlError(f"unexpected {self.now.text!r} at {self.now.at}")
        return out

    def statement(self) -> N.Node:
        word = self.now.word
        if word in ("SELECT", "WITH") or self.is_("("):
            return self.query()
        one = _STARTS.get(word)
        if one is None:
            raise SqlError(f"no statement starts with {self.now.text or 'the end'!r}, at {self.now.at}")
        self.at += 1
        return getattr(self, one)()

    def assignment(self) -> tuple:
        parts = self.names()
        self.need("=")
        return parts[-1], self.default_or_expr()

    def default_or_expr(self) -> N.Node:
        return N.Col(("DEFAULT",)) if self.take("DEFAULT") else self.expr()

    def output(self) -> tuple[tuple, str | None]:
        """OUTPUT list [INTO table] of T-SQL."""
        if not self.take("OUTPUT"):
            return (), None
        items = self.listed(self.item)
        into = None
        if self.take("INTO"):
            self.take("@")
            into = self.tokens[self.at].text if self.now.kind == "param" else None
            if into:
                self.at += 1
            else:
                into = self.name()
        return items, into

    def returning(self) -> tuple:
        return self.listed(self.item) if self.take("RETURNING") else ()

    def insert_(self) -> N.Node:
        self.take("INTO")
        table = N.Table(self.names(), self.name() if self.take("AS") else None)
        columns = self.in_parens(self.name) if self.is_("(") and self.ahead().word not in ("SELECT", "WITH") else ()
        output, into = self.output()
        rows, query = (), None
        if self.take("VALUES"):
            rows = self.listed(lambda: self.in_parens(self.default_or_expr))
        elif self.take("("):
            query = self.query()
            self.need(")")
        else:
            query = self.query()
        conflict = None
        if self.take("ON", "DUPLICATE", "KEY", "UPDATE"):
            conflict = N.Conflict((), None, None, self.listed(self.assignment), None, True)
        elif self.take("ON", "CONFLICT"):
            target, where, constraint = (), None, None
            if self.take("ON", "CONSTRAINT"):
                constraint = self.name()
            elif self.is_("("):
                target = self.in_parens(self.name)
                where = self.expr() if self.take("WHERE") else None
            self.need("DO")
            if self.take("NOTHING"):
                conflict = N.Conflict(target, where, constraint, (), None)
            else:
                self.need("UPDATE", "SET")
                conflict = N.Conflict(target, where, constraint, self.listed(self.assignment), self.expr() if self.take("WHERE") else None)
        return N.Insert(table, columns, rows, query, conflict, output or self.returning(), into)

    def update_(self) -> N.Node:
        table = self.table()
        joins = self.joins()
        self.need("SET")
        sets = self.listed(self.assignment)
        output, into = self.output()
        source: tuple = ()
        if self.take("FROM"):
            source = self.listed(self.table)
            joins += self.joins()
        where = self.expr() if self.take("WHERE") else None
        return N.Update(table, sets, source, joins, where, output or self.returning(), into)

    def delete_(self) -> N.Node:
        target = None
        if not self.take("FROM"):
            target = self.names()
            output, into = self.output()
            self.need("FROM")
        table = self.table()
        joins = self.joins()
        source: tuple = ()
        if self.take("USING"):
            source = self.listed(self.table)
        if target is None:
            output, into = self.output()
        elif (table.alias or table.parts[-1]).lower() != target[-1].lower():
            raise SqlError(f"the target {'.'.join(target)} must be the first table after FROM")
        where = self.expr() if self.take("WHERE") else None
        return N.Delete(table, source, joins, where, output or self.returning(), into)

    def merge_(self) -> N.Node:
        self.take("INTO")
        table = self.table()
        self.need("USING")
        source = self.table()
        self.need("ON")
        on, whens = self.expr(), []
        while self.take("WHEN"):
            kind = "MATCHED"
            if self.take("NOT", "MATCHED"):
                kind = "TARGET" if self.take("BY", "SOURCE") else "SOURCE"
                self.take("BY", "TARGET")
            else:
                self.need("MATCHED")
            condition = self.expr() if self.take("AND") else None
            self.need("THEN")
            if self.take("UPDATE"):
                self.need("SET")
                pairs = self.listed(self.assignment)
                whens.append(N.When(kind, condition, "UPDATE", tuple(c for c, _ in pairs), tuple(v for _, v in pairs)))
            elif self.take("DELETE"):
                whens.append(N.When(kind, condition, "DELETE"))
            else:
                self.need("INSERT")
                columns = self.in_parens(self.name) if self.is_("(") else ()
                self.need("VALUES")
                whens.append(N.When(kind, condition, "INSERT", columns, self.in_parens(self.default_or_expr)))
        output, into = self.output()
        return N.Merge(table, source, on, tuple(whens), output or self.returning(), into)

    def column(self) -> N.ColumnDef:
        name, type_ = self.name(), self.type()
        found: dict = {"primary": False}
        if type_.name in ("SERIAL", "BIGSERIAL", "SMALLSERIAL"):
            found["identity"] = (1, 1)
        while True:
            if self.take("NOT", "NULL"):
                found["nullable"] = False
            elif self.take("NULL"):
                found["nullable"] = True
            elif self.take("UNIQUE"):
                found["unique"] = True
            elif self.take("PRIMARY", "KEY"):
                found |= {"primary": True, "nullable": False}
            elif self.take("DEFAULT"):
                found["default"] = self.expr(COMPARE)
            elif self.take("AUTO_INCREMENT"):
                found["identity"] = (1, 1)
            elif self.take("IDENTITY"):
                found["identity"] = tuple(int(x) for x in self.in_parens(self.number)) if self.is_("(") else (1, 1)
            elif self.take("GENERATED", "ALWAYS", "AS", "IDENTITY") or self.take("GENERATED", "BY", "DEFAULT", "AS", "IDENTITY"):
                found["identity"] = (1, 1)
            elif self.take("CHECK"):
                found["check"] = self.in_parens(self.expr)[0]
            elif self.take("REFERENCES"):
                found["references"] = (self.names(), self.in_parens(self.name) if self.is_("(") else (), tuple(self.rules().items()))
            else:
                return N.ColumnDef(name, type_, **found)

    def constraint(self) -> N.Constraint:
        name = self.name() if self.take("CONSTRAINT") else None
        if self.take("PRIMARY", "KEY"):
            return N.Constraint("PRIMARY KEY", name, self.in_parens(self.name))
        if self.take("UNIQUE"):
            return N.Constraint("UNIQUE", name, self.in_parens(self.name))
        if self.take("CHECK"):
            return N.Constraint("CHECK", name, check=self.in_parens(self.expr)[0])
        self.need("FOREIGN", "KEY")
        columns = self.in_parens(self.name)
        self.need("REFERENCES")
        table, target = self.names(), self.in_parens(self.name)
        return N.Constraint("FOREIGN KEY", name, columns, None, table, target, **self.rules())

    def rules(self) -> dict[str, str]:
        """What a foreign key does ON DELETE and ON UPDATE."""
        out = {}
        while self.is_("ON", "DELETE") or self.is_("ON", "UPDATE"):
            self.need("ON")
            event = "on_delete" if self.take("DELETE") else "on_update"
            if event == "on_update":
                self.need("UPDATE")
            for words in (("CASCADE",), ("RESTRICT",), ("NO", "ACTION"), ("SET", "NULL"), ("SET", "DEFAULT")):
                if self.take(*words):
                    out[event] = " ".join(words)
                    break
            else:
                raise SqlError(f"expected an action at {self.now.at}")
        return out

    def is_constraint(self) -> bool:
        return self.now.word in ("CONSTRAINT", "FOREIGN", "CHECK") or self.is_("PRIMARY", "KEY") or self.is_("UNIQUE", "(")

    def create_(self) -> N.Node:
        replace_ = self.take("OR", "REPLACE")
        if self.take("VIEW"):
            return self.view(replace_, False)
        unique = self.take("UNIQUE")
        if self.take("INDEX"):
            name = self.name()
            self.need("ON")
            table = self.names()
            columns = self.in_parens(lambda: self.order_item())
            return N.CreateIndex(name, table, columns, unique, self.expr() if self.take("WHERE") else None)
        self.need("TABLE")
        missing = self.take("IF", "NOT", "EXISTS")
        name = self.names()
        if self.take("AS"):
            return N.CreateTable(name, (), (), missing, self.query())
        parts = self.in_parens(lambda: self.constraint() if self.is_constraint() else self.column())
        return N.CreateTable(name, tuple(p for p in parts if isinstance(p, N.ColumnDef)), tuple(p for p in parts if isinstance(p, N.Constraint)), missing)

    def view(self, replace_: bool, alter: bool) -> N.Node:
        name = self.names()
        columns = self.in_parens(self.name) if self.is_("(") else ()
        self.need("AS")
        return N.CreateView(name, columns, self.query(), replace_, alter)

    def alter_(self) -> N.Node:
        if self.take("VIEW"):
            return self.view(True, True)
        self.need("TABLE")
        name = self.names()
        return N.Alter(name, self.listed(self.alteration))

    def alteration(self) -> tuple:
        if self.take("ADD"):
            if self.is_constraint():
                return "ADD CONSTRAINT", self.constraint()
            self.take("COLUMN")
            return "ADD", self.column()
        if self.take("DROP"):
            if self.take("CONSTRAINT"):
                return "DROP CONSTRAINT", self.name()
            self.take("COLUMN")
            return "DROP", self.name()
        if self.take("RENAME"):
            if self.take("TO"):
                return "RENAME TO", self.names()
            self.take("COLUMN")
            old = self.name()
            self.need("TO")
            return "RENAME", old, self.name()
        if self.take("MODIFY"):
            self.take("COLUMN")
            column = self.column()
            return "CHANGE", column.name, column
        if self.take("CHANGE"):
            self.take("COLUMN")
            return "CHANGE", self.name(), self.column()
        self.need("ALTER")
        self.take("COLUMN")
        name = self.name()
        if self.take("SET", "DEFAULT"):
            return "SET DEFAULT", name, self.expr()
        if self.take("DROP", "DEFAULT"):
            return "SET DEFAULT", name, None
        if self.take("SET", "NOT", "NULL"):
            return "NULLABLE", name, False
        if self.take("DROP", "NOT", "NULL"):
            return "NULLABLE", name, True
        self.take("SET", "DATA")
        self.take("TYPE")
        return "TYPE", name, self.type()

    def drop_(self) -> N.Node:
        for kind in ("TABLE", "VIEW", "INDEX"):
            if self.take(kind):
                exists = self.take("IF", "EXISTS")
                names = self.listed(self.names)
                if self.take("ON"):
                    self.names()
                return N.Drop(kind, names, exists)
        raise SqlError(f"expected TABLE, VIEW or INDEX at {self.now.at}")

    def rename_(self) -> N.Node:
        self.need("TABLE")

        def pair() -> tuple:
            old = self.names()
            self.need("TO")
            return old, self.names()

        return N.Rename(self.listed(pair))

    def transaction_(self) -> N.Node:
        self.take("TRANSACTION") or self.take("WORK")
        level = None
        if self.take("ISOLATION", "LEVEL"):
            words = []
            while self.now.word in ("READ", "COMMITTED", "UNCOMMITTED", "REPEATABLE", "SERIALIZABLE", "SNAPSHOT"):
                words.append(self.now.word)
                self.at += 1
            level = " ".join(words)
        return N.Transaction("BEGIN", None, level)

    def commit_(self) -> N.Node:
        self.take("TRANSACTION") or self.take("WORK")
        return N.Transaction("COMMIT")

    def rollback_(self) -> N.Node:
        self.take("TRANSACTION") or self.take("WORK")
        if self.take("TO"):
            self.take("SAVEPOINT")
            return N.Transaction("ROLLBACK TO", self.name())
        return N.Transaction("ROLLBACK")

    def savepoint_(self) -> N.Node:
        return N.Transaction("SAVEPOINT", self.name())

    def release_(self) -> N.Node:
        self.take("SAVEPOINT")
        return N.Transaction("RELEASE", self.name())


_STARTS = {
    "SELECT": "query", "WITH": "query", "INSERT": "insert_", "UPDATE": "update_", "DELETE": "delete_", "MERGE": "merge_",
    "CREATE": "create_", "ALTER": "alter_", "DROP": "drop_", "RENAME": "rename_", "BEGIN": "transaction_",
    "START": "transaction_", "COMMIT": "commit_", "ROLLBACK": "rollback_", "SAVEPOINT": "savepoint_", "RELEASE": "release_",
}


def _decimal(text: str):
    from decimal import Decimal

    return float(text) if "e" in text.lower() else Decimal(text)


def parse(text: str, dialect: str = "ansi") -> N.Node:
    """One statement."""
    found = parse_script(text, dialect)
    if len(found) != 1:
        raise SqlError(f"expected one statement, found {len(found)}")
    return found[0]


def parse_script(text: str, dialect: str = "ansi") -> list[N.Node]:
    """All statements of a script."""
    return Parser(text, dialect).script()
