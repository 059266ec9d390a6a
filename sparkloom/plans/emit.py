"""Syntax tree to Spark SQL text; what Spark's SQL lacks is put in terms of what it has."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal

from ..functions.dialect import AGGREGATES, RENAMED, date_pattern, interval_parts, spark_type
from . import nodes as N
from .lexer import DIALECTS, SqlError

MIRROR = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
INTEGERS = ("byte", "tinyint", "short", "smallint", "integer", "int", "long", "bigint")
JOIN_HINTS = {"LOOP JOIN": "SHUFFLE_REPLICATE_NL", "HASH JOIN": "SHUFFLE_HASH", "MERGE JOIN": "MERGE"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Emitter:
    """views maps table names, lower case, to the names of views; half_even says how ROUND treats halves; types gives the
    types of a query's columns."""

    def __init__(self, dialect: str = "ansi", views: dict[str, str] | None = None, half_even: bool = False, types: Callable[[str], list[str] | None] | None = None) -> None:
        self.dialect, self.views, self.half_even, self.types = DIALECTS[dialect], views or {}, half_even, types
        self.ctes: list[set[str]] = []
        self.heads: list[str] = []  # WITH clauses around the query at hand
        self.scopes: list[tuple[str, dict[str, str]]] = []  # FROM clauses around it, and the labels of db.table in them

    # expressions

    def literal(self, v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return string(v)
        if isinstance(v, float):
            return f"{v!r}D"
        if isinstance(v, (int, Decimal)):
            return str(v) if not isinstance(v, int) or -(2**31) <= v < 2**31 else f"{v}L"
        return f"CAST({string(str(v))} AS {'timestamp_ntz' if hasattr(v, 'hour') else 'date'})"

    def expr(self, x: N.Node) -> str:
        return getattr(self, "e_" + type(x).__name__.lower())(x)

    def all(self, xs) -> str:
        return ", ".join(map(self.expr, xs))

    def e_lit(self, x):
        return self.literal(x.value)

    def e_param(self, x):
        return f":{x.name}" if x.name else "?"

    def e_col(self, x):
        return ".".join(map(quoted, self._within(x.parts)))

    def e_star(self, x):
        but = f" EXCEPT ({', '.join(map(quoted, x.but))})" if x.but else ""
        return ".".join([*map(quoted, self._within((*x.table, ""))[:-1]), "*"]) + but

    def _within(self, parts: tuple) -> tuple:
        """db.table.column as label.column, where a FROM clause around has that table."""
        if len(parts) == 3:
            for _, labels in reversed(self.scopes):
                if label := labels.get(".".join(parts[:2]).lower()):
                    return label, parts[2]
        return parts

    def e_un(self, x):
        return f"({x.op} {self.expr(x.arg)})"

    def e_bin(self, x):
        left, right = self.expr(x.left), self.expr(x.right)
        if x.op == "/" and self.dialect.whole_division:
            types = self._types(left, right)
            if types is None:  # seen by the query around only: told apart as it runs
                whole = " AND ".join(f"typeof({y}) IN ({', '.join(map(string, INTEGERS))})" for y in (left, right))
                return f"(CASE WHEN {whole} THEN {left} div {right} ELSE {left} / {right} END)"
            if set(types) <= set(INTEGERS):
                return f"CAST({left} div {right} AS {max(types, key=list(INTEGERS).index)})"
        if x.op == "+" and self.dialect.plus_joins and (types := self._types(left, right)) and "string" in types and set(types) <= {"string", "void"}:
            return f"concat({left}, {right})"
        return f"({left} {x.op} {right})"

    def _types(self, *exprs: str) -> list[str] | None:
        """The types of expressions where they stand."""
        if self.types is None:
            return None
        source = f" FROM {self.scopes[-1][0]}" if self.scopes and self.scopes[-1][0] else ""
        return self.types(f"{''.join(self.heads[-1:])}SELECT {', '.join(f'{e} AS t{i}' for i, e in enumerate(exprs))}{source}")

    def e_like(self, x):
        arg, pattern = self.expr(x.arg), self.expr(x.pattern)
        if x.escape is not None:
            return f"({arg} LIKE {pattern} ESCAPE {self.expr(x.escape)})"
        if isinstance(x.pattern, N.Lit) and isinstance(x.pattern.value, str):
            text = x.pattern.value
            # a backslash escapes what follows in MySQL and PostgreSQL, and is a character as any other elsewhere
            text = re.sub(r"\\(?![%_\\])", "", re.sub(r"\\\\", "\0", text)).replace("\0", "\\\\") if self.dialect.escapes else text.replace("\\", "\\\\")
            return f"({arg} LIKE {string(text)})"
        return f"({arg} LIKE {pattern})" if self.dialect.escapes else f"({arg} LIKE replace({pattern}, {string(chr(92))}, {string(chr(92) * 2)}))"

    def e_in(self, x):
        no = "NOT " if x.negated else ""
        if isinstance(x.items, N.Query):
            return f"({self.expr(x.arg)} {no}IN ({self.query(x.items)}))"
        return f"({self.expr(x.arg)} {no}IN ({self.all(x.items)}))" if x.items else self.literal(x.negated)

    def e_between(self, x):
        return f"({self.expr(x.arg)} {'NOT ' * x.negated}BETWEEN {self.expr(x.low)} AND {self.expr(x.high)})"

    def e_isnull(self, x):
        return f"({self.expr(x.arg)} IS {'NOT ' * x.negated}NULL)"

    def e_case(self, x):
        whens = " ".join(f"WHEN {self.expr(c)} THEN {self.expr(v)}" for c, v in x.whens)
        base = f" {self.expr(x.base)}" if x.base else ""
        return f"CASE{base} {whens}{f' ELSE {self.expr(x.default)}' if x.default else ''} END"

    def e_cast(self, x):
        type_ = spark_type(x.type.name, x.type.args, x.type.dims)
        if x.type.dims and isinstance(x.arg, N.Lit) and isinstance(x.arg.value, str):  # '{1,2}'::int[]
            return f"from_json({string(self._array_json(x.arg.value))}, {string(type_)})"
        return f"CAST({self.expr(x.arg)} AS {type_})"

    def _array_json(self, text: str) -> str:
        text = text.replace("{", "[").replace("}", "]")
        return re.sub(r'(?<=[\[,])\s*([^\[\],"\s][^\[\],"]*?)\s*(?=[\],])', lambda m: m[1] if re.fullmatch(r"-?[\d.]+|true|false|null", m[1], re.I) else json.dumps(m[1]), text)

    def e_exists(self, x):
        return f"EXISTS ({self.query(x.query)})"

    def e_sub(self, x):
        return f"({self.query(x.query)})"

    def e_array(self, x):
        return f"array({self.all(x.items)})"

    def e_index(self, x):
        arg = self.expr(x.arg)
        if not x.slice:
            return f"try_element_at({arg}, nullif({self.expr(x.low)}, 0))"
        # what lies before the first element or after the last is left out
        low = f"greatest({self.expr(x.low)}, 1)" if x.low is not None else "1"
        high = self.expr(x.high) if x.high is not None else f"size({arg})"
        return f"slice({arg}, {low}, greatest({high} - {low} + 1, 0))"

    def e_interval(self, x):
        raise SqlError("an interval stands only in a sum of dates")

    def e_call(self, x):
        name, args = x.name, x.args
        if name in ("DATE_ADD", "DATE_SUB", "ADDDATE", "SUBDATE") and len(args) == 2 and isinstance(args[1], N.Interval):
            return self.shifted(args[0], args[1], name in ("DATE_SUB", "SUBDATE"))
        if name in ("DATE_FORMAT", "STR_TO_DATE") and len(args) == 2 and isinstance(args[1], N.Lit):
            pattern = date_pattern(str(args[1].value))
            if name == "DATE_FORMAT":
                return f"date_format({self.expr(args[0])}, {string(pattern)})"
            has_time = any(c in re.sub("'.'", "", pattern) for c in "Hhms")
            return f"{'to_timestamp_ntz' if has_time else 'to_date'}({self.expr(args[0])}, {string(pattern)})"
        if name[:4] in ("ANY ", "ALL "):
            op = name[4:]
            value, array = self.expr(args[0]), self.expr(args[1])
            if name == "ANY =":
                return f"array_contains({array}, {value})"
            return f"{'exists' if name.startswith('ANY') else 'forall'}({array}, x__ -> x__ {MIRROR[op]} {value})"
        if name == "COUNT" and x.distinct and x.over:
            return f"size(collect_set({self.all(args)}) OVER {self.window(x.over)})"
        if name == "ROUND" and self.half_even:
            name = "BROUND"
        out = f"{RENAMED.get(name, name.lower() if re.fullmatch(r'[A-Za-z_][A-Za-z0-9_]*', name) else quoted(name))}({'DISTINCT ' * x.distinct}{self.all(args)})"
        return f"{out} OVER {self.window(x.over)}" if x.over else out

    def shifted(self, date: N.Node, interval: N.Interval, minus: bool) -> str:
        out, units = self.expr(date), interval_parts(interval.unit)
        if len(units) == 1:
            values = [self.expr(interval.value)]
        else:
            if not isinstance(interval.value, N.Lit):
                raise SqlError(f"an interval in {interval.unit} needs a literal")
            values = re.findall(r"\d+", str(interval.value.value))
            units = units[len(units) - len(values) :]
            if units[-1] == "MICROSECOND":  # digits after the point
                values[-1] = values[-1].ljust(6, "0")
            if units == ["YEAR", "MONTH"]:  # one step: a day that a month lacks is cut once
                units, values = ["MONTH"], [str(12 * int(values[0]) + int(values[1]))]
            minus ^= str(interval.value.value).strip().startswith("-")
        for unit, value in zip(units, values, strict=True):
            out = f"timestampadd({unit}, {'-' * minus}({value}), {out})"
        return out

    def window(self, w: N.Window) -> str:
        parts = []
        if w.partition:
            parts.append(f"PARTITION BY {self.all(w.partition)}")
        if w.order:
            parts.append(f"ORDER BY {', '.join(map(self.order, w.order))}")
        if w.frame:
            parts.append(f"{w.frame.mode} BETWEEN {self.bound(w.frame.start)} AND {self.bound(w.frame.end)}")
        return f"({' '.join(parts)})"

    def bound(self, b: tuple) -> str:
        return b[1] if b[1] == "CURRENT ROW" else f"{'UNBOUNDED' if b[0] is None else self.expr(b[0])} {b[1]}"

    def order(self, o: N.Order) -> str:
        return self.expr(o.expr) + " DESC" * o.desc + (f" NULLS {o.nulls}" if o.nulls else "")

    # JSON

    def e_json(self, x):
        if x.op in ("->", "->>", "#>", "#>>"):
            base, path = self._path(x)
            if x.op in ("->>", "#>>"):
                return f"get_json_object({self.expr(base)}, {string(path)})"
            return f"to_json(variant_get(parse_json({self.expr(base)}), {string(path)}, 'variant'))"
        if x.op == "<@":
            return self.e_json(N.Json("@>", x.right, x.left))
        doc = self.expr(x.left)
        if x.op == "@>":
            lit = x.right.arg if isinstance(x.right, N.Cast) else x.right
            if not isinstance(lit, N.Lit):
                raise SqlError("the contained document must be a literal")
            want, variant = json.loads(lit.value, parse_float=Decimal), f"parse_json({doc})"
            test = self._contains(variant, want)
            if not isinstance(want, (dict, list)):  # a document that is a list contains its elements
                test = f"({test} OR {self._contains(variant, [want])})"
            return f"if({doc} IS NULL, NULL, {test})"
        if x.op == "?":
            return self._has_key(doc, self.expr(x.right))
        function = "exists" if x.op == "?|" else "forall"
        return f"{function}({self.expr(x.right)}, k__ -> {self._has_key(doc, 'k__')})"

    def _has_key(self, doc: str, key: str) -> str:
        """Whether key is a key of an object, a text in a list, or the text that the document is."""
        text = lambda v: f"coalesce(schema_of_variant({v}) = 'STRING' AND try_variant_get({v}, '$', 'string') = {key}, false)"
        variant = f"parse_json({doc})"
        member = f"coalesce(exists(try_variant_get({variant}, '$', 'array<variant>'), e__ -> {text('e__')}), false)"
        return f"if({doc} IS NULL, NULL, coalesce(array_contains(json_object_keys({doc}), {key}), false) OR {member} OR {text(variant)})"

    def _path(self, x: N.Node) -> tuple[N.Node, str]:
        if isinstance(x, N.Json) and x.op in ("->", "->>", "#>", "#>>"):
            base, path = self._path(x.left)
            if not isinstance(x.right, N.Lit):
                raise SqlError("a JSON path must be literal")
            v = x.right.value
            steps = [v] if x.op in ("->", "->>") else [int(s) if s.isdigit() else s for s in v.strip("{}").split(",")]
            return base, path + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
        return x, "$"

    def _contains(self, v: str, want, depth: int = 0) -> str:
        """The variant v contains want: all keys of an object, each element of a list in some element, an equal value of the same type."""
        kind = f"schema_of_variant({v})"
        if isinstance(want, dict):
            tests = [f"{kind} LIKE 'OBJECT<%'"]
            for k, w in want.items():
                step = k.replace("\\", "\\\\").replace('"', '\\"')
                tests.append(self._contains(f"try_variant_get({v}, {string(f'$["{step}"]')}, 'variant')", w, depth))
        elif isinstance(want, list):
            tests, e = [f"{kind} LIKE 'ARRAY<%'"], f"e{depth}__"
            tests += [f"exists(try_variant_get({v}, '$', 'array<variant>'), {e} -> {self._contains(e, w, depth + 1)})" for w in want]
        elif want is None:
            tests = [f"{kind} = 'VOID'"]
        elif isinstance(want, bool):
            tests = [f"{kind} = 'BOOLEAN'", f"try_variant_get({v}, '$', 'boolean') = {str(want).lower()}"]
        elif isinstance(want, str):
            tests = [f"{kind} = 'STRING'", f"try_variant_get({v}, '$', 'string') = {string(want)}"]
        else:
            tests = [f"({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {kind} LIKE 'DECIMAL%')", f"try_variant_get({v}, '$', 'decimal(38,9)') = CAST('{want}' AS decimal(38,9))"]
        return f"coalesce({' AND '.join(tests)}, false)"

    # queries

    def query(self, q: N.Query) -> str:
        if isinstance(q, N.Select):
            q = N.Query(q)
        self.ctes.append({c.name.lower() for c in q.ctes})
        try:
            head = ""
            if q.ctes:
                each = (f"{quoted(c.name)}{'(' + ', '.join(map(quoted, c.columns)) + ')' if c.columns else ''} AS ({self.query(c.query)})" for c in q.ctes)
                head = f"WITH {'RECURSIVE ' * q.recursive}{', '.join(each)} "
                self.heads.append(head)
            body = self.branch(q.first, q)
            for op, branch in q.rest:  # left to right, without precedence
                body = f"({body}) {op} ({self.branch(branch, None)})"
            if q.order:
                body += f" ORDER BY {', '.join(map(self.order, q.order))}"
            if q.limit is not None:
                body += f" LIMIT {self.expr(q.limit)}"
            if q.offset is not None:
                body += f" OFFSET {self.expr(q.offset)}"
            return head + body
        finally:
            self.ctes.pop()
            if head:
                self.heads.pop()

    def branch(self, b: N.Node, owner: N.Query | None) -> str:
        if isinstance(b, N.Query):
            return f"({self.query(b)})"
        return self.select(b)

    def select(self, s: N.Select) -> str:
        s = self._aliases(self._groups_frames(s))
        if s.top:
            raise SqlError("TOP stands in a query that Engine.query has not seen")
        hints = [f"{JOIN_HINTS[h]}({', '.join(self.label(j.right) for j in s.joins)})" for h in s.hints if h in JOIN_HINTS and s.joins]
        s = self._labelled(s)
        labels = {".".join(t.parts).lower(): t.alias or t.parts[-1] for t in (*s.source, *(j.right for j in s.joins)) if isinstance(t, N.Table)}
        # ON may name the tables that FROM has; types are asked for once all of it is known
        self.scopes.append(("", labels))
        try:
            source = f"{', '.join(map(self.table, s.source))}{self.joins(s.joins)}" if s.source else ""
            self.scopes[-1] = (source, labels)
            out = f"SELECT {f'/*+ {', '.join(hints)} */ ' if hints else ''}{'DISTINCT ' * s.distinct}{', '.join(self.items(s.items))}"
            if s.source:
                out += f" FROM {source}"
            if s.where is not None:
                out += f" WHERE {self.expr(s.where)}"
            if s.group:
                out += f" GROUP BY {', '.join(map(self.grouping, s.group))}"
            if s.having is not None:
                out += f" HAVING {self.expr(s.having)}"
        finally:
            self.scopes.pop()
        return out

    def _labelled(self, s: N.Select) -> N.Select:
        """Tables of two databases that share a name, without alias, labelled with both."""
        tables = [t for t in (*s.source, *(j.right for j in s.joins)) if isinstance(t, N.Table)]
        names = [(t.alias or t.parts[-1]).lower() for t in tables]

        def put(t: N.Node) -> N.Node:
            if isinstance(t, N.Table) and t.alias is None and len(t.parts) > 1 and names.count(t.parts[-1].lower()) > 1:
                return replace(t, alias=".".join(t.parts))
            return t

        return replace(s, source=tuple(map(put, s.source)), joins=tuple(replace(j, right=put(j.right)) for j in s.joins))

    def items(self, items: tuple) -> list[str]:
        """The SELECT list, columns named as the rules say: alias, Table.Column where a name comes twice, NAME(col)."""
        names = [i.alias or (i.expr.parts[-1] if isinstance(i.expr, N.Col) else None) for i in items]
        out = []
        for i, name in zip(items, names, strict=True):
            alias = i.alias
            if alias is None and isinstance(i.expr, N.Col) and names.count(name) > 1 and len(i.expr.parts) > 1:
                alias = ".".join(i.expr.parts[-2:])
            if alias is None and isinstance(i.expr, N.Call) and i.expr.name in AGGREGATES and not i.expr.over:
                arg = i.expr.args[0] if i.expr.args else None
                alias = f"{i.expr.name}({arg.parts[-1]})" if isinstance(arg, N.Col) else i.expr.name
            out.append(self.expr(i.expr) + (f" AS {quoted(alias)}" if alias else ""))
        return out

    def _aliases(self, s: N.Select) -> N.Select:
        """SELECT aliases put in for their names in WHERE and ON, but for an alias that its own expression uses as a column."""
        known = {}
        for i in s.items:
            if i.alias and not any(isinstance(x, N.Call) and (x.over or x.name in AGGREGATES) for x in N.walk(i.expr)):
                if not any(isinstance(x, N.Col) and x.parts[-1].lower() == i.alias.lower() for x in N.walk(i.expr)):
                    known[i.alias.lower()] = i.expr
        if not known:
            return s
        def put(x):
            """Not below: a query within has names of its own."""
            if isinstance(x, tuple):
                return tuple(map(put, x))
            if isinstance(x, N.Col):
                return known.get(x.parts[0].lower(), x) if len(x.parts) == 1 else x
            return N.children(x, put) if isinstance(x, N.Node) and not isinstance(x, N.Query) else x

        joins = tuple(replace(j, on=put(j.on)) if j.on is not None else j for j in s.joins)
        return replace(s, where=put(s.where), joins=joins)

    def _groups_frames(self, s: N.Select) -> N.Select:
        """GROUPS frames as RANGE frames over dense_rank, which a subquery adds."""
        ranks: dict[N.Window, str] = {}
        for x in N.walk(s.items):
            if isinstance(x, N.Call) and x.over and x.over.frame and x.over.frame.mode == "GROUPS":
                ranks.setdefault(N.Window(x.over.partition, x.over.order), f"g__{len(ranks)}")
        if not ranks:
            return s
        if len(s.source) != 1 or s.joins or s.group:
            return self._groups_over(s, ranks)
        items = (N.Item(N.Star()), *(N.Item(N.Call("DENSE_RANK", (), False, w), name) for w, name in ranks.items()))
        inner = N.Select(items, source=s.source, where=s.where)

        def change(x):
            if isinstance(x, N.Call) and x.over and x.over.frame and x.over.frame.mode == "GROUPS":
                rank = N.Col((ranks[N.Window(x.over.partition, x.over.order)],))
                return replace(x, over=N.Window(x.over.partition, (N.Order(rank),), replace(x.over.frame, mode="RANGE")))
            return x

        label = s.source[0].alias or (s.source[0].parts[-1] if isinstance(s.source[0], N.Table) else "t__")
        return replace(s, items=N.transform(s.items, change), source=(N.Derived(N.Query(inner), label),), where=None)

    def _groups_over(self, s: N.Select, ranks: dict[N.Window, str]) -> N.Select:
        """GROUPS frames over joins or groups: a derived table has each column and aggregate that the list uses, and the ranks."""
        atoms: dict[N.Node, str] = {}

        def lift(x):
            if isinstance(x, tuple):
                return tuple(map(lift, x))
            if isinstance(x, N.Star) and x != N.Star():
                raise SqlError("a GROUPS frame over a join or groups needs the columns by name")
            if isinstance(x, N.Col) or isinstance(x, N.Call) and x.name in AGGREGATES and not x.over:
                return N.Col((atoms.setdefault(x, f"c__{len(atoms)}"),))
            if isinstance(x, N.Call) and x.over and x.over.frame and x.over.frame.mode == "GROUPS":
                over = N.Window(lift(x.over.partition), (N.Order(N.Col((ranks[N.Window(x.over.partition, x.over.order)],))),), replace(x.over.frame, mode="RANGE"))
                return replace(x, args=lift(x.args), over=over)
            return N.children(x, lift) if isinstance(x, N.Node) and not isinstance(x, N.Query) else x

        items = tuple(N.Item(lift(i.expr), i.alias or (i.expr.parts[-1] if isinstance(i.expr, N.Col) else None)) for i in s.items)
        inner = (*(N.Item(x, name) for x, name in atoms.items()), *(N.Item(N.Call("DENSE_RANK", (), False, w), name) for w, name in ranks.items()))
        return N.Select(items, distinct=s.distinct, source=(N.Derived(N.Query(replace(s, items=inner, distinct=False)), "t__"),))

    def grouping(self, g: N.Node) -> str:
        if not isinstance(g, N.Grouping):
            return self.expr(g)
        if g.kind == "GROUPING SETS":
            return f"GROUPING SETS ({', '.join(f'({self.all(s)})' for s in g.sets)})"
        return f"{g.kind}({self.all(g.sets)})"

    def label(self, t: N.Node) -> str:
        return quoted(t.alias or t.parts[-1])

    def table(self, t: N.Node) -> str:
        if isinstance(t, N.Derived):
            columns = f"({', '.join(map(quoted, t.columns))})" if t.columns else ""
            return f"({self.query(t.query)}) AS {quoted(t.alias)}{columns}"
        name = t.parts[-1].lower()
        if len(t.parts) == 1 and any(name in c for c in self.ctes):
            return ".".join(map(quoted, t.parts)) + (f" AS {quoted(t.alias)}" if t.alias else "")
        view = self.views.get(".".join(t.parts).lower()) or (self.views.get(name) if len(t.parts) == 1 else None)
        return f"{quoted(view)} AS {quoted(t.alias or t.parts[-1])}" if view else ".".join(map(quoted, t.parts)) + (f" AS {quoted(t.alias)}" if t.alias else "")

    def joins(self, joins: tuple) -> str:
        out = ""
        for j in joins:
            out += f" {j.kind} JOIN {self.table(j.right)}"
            if j.on is not None:
                out += f" ON {self.expr(j.on)}"
            elif j.using:
                out += f" USING ({', '.join(map(quoted, j.using))})"
        return out
