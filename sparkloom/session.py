"""Engine: SQL text of several dialects over registered DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import ddl, dml
from .plans import nodes as N
from .plans.emit import Emitter, quoted
from .plans.lexer import SqlError
from .plans.parser import parse, parse_script
from .sources.storage import Sources, stored

#: After so many changes a table's rows are written, so that plans do not grow without end.
STORED_AFTER = 16


@dataclass
class State:
    """What a transaction restores: DataFrames are plans over immutable rows, so a copy of the map is enough."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    definitions: dict[str, ddl.Definition] = field(default_factory=dict)
    views: dict[str, N.CreateView] = field(default_factory=dict)
    age: dict[str, int] = field(default_factory=dict)  # changes of a table since it was read

    def copy(self) -> State:
        return State(dict(self.tables), {k: replace(v) for k, v in self.definitions.items()}, dict(self.views), dict(self.age))


class Engine:
    """Table names are case-insensitive; a name may have a database in front."""

    def __init__(self, spark: SparkSession, sources: Sources | None = None, half_even: bool = False) -> None:
        self.spark, self.sources, self.half_even = spark, sources or Sources(), half_even
        self.state, self.saved, self.changes, self.last_insert_id = State(), [], None, None
        self.prefix = f"sl{id(self)}_"

    def register(self, name: str, df: DataFrame) -> Engine:
        self.state.tables[name.lower()] = df
        return self

    def load_dir(self, folder: str, names: Iterable[str]) -> Engine:
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))
        return self

    @property
    def row_count(self) -> int:
        """Rows that the last INSERT, UPDATE, DELETE or MERGE put in, changed or took out; counted when asked for."""
        return 0 if self.changes is None else self.changes.count()

    def register_function(self, name: str, function: Callable) -> Engine:
        """A pandas UDF, or another Spark UDF, under a name for SQL."""
        self.spark.udf.register(name, function)
        return self

    def table_names(self) -> list[str]:
        return sorted([*self.state.tables, *self.state.views])

    def table(self, name: str) -> DataFrame:
        found = self.state.tables.get(name.lower())
        if found is None and name.lower() in self.state.views:
            view = self.state.views[name.lower()]
            found = self.query(view.query)
            found = found.toDF(*view.columns) if view.columns else found
        if found is None and (found := self.sources.find(name)) is not None:
            self.register(name, found)
        if found is None:
            raise SqlError(f"no table {name}")
        return found

    # text to rows

    def sql(self, text: str, dialect: str = "ansi", params: dict | list | None = None, functions: dict[str, Callable] | None = None):
        """One statement: a DataFrame for a query, a dml.Mutation for a change of rows, None otherwise.

        params are names to values, with or without @, or a list for the marks ?. functions are called once, with
        the values of literal arguments, and their results take their places.
        """
        return self.run(self.bound(parse(text, dialect), params, functions), dialect)

    def script(self, text: str, dialect: str = "ansi", params: dict | list | None = None) -> list:
        return [self.run(self.bound(s, params, None), dialect) for s in parse_script(text, dialect)]

    def unknown_functions(self, text: str, dialect: str = "ansi") -> list[str]:
        """Functions that neither the dialects nor Spark know."""
        from .functions.dialect import AGGREGATES, RENAMED

        special = {"DATE_FORMAT", "STR_TO_DATE", "DATE_ADD", "DATE_SUB", "VALUES", "ROW_COUNT", "LAST_INSERT_ID"}
        names = {x.name for s in parse_script(text, dialect) for x in N.walk(s) if isinstance(x, N.Call)}
        return sorted(n for n in names if n not in AGGREGATES | special | set(RENAMED) and n[:4] not in ("ANY ", "ALL ") and not self.spark.catalog.functionExists(n))

    def bound(self, statement: N.Node, params: dict | list | None, functions: dict[str, Callable] | None) -> N.Node:
        named = {f"?{i}": v for i, v in enumerate(params)} if isinstance(params, (list, tuple)) else {k.lstrip("@").lower(): v for k, v in (params or {}).items()}
        calls = {"ROW_COUNT": lambda: self.row_count, "LAST_INSERT_ID": lambda: self.last_insert_id} | {k.upper(): v for k, v in (functions or {}).items()}

        def put(x: N.Node) -> N.Node:
            if isinstance(x, N.Param):
                if x.name.lower() not in named:
                    raise SqlError(f"no value for parameter {x.name}")
                return N.Lit(named[x.name.lower()])
            if isinstance(x, N.Call) and x.name in calls and not x.over and all(isinstance(a, N.Lit) for a in x.args):
                return N.Lit(calls[x.name](*(a.value for a in x.args)))
            return x

        if any(isinstance(x, N.Type) and x.name == "TIME" for x in N.walk(statement)):
            self.spark.conf.set("spark.sql.timeType.enabled", "true")  # off unless set, and needed until the rows are read
        return N.transform(statement, put)

    def run(self, statement: N.Node, dialect: str = "ansi") -> Any:
        if isinstance(statement, N.Query):
            return self.into(statement, dialect) if isinstance(statement.first, N.Select) and statement.first.into else self.query(statement, dialect)
        if isinstance(statement, N.Transaction):
            return self.transaction(statement)
        before = self.state.copy()
        try:
            if isinstance(statement, (N.Insert, N.Update, N.Delete, N.Merge)):
                return self.change(statement, dialect)
            return ddl.apply(self, statement)
        except Exception:
            self.state = before  # a statement that fails leaves all tables as they were
            raise

    def change(self, statement: N.Node, dialect: str) -> dml.Mutation:
        change, name = dml.apply(self, statement, dialect), dml.target(statement)
        self.state.age[name] = self.state.age.get(name, 0) + 1
        if self.state.age[name] % STORED_AFTER == 0:
            change.table = stored(change.table)
        ddl.check(self, name, change.table)
        self.register(name, change.table)
        if any(".".join(c.table).lower() == name for d in self.state.definitions.values() for c in ddl.foreign_keys(d)):
            ddl.follow(self, name, change.changes)
        if statement.output_into and change.output is not None:
            self.register(statement.output_into, change.output)
        self.changes = change.changes
        return change

    def into(self, q: N.Query, dialect: str) -> DataFrame:
        df = self.query(replace(q, first=replace(q.first, into=None)), dialect)
        self.register(q.first.into, dml.settled(df, q))
        return df

    def emitter(self, node: Any, dialect: str = "ansi") -> Emitter:
        """An emitter for which every table that node names stands as a view."""
        views, ctes = {}, {c.name.lower() for c in N.walk(node) if isinstance(c, N.Cte)}
        for t in N.walk(node):
            if isinstance(t, N.Table):
                name = ".".join(t.parts).lower()
                if name in ctes and name not in self.state.tables:
                    continue
                try:
                    df = self.table(name)
                except SqlError:
                    if name in ctes or self.spark.catalog.tableExists(".".join(t.parts)):
                        continue
                    raise
                views[name] = self.prefix + re.sub(r"\W", "_", name)
                df.createOrReplaceTempView(views[name])
        return Emitter(dialect, views, self.half_even, self.types)

    def types(self, text: str) -> list[str] | None:
        """The types of a query's columns as Spark analyses it, or None if it cannot stand alone."""
        try:
            return [f.dataType.typeName() for f in self.spark_sql(text).schema]
        except SqlError:
            return None

    def spark_sql(self, text: str, names: Iterable[str] = ()) -> DataFrame:
        """text as Spark analyses it; with names that differ only in case, told apart by case."""
        names = list(names)
        clash = len({n.lower() for n in names}) < len(set(names))
        old = self.spark.conf.get("spark.sql.caseSensitive")
        try:
            if clash:
                self.spark.conf.set("spark.sql.caseSensitive", "true")
            return self.spark.sql(text)
        except Exception as e:
            if type(e).__name__ in ("AnalysisException", "ParseException"):
                raise SqlError(str(e).split("\n\n")[0]) from e
            raise
        finally:
            self.spark.conf.set("spark.sql.caseSensitive", old)

    def query(self, q: N.Query, dialect: str = "ansi") -> DataFrame:
        q = self.inner_tops(N.transform(q, _simple_top), dialect, ())
        if isinstance(q.first, N.Select) and q.first.top and not q.rest:
            return self.top(q, dialect)
        names = [i.alias or i.expr.parts[-1] for i in getattr(q.first, "items", ()) if i.alias or isinstance(i.expr, N.Col)]
        return self.spark_sql(self.emitter(q, dialect).query(q), names)

    def inner_tops(self, q: N.Query, dialect: str, ctes: tuple, outermost: bool = True) -> N.Query:
        """TOP PERCENT and WITH TIES below the outermost SELECT, or under set operations, in terms of LIMIT and a semi-join."""

        def inside(x: Any, known: tuple) -> Any:
            if isinstance(x, tuple):
                return tuple(inside(y, known) for y in x)
            if isinstance(x, N.Query):
                return self.inner_tops(x, dialect, known, False)
            if isinstance(x, N.Select) and x.top:
                return self.without_top(N.Query(N.children(x, lambda y: inside(y, known))), dialect, known)
            return N.children(x, lambda y: inside(y, known)) if isinstance(x, N.Node) else x

        bodies: tuple = ()
        for c in q.ctes:
            bodies += (replace(c, query=self.inner_tops(c.query, dialect, ctes + bodies, False)),)
        known = ctes + bodies
        own = isinstance(q.first, N.Select) and q.first.top and not q.rest
        first = N.children(q.first, lambda y: inside(y, known)) if own else inside(q.first, known)
        q = replace(q, ctes=bodies, first=first, rest=tuple((op, inside(b, known)) for op, b in q.rest))
        return self.without_top(q, dialect, known) if own and not outermost else q

    def without_top(self, q: N.Query, dialect: str, ctes: tuple) -> N.Query:
        top, plain = q.first.top, replace(q.first, top=None)
        if not isinstance(top.count, N.Lit):
            raise SqlError("TOP needs a number")
        n = top.count.value
        if top.percent:
            n = -(-self.query(replace(q, first=plain, order=(), ctes=ctes), dialect).count() * n // 100)
        n = N.Lit(int(n))
        if not top.ties or not q.order:
            return replace(q, first=plain, limit=n)
        by_alias = {i.alias.lower(): i.expr for i in plain.items if i.alias}
        keys = [by_alias.get(o.expr.parts[-1].lower(), o.expr) if isinstance(o.expr, N.Col) else o.expr for o in q.order]
        hidden = [f"k__{i}" for i in range(len(keys))]
        wide = replace(plain, items=(*plain.items, *map(N.Item, keys, hidden)))
        order = tuple(replace(o, expr=N.Col((h,))) for o, h in zip(q.order, hidden, strict=True))
        first = N.Query(N.Select((N.Item(N.Star()),), source=(N.Derived(N.Query(wide), "t__"),)), order=order, limit=n)
        first = N.Select(tuple(N.Item(N.Col((h,))) for h in hidden), distinct=True, source=(N.Derived(first, "f__"),))
        on = reduce(lambda a, b: N.Bin("AND", a, b), (N.Bin("<=>", N.Col(("w__", h)), N.Col(("f__", h))) for h in hidden))
        join = N.Join("LEFT SEMI", N.Derived(N.Query(first), "f__"), on)
        outer = N.Select((N.Item(N.Star(("w__",), tuple(hidden))),), source=(N.Derived(N.Query(wide), "w__"),), joins=(join,))
        return N.Query(outer, ctes=q.ctes)

    def top(self, q: N.Query, dialect: str) -> DataFrame:
        """TOP n PERCENT and WITH TIES.

        The share becomes a number by one count. Rows that tie with one of the first n are those whose sort keys occur
        among the first n: a semi-join with the keys of n rows, without numbering all rows in one task.
        """
        top, plain = q.first.top, replace(q.first, top=None)
        if not isinstance(top.count, N.Lit):
            raise SqlError("TOP needs a number")
        n = top.count.value
        if top.percent:
            n = -(-self.query(replace(q, first=plain, order=()), dialect).count() * n // 100)
        if not top.ties or not q.order:
            return self.query(replace(q, first=plain, limit=N.Lit(int(n))), dialect)
        by_alias = {i.alias.lower(): i.expr for i in plain.items if i.alias}
        keys = [by_alias.get(o.expr.parts[-1].lower(), o.expr) if isinstance(o.expr, N.Col) else o.expr for o in q.order]
        hidden = [f"k__{i}" for i in range(len(keys))]
        wide = self.query(replace(q, first=replace(plain, items=(*plain.items, *map(N.Item, keys, hidden))), order=()), dialect)
        order = [_sorted(F.col(h), o) for h, o in zip(hidden, q.order, strict=True)]
        first = wide.orderBy(*order).limit(int(n)).select(*(F.col(h).alias(f"f{h}") for h in hidden)).distinct()
        same = [F.col(h).eqNullSafe(F.col(f"f{h}")) for h in hidden]
        return wide.join(first, same, "left_semi").orderBy(*order).drop(*hidden)

    def transaction(self, t: N.Transaction) -> None:
        """BEGIN and SAVEPOINT copy the map of tables; ROLLBACK puts a copy back; COMMIT drops the copies."""
        marks = [n for n, _ in self.saved]
        if t.action == "BEGIN":
            self.saved = [(None, self.state.copy())]
        elif t.action == "SAVEPOINT":
            self.saved.append((t.name.lower(), self.state.copy()))
        elif t.action == "COMMIT":
            self.saved = []
        elif t.action == "ROLLBACK":
            if not self.saved:
                raise SqlError("no transaction is open")
            self.state, self.saved = self.saved[0][1], []
        else:
            if t.name.lower() not in marks:
                raise SqlError(f"no savepoint {t.name}")
            at = len(marks) - 1 - marks[::-1].index(t.name.lower())
            if t.action == "ROLLBACK TO":
                self.state = self.saved[at][1].copy()
                self.saved = self.saved[: at + 1]
            else:
                self.saved = self.saved[:at]


def _sorted(c, o: N.Order):
    if o.nulls:
        return getattr(c, f"{'desc' if o.desc else 'asc'}_nulls_{o.nulls.lower()}")()
    return c.desc() if o.desc else c.asc()


def _simple_top(q: N.Node) -> N.Node:
    """A plain TOP n as a limit."""
    if isinstance(q, N.Query) and isinstance(q.first, N.Select) and q.first.top and not q.rest and not (q.first.top.percent or q.first.top.ties):
        return replace(q, first=replace(q.first, top=None), limit=q.first.top.count)
    return q


__all__ = ["Engine", "SqlError", "quoted"]
