"""Definitions of tables: columns, keys, defaults and checks that Parquet does not hold."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.dialect import spark_type
from ..plans import nodes as N
from ..plans.emit import Emitter
from ..plans.lexer import SqlError
from ..sources.storage import stored
from .dml import in_order, settled


class ConstraintError(SqlError):
    """Rows that a constraint forbids."""


@dataclass
class Definition:
    columns: tuple = ()
    constraints: tuple = ()
    indexes: tuple = ()

    def column(self, name: str) -> N.ColumnDef | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    def identity(self, name: str) -> tuple | None:
        c = self.column(name)
        return c.identity if c else None

    def default(self, name: str) -> N.Node | None:
        c = self.column(name)
        return c.default if c else None

    def keys(self) -> list[tuple]:
        """Columns of primary and unique keys."""
        out = [(c.name,) for c in self.columns if c.primary or c.unique]
        out += [c.columns for c in self.constraints if c.kind in ("PRIMARY KEY", "UNIQUE")]
        return out + [tuple(o.expr.parts[-1] for o in i.columns) for i in self.indexes if i.unique and i.where is None]

    def named_key(self, name: str) -> tuple:
        for c in self.constraints:
            if c.name and c.name.lower() == name.lower() and c.columns:
                return c.columns
        raise SqlError(f"no key named {name}")


def _type(t: N.Type) -> str:
    return spark_type(t.name, t.args, t.dims)


def _plain(x: N.Node) -> N.Node:
    """An expression over one table, its columns without the table's name."""
    return N.transform(x, lambda c: N.Col((c.parts[-1],)) if isinstance(c, N.Col) else c)


def foreign_keys(d: Definition) -> list[N.Constraint]:
    """A table's foreign keys, those that stand at a column too."""
    out = [c for c in d.constraints if c.kind == "FOREIGN KEY"]
    for c in d.columns:
        if c.references:
            table, target, rules = c.references
            out.append(N.Constraint("FOREIGN KEY", None, (c.name,), None, table, target or (c.name,), **dict(rules)))
    return out


def violations(engine, name: str, rows: DataFrame) -> list[tuple[str, DataFrame]]:
    """For each constraint of a table its name and the rows or keys that break it."""
    d = engine.state.definitions.get(name.lower())
    if d is None:
        return []
    emit, out = Emitter(), []
    primary = {k.lower() for c in d.constraints if c.kind == "PRIMARY KEY" for k in c.columns}
    for c in d.columns:
        if not c.nullable or c.name.lower() in primary:
            out.append((f"NOT NULL {c.name}", rows.where(F.col(c.name).isNull())))
    checks = [(f"CHECK {c.name}", c.check) for c in d.columns if c.check is not None] + [(f"CHECK {c.name or ''}", c.check) for c in d.constraints if c.kind == "CHECK"]
    out += [(label, rows.where(F.expr(f"not ({emit.expr(_plain(x))})"))) for label, x in checks]
    unique = [(key, rows) for key in d.keys()]
    unique += [(tuple(o.expr.parts[-1] for o in i.columns), rows.where(F.expr(emit.expr(_plain(i.where))))) for i in d.indexes if i.unique and i.where is not None]
    for key, among in unique:
        out.append((f"UNIQUE {', '.join(key)}", among.dropna(subset=list(key)).groupBy(*key).count().where("count > 1")))
    for c in foreign_keys(d):
        parent = ".".join(c.table).lower()
        parents = rows if parent == name.lower() else engine.table(parent)
        parents = parents.select(*(F.col(t).alias(f"p__{i}") for i, t in enumerate(c.target)))
        test = [F.col(x) == F.col(f"p__{i}") for i, x in enumerate(c.columns)]
        out.append((f"FOREIGN KEY {', '.join(c.columns)}", rows.dropna(subset=list(c.columns)).join(parents, test, "left_anti")))
    return out


def check(engine, name: str, rows: DataFrame) -> None:
    for label, bad in violations(engine, name, rows):
        if not bad.isEmpty():
            raise ConstraintError(f"{name}: {label} is violated")


def follow(engine, parent: str, changes: DataFrame) -> None:
    """What foreign keys do to the children of a table whose rows have changed (see dml.Mutation), and to theirs in turn.

    Keys that an UPDATE changed follow ON UPDATE, keys that went follow ON DELETE, unless another row has them now.
    """
    for child, d in list(engine.state.definitions.items()):
        for c in foreign_keys(d):
            if ".".join(c.table).lower() != parent.lower():
                continue
            n = len(c.target)
            key = [f"k__{i}" for i in range(n)]
            before = [F.col("deleted")[t].alias(k) for t, k in zip(c.target, key, strict=True)]
            after = [F.col("inserted")[t].alias(f"a{k}") for t, k in zip(c.target, key, strict=True)]
            now = engine.table(parent).select(*(F.col(t).alias(k) for t, k in zip(c.target, key, strict=True)))
            gone = changes.where("op__ <> 'INSERT'").select("op__", *before, *after).dropna(subset=key)
            moved = ~reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"a{k}")) for k in key))
            gone = stored(gone.where((F.col("op__") == "DELETE") | moved).dropDuplicates(key).join(now, key, "left_anti"))
            if gone.isEmpty():
                continue
            rows = engine.table(child)
            met = stored(rows.join(gone, [F.col(x) == F.col(k) for x, k in zip(c.columns, key, strict=True)], "left"))
            hit = met.where("op__ is not null")
            if hit.isEmpty():
                continue
            rules = {"DELETE": c.on_delete, "UPDATE": c.on_update}
            refused = [op for op, rule in rules.items() if rule in ("RESTRICT", "NO ACTION")]
            if refused and not hit.where(F.col("op__").isin(refused)).isEmpty():
                raise ConstraintError(f"{child} still refers to rows taken from {parent}")
            drops = (F.col("op__") == "DELETE") & F.lit(rules["DELETE"] == "CASCADE")
            new, emit = {}, Emitter()
            for x, k in zip(c.columns, key, strict=True):
                default = d.default(x)
                default = F.expr(emit.expr(default)) if default is not None else F.lit(None)
                value = {"CASCADE": F.col(f"a{k}"), "SET NULL": F.lit(None), "SET DEFAULT": default}
                value = F.when(F.col("op__") == "UPDATE", value.get(rules["UPDATE"])).otherwise(value.get(rules["DELETE"], F.lit(None)))
                new[x.lower()] = F.when(F.col("op__").isNull(), F.col(x)).otherwise(value).cast(rows.schema[x].dataType)
            images = stored(met.select("op__", drops.alias("drops__"), F.struct(*rows.columns).alias("deleted"), F.struct(*(new.get(x.lower(), F.col(x)).alias(x) for x in rows.columns)).alias("inserted")))
            done = images.where("op__ is not null").select(F.when(F.col("drops__"), "DELETE").otherwise("UPDATE").alias("op__"), "inserted", "deleted")
            engine.register(child, images.where("not coalesce(drops__, false)").select("inserted.*"))
            check(engine, child, engine.table(child))
            follow(engine, child, done)


def apply(engine, s: N.Node) -> None:
    state = engine.state
    if isinstance(s, N.CreateTable):
        name = ".".join(s.name).lower()
        if name in state.tables:
            if s.if_missing:
                return
            raise SqlError(f"{name} exists")
        if s.query is not None:
            engine.register(name, settled(engine.query(s.query), s.query))
            return
        ddl = ", ".join(f"`{c.name}` {_type(c.type)}" for c in s.columns)
        engine.register(name, engine.spark.createDataFrame([], StructType.fromDDL(ddl)))
        state.definitions[name] = Definition(s.columns, s.constraints)
    elif isinstance(s, N.CreateView):
        name = ".".join(s.name).lower()
        if name in state.views and not s.replace or s.alter and name not in state.views:
            raise SqlError(f"view {name} {'does not exist' if s.alter else 'exists'}")
        state.views[name] = s
    elif isinstance(s, N.CreateIndex):
        name = ".".join(s.table).lower()
        d = state.definitions.setdefault(name, Definition())
        changed = replace(d, indexes=(*d.indexes, s))
        state.definitions[name] = changed
        check(engine, name, engine.table(name))
    elif isinstance(s, N.Drop):
        for parts in s.names:
            name = ".".join(parts).lower()
            if s.kind == "INDEX":
                for d in state.definitions.values():
                    d.indexes = tuple(i for i in d.indexes if i.name.lower() != name)
                continue
            if s.kind == "TABLE":
                gone = {".".join(p).lower() for p in s.names}
                for child, d in state.definitions.items():
                    if child not in gone and any(".".join(c.table).lower() == name for c in foreign_keys(d)):
                        raise ConstraintError(f"{child} refers to {name}")
            found = (state.tables if s.kind == "TABLE" else state.views).pop(name, None)
            state.definitions.pop(name, None) if s.kind == "TABLE" else None
            if found is None and not s.if_exists:
                raise SqlError(f"no {s.kind.lower()} {name}")
    elif isinstance(s, N.Rename):
        for old, new in s.pairs:
            _rename(engine, ".".join(old).lower(), ".".join(new).lower())
    elif isinstance(s, N.Alter):
        _alter(engine, ".".join(s.name).lower(), s.actions)
    else:
        raise SqlError(f"{type(s).__name__} cannot be run")


def _rename(engine, old: str, new: str) -> None:
    state = engine.state
    state.tables[new] = engine.table(old)
    state.tables.pop(old)
    if old in state.definitions:
        state.definitions[new] = state.definitions.pop(old)
    parts = tuple(new.split("."))
    points = lambda table: ".".join(table).lower() == old
    for child, d in state.definitions.items():  # foreign keys follow
        columns = tuple(replace(c, references=(parts, *c.references[1:])) if c.references and points(c.references[0]) else c for c in d.columns)
        state.definitions[child] = replace(d, columns=columns, constraints=tuple(replace(c, table=parts) if points(c.table) else c for c in d.constraints))


def _free(engine, name: str, column: str) -> None:
    """Raise if a foreign key of any table refers to the column."""
    for child, d in engine.state.definitions.items():
        for c in foreign_keys(d):
            if ".".join(c.table).lower() == name and column.lower() in {x.lower() for x in c.target}:
                raise ConstraintError(f"{child} refers to {column} of {name}")


def _renamed(engine, name: str, d: Definition, old: str, new: str) -> Definition:
    """d with a column under a new name in its checks, keys and indexes; foreign keys that refer to it follow."""
    put = lambda x: N.Col((*x.parts[:-1], new)) if isinstance(x, N.Col) and x.parts[-1].lower() == old.lower() else x
    names = lambda xs: tuple(new if x.lower() == old.lower() else x for x in xs)
    for child, other in engine.state.definitions.items():
        mine = child == name
        points = lambda table: ".".join(table).lower() == name
        columns = tuple(
            replace(c, references=(c.references[0], names(c.references[1] or (c.name,)), c.references[2])) if c.references and points(c.references[0]) else c
            for c in (d if mine else other).columns
        )
        constraints = tuple(replace(c, target=names(c.target)) if points(c.table) else c for c in (d if mine else other).constraints)
        if mine:
            d = replace(d, columns=columns, constraints=constraints)
        else:
            engine.state.definitions[child] = replace(other, columns=columns, constraints=constraints)
    return replace(
        d,
        columns=tuple(replace(c, name=new if c.name.lower() == old.lower() else c.name, check=N.transform(c.check, put)) for c in d.columns),
        constraints=tuple(replace(c, columns=names(c.columns), check=N.transform(c.check, put)) for c in d.constraints),
        indexes=tuple(replace(i, columns=N.transform(i.columns, put), where=N.transform(i.where, put)) for i in d.indexes),
    )


def _alter(engine, name: str, actions: tuple) -> None:
    emit = Emitter()
    for action, *args in actions:
        rows, d = engine.table(name), engine.state.definitions.setdefault(name, Definition())
        if action == "ADD":
            c = args[0]
            value = F.expr(emit.expr(c.default)) if c.default is not None else F.lit(None)
            if c.identity:
                rows = in_order(rows, "n__")
                value = F.lit(c.identity[0]) + F.col("n__") * c.identity[1]
            rows = stored(rows.withColumn(c.name, value.cast(_type(c.type))).drop("n__"))
            d = replace(d, columns=(*d.columns, c))
        elif action == "DROP":
            _free(engine, name, args[0])
            rows = rows.drop(args[0])
            used = lambda x: any(isinstance(c, N.Col) and c.parts[-1].lower() == args[0].lower() for c in N.walk(x))
            d = replace(
                d,
                columns=tuple(c for c in d.columns if c.name.lower() != args[0].lower() and not used(c.check)),
                constraints=tuple(c for c in d.constraints if args[0].lower() not in {x.lower() for x in c.columns} and not used(c.check)),
                indexes=tuple(i for i in d.indexes if not used((i.columns, i.where))),
            )
        elif action == "RENAME":
            rows = rows.withColumnRenamed(*args)
            d = _renamed(engine, name, d, *args)
        elif action == "RENAME TO":
            _rename(engine, name, ".".join(args[0]).lower())
            return
        elif action == "CHANGE":
            old, c = args
            d = _renamed(engine, name, d, old, c.name)
            rows = rows.withColumnRenamed(old, c.name).withColumn(c.name, F.col(c.name).cast(_type(c.type)))
            d = replace(d, columns=(*(x for x in d.columns if x.name.lower() != c.name.lower()), c))
        elif action == "TYPE":
            rows = rows.withColumn(args[0], F.col(args[0]).cast(_type(args[1])))
        elif action in ("SET DEFAULT", "NULLABLE"):
            c = d.column(args[0]) or N.ColumnDef(args[0], N.Type("STRING"))
            c = replace(c, default=args[1]) if action == "SET DEFAULT" else replace(c, nullable=args[1])
            d = replace(d, columns=(*(x for x in d.columns if x.name.lower() != args[0].lower()), c))
        elif action == "ADD CONSTRAINT":
            d = replace(d, constraints=(*d.constraints, args[0]))
        else:
            d = replace(d, constraints=tuple(c for c in d.constraints if (c.name or "").lower() != args[0].lower()))
        engine.state.definitions[name] = d
        check(engine, name, rows)
        engine.register(name, rows)
