"""INSERT, upsert, UPDATE, DELETE and MERGE by copy on write: a new DataFrame for the table, and one for the output."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans import nodes as N
from ..plans.emit import Emitter, quoted
from ..plans.lexer import SqlError
from ..sources.storage import stored

ROW, ORDINAL = "row__", "ordinal__"
DEFAULT = N.Col(("DEFAULT",))
#: Functions that give another value each time; rows that hold their values are written at once.
VOLATILE = {"NOW", "GETDATE", "CURDATE", "CURRENT_TIMESTAMP", "CURRENT_DATE", "RAND", "RANDOM", "RANDN", "UUID", "SHUFFLE"}


@dataclass
class Mutation:
    """table: the rows after the change; changes: op__, inserted and deleted, structs of the table's columns, one of them
    null where a row has no image before or after; output: what RETURNING or OUTPUT asks for, or None."""

    table: DataFrame
    changes: DataFrame
    output: DataFrame | None = None


def settled(rows: DataFrame, *parts) -> DataFrame:
    """rows, stored if a function in parts of the statement would give other values when they are read again."""
    return stored(rows) if any(isinstance(x, N.Call) and x.name in VOLATILE for x in N.walk(parts)) else rows


def target(s: N.Node) -> str:
    return ".".join(s.table.parts).lower()


def apply(engine, s: N.Node, dialect: str) -> Mutation:
    return {N.Insert: _insert, N.Update: _update, N.Delete: _delete, N.Merge: _merge}[type(s)](engine, s, dialect)


def _default(engine, s: N.Node, column: str) -> N.Node:
    """What DEFAULT stands for in a column of the statement's table."""
    from . import ddl

    default = engine.state.definitions.get(target(s), ddl.Definition()).default(column)
    return default if default is not None else N.Lit(None)


def _image(columns: list[str], prefix: str, name: str) -> Column:
    return F.struct(*(F.col(prefix + c).alias(c) for c in columns)).alias(name)


def _none(table: DataFrame, name: str) -> Column:
    """No image: all columns null in the types of table."""
    return F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema)).alias(name)


def _op(kind: str) -> Column:
    return F.lit(kind).alias("op__")


def _output(changes: DataFrame, items: tuple, default: str, dialect: str) -> DataFrame | None:
    """items over changes."""
    if not items:
        return None
    emit, columns = Emitter(dialect), changes.schema["inserted"].dataType.names
    out = []
    for i in items:
        if isinstance(i.expr, N.Star):
            image = i.expr.table[-1].lower() if i.expr.table and i.expr.table[-1].lower() in ("inserted", "deleted") else default
            out += [f"{image}.{quoted(c)} AS {quoted(c)}" for c in columns]
        else:
            def put(x: N.Node) -> N.Node:
                if isinstance(x, N.Col):
                    image = x.parts[-2].lower() if len(x.parts) > 1 and x.parts[-2].lower() in ("inserted", "deleted") else default
                    return N.Col((image, x.parts[-1]))
                return x

            name = i.alias or (i.expr.parts[-1] if isinstance(i.expr, N.Col) else None)
            out.append(emit.expr(N.transform(i.expr, put)) + (f" AS {quoted(name)}" if name else ""))
    return changes.selectExpr(*out)


def _numbered(engine, s: N.Node) -> DataFrame:
    """The target's rows with a number that stays as it is, for statements that join."""
    return stored(engine.table(target(s)).withColumn(ROW, F.monotonically_increasing_id()))


def _select(engine, s: N.Node, rows: DataFrame, items: list[str], dialect: str, tail: tuple) -> DataFrame:
    """items from rows, standing for the target under its label, beside the other tables of s."""
    emit = engine.emitter(tail, dialect)
    view = f"{engine.prefix}target"
    rows.createOrReplaceTempView(view)
    label = quoted(s.table.alias or s.table.parts[-1])
    source, joins = tail
    text = f"SELECT {', '.join(items)} FROM {quoted(view)} AS {label}"
    text += "".join(f", {emit.table(t)}" for t in source) + emit.joins(joins)
    where = getattr(s, "where", None)
    if where is not None and tail != ((), ()):
        text += f" WHERE {engine.emitter(where, dialect).expr(where)}"
    return engine.spark_sql(text)


def _cast(df: DataFrame, column: str, as_: DataFrame) -> Column:
    return F.col(column).cast(as_.schema[column].dataType)


def in_order(rows: DataFrame, name: str) -> DataFrame:
    """rows, stored, with a column that numbers them from 0 in the order of their partitions; no row passes through one task."""
    marked = stored(rows.withColumn("p__", F.spark_partition_id()).withColumn("m__", F.monotonically_increasing_id()))
    before = F.coalesce(F.sum("n__").over(W.orderBy("p__").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = marked.groupBy("p__").agg(F.count("*").alias("n__")).select("p__", before.alias("b__"))
    return marked.join(F.broadcast(starts), "p__").withColumn(name, F.col("b__") + F.col("m__").bitwiseAND(F.lit((1 << 33) - 1))).drop("p__", "m__", "b__")


def _new_rows(engine, s: N.Insert, table: DataFrame, dialect: str) -> DataFrame:
    """The rows to insert, stored, with all columns of the table in its types and ORDINAL; defaults and generated keys filled in."""
    from . import ddl

    definition = engine.state.definitions.get(target(s), ddl.Definition())
    by_name = {c.lower(): c for c in table.columns}
    try:
        given = [by_name[c.lower()] for c in s.columns] or [c for c in table.columns if not definition.identity(c) or s.query is None and s.rows and len(s.rows[0]) == len(table.columns)]
    except KeyError as e:
        raise SqlError(f"no column {e.args[0]} in {target(s)}") from None
    if s.query is not None:
        rows = engine.query(s.query, dialect)
        if len(rows.columns) != len(given):
            raise SqlError(f"{len(given)} columns are filled and {len(rows.columns)} given")
        rows = in_order(rows.toDF(*given), ORDINAL)
    else:
        if any(len(r) != len(given) for r in s.rows):
            raise SqlError(f"each row of VALUES needs {len(given)} values")
        emit = engine.emitter(s.rows, dialect)

        def value(x: N.Node, column: str) -> str:
            if x == DEFAULT:
                default = definition.default(column)
                return f"CAST({emit.expr(default) if default is not None else 'NULL'} AS {table.schema[column].dataType.simpleString()})"
            return f"CAST({emit.expr(x)} AS {table.schema[column].dataType.simpleString()})"

        selects = (f"SELECT {', '.join(f'{value(v, c)} AS {quoted(c)}' for v, c in zip(r, given, strict=True))}, CAST({i} AS bigint) AS {ORDINAL}" for i, r in enumerate(s.rows))
        rows = engine.spark_sql(" UNION ALL ".join(selects)).coalesce(1)
    emit = Emitter(dialect)
    for c in table.columns:
        if c not in given:
            if step := definition.identity(c):
                top = table.agg(F.max(c)).first()[0]
                first = step[0] if top is None else top + step[1]
                engine.last_insert_id = first
                rows = rows.withColumn(c, F.lit(first) + F.col(ORDINAL) * step[1])
            else:
                default = definition.default(c)
                rows = rows.withColumn(c, F.expr(emit.expr(default)) if default is not None else F.lit(None))
    return stored(rows.select(*(_cast(rows, c, table).alias(c) for c in table.columns), ORDINAL))


def _insert(engine, s: N.Insert, dialect: str) -> Mutation:
    table = engine.table(target(s))
    columns = table.columns
    rows = _new_rows(engine, s, table, dialect)
    if s.conflict is not None:
        return _upsert(engine, s, table, rows, dialect)
    changes = rows.select(_op("INSERT"), F.struct(*columns).alias("inserted"), _none(table, "deleted"))
    return Mutation(table.unionByName(rows.drop(ORDINAL)), changes, _output(changes, s.returning, "inserted", dialect))


def _upsert(engine, s: N.Insert, table: DataFrame, rows: DataFrame, dialect: str) -> Mutation:
    """New rows in their order, by rounds: a round takes the rows that no earlier one left shares a key with.

    Rows without a value in a key conflict with none by it. MySQL applies rows of one key one after the other; PostgreSQL
    refuses to update a row twice, and DO NOTHING leaves out all but the first. Each key is one equality join.
    """
    from . import ddl

    columns, c = table.columns, s.conflict
    definition = engine.state.definitions.get(target(s), ddl.Definition())
    keys = [c.columns] if c.columns else [definition.named_key(c.constraint)] if c.constraint else definition.keys()
    if not keys:
        raise SqlError(f"{target(s)} has no key on which rows could conflict")
    keys = [[x for x in columns if x.lower() in {k.lower() for k in key}] for key in keys]
    emit = Emitter(dialect)
    partial = emit.expr(N.transform(c.where, lambda x: N.Col((x.parts[-1],)) if isinstance(x, N.Col) else x)) if c.where is not None else "true"

    def put(x: N.Node) -> N.Node:
        if isinstance(x, N.Call) and x.name == "VALUES" and len(x.args) == 1:
            return N.Col((f"new__{x.args[0].parts[-1].removeprefix('old__')}",))
        if isinstance(x, N.Col) and x.parts[0][:5] != "new__":
            return N.Col((("new__" if len(x.parts) > 1 and x.parts[-2].lower() == "excluded" else "old__") + x.parts[-1].lower(),))
        return x

    sets = {k.lower(): emit.expr(N.transform(v, put)) for k, v in c.sets}
    allowed = F.coalesce(F.expr(emit.expr(N.transform(c.update_where, put))), F.lit(False)) if c.update_where is not None else F.lit(True)
    numbered, changes = in_order(table, ROW), None
    touched = numbered.select(ROW).limit(0)
    while not rows.isEmpty():
        ready = F.lit(True)
        for key in keys:
            held = F.expr(partial) & ~reduce(Column.__or__, (F.col(k).isNull() for k in key))
            place = F.row_number().over(W.partitionBy(*key, F.when(held, F.lit(-1)).otherwise(F.col(ORDINAL))).orderBy(ORDINAL))
            ready = ready & (place == 1)
        marked = stored(rows.withColumn("ready__", ready))
        turn, rows = marked.where("ready__").drop("ready__"), marked.where("not ready__").drop("ready__")
        met = None
        for i, key in enumerate(keys):
            one = turn.where(F.expr(partial)).select(ORDINAL, *key).join(numbered.where(F.expr(partial)).select(ROW, *key), key).select(ORDINAL, ROW, F.lit(i).alias("k__"))
            met = one if met is None else met.unionAll(one)
        met = met.groupBy(ORDINAL).agg(F.min(F.struct("k__", ROW))[ROW].alias(ROW))
        first = stored(met.groupBy(ROW).agg(F.min(ORDINAL).alias("f__")).join(met, ROW))
        # rows that meet one row of the table under different keys take turns too
        rows = rows.unionByName(turn.join(first.where(F.col("f__") < F.col(ORDINAL)).select(ORDINAL), ORDINAL, "left_semi"))
        turn = turn.join(first.where(F.col("f__") < F.col(ORDINAL)).select(ORDINAL), ORDINAL, "left_anti")
        met = first.where(F.col("f__") == F.col(ORDINAL)).select(ORDINAL, ROW)
        if c.sets and not c.mysql and not met.join(touched, ROW, "left_semi").isEmpty():
            raise SqlError("ON CONFLICT DO UPDATE cannot change a row a second time")
        fresh = turn.join(met, ORDINAL, "left_anti").withColumn(ROW, -1 - F.col(ORDINAL))
        added = fresh.select(_op("INSERT"), F.struct(*columns).alias("inserted"), _none(table, "deleted"))
        kept = numbered
        if c.sets:
            pairs = turn.join(met, ORDINAL).select(ROW, *(F.col(x).alias(f"new__{x.lower()}") for x in columns), F.lit(True).alias("hit__"))
            wide = numbered.select(ROW, *(F.col(x).alias(f"old__{x.lower()}") for x in columns)).join(pairs, ROW, "left")
            hit = F.coalesce(F.col("hit__"), F.lit(False)) & allowed
            after = {x: F.expr(sets[x.lower()]).cast(table.schema[x].dataType) if x.lower() in sets else F.col(f"old__{x.lower()}") for x in columns}
            images = stored(wide.select(ROW, hit.alias("hit__"), *(F.col(f"old__{x.lower()}").alias(f"o_{x}") for x in columns), *(F.when(hit, v).otherwise(F.col(f"old__{x.lower()}")).alias(f"n_{x}") for x, v in after.items())))
            kept = images.select(*(F.col(f"n_{x}").alias(x) for x in columns), ROW)
            added = added.unionByName(images.where("hit__").select(_op("UPDATE"), _image(columns, "n_", "inserted"), _image(columns, "o_", "deleted")))
            touched = touched.unionAll(images.where("hit__").select(ROW)).unionAll(fresh.select(ROW))
        numbered = stored(kept.select(*columns, ROW).unionByName(fresh.select(*columns, ROW)))
        changes = added if changes is None else changes.unionByName(added)
    if changes is None:
        changes = table.limit(0).select(_op("INSERT"), F.struct(*columns).alias("inserted"), _none(table, "deleted"))
    return Mutation(numbered.select(*columns), changes, _output(changes, s.returning, "inserted", dialect))


def _update(engine, s: N.Update, dialect: str) -> Mutation:
    table = engine.table(target(s))
    columns = table.columns
    emit = engine.emitter((s.sets, s.where), dialect)
    by_name = {c.lower(): c for c in columns}
    s = replace(s, sets=tuple((c, _default(engine, s, c) if v == DEFAULT else v) for c, v in s.sets))
    if unknown := [c for c, _ in s.sets if c.lower() not in by_name]:
        raise SqlError(f"no column {unknown[0]} in {target(s)}")
    label = quoted(s.table.alias or s.table.parts[-1])
    new = {c.lower(): f"CAST({emit.expr(v)} AS {table.schema[by_name[c.lower()]].dataType.simpleString()}) AS {quoted('n_' + by_name[c.lower()])}" for c, v in s.sets}
    old = [f"{label}.{quoted(c)} AS {quoted('o_' + c)}" for c in columns]
    if s.source or s.joins:
        rows = _numbered(engine, s)
        found = _select(engine, s, rows, [f"{label}.{ROW}", *new.values()], dialect, (s.source, s.joins)).dropDuplicates([ROW]).withColumn("hit__", F.lit(True))
        images = rows.select(ROW, *(F.col(c).alias(f"o_{c}") for c in columns)).join(found, ROW, "left").withColumn("hit__", F.coalesce("hit__", F.lit(False)))
    else:
        hit = f"coalesce({emit.expr(s.where)}, false)" if s.where is not None else "true"
        images = _select(engine, s, table, [*old, *new.values(), f"{hit} AS hit__"], dialect, ((), ()))
    after = [F.when(F.col("hit__"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) if c.lower() in new else F.col(f"o_{c}") for c in columns]
    images = settled(images.select("hit__", *(F.col(f"o_{c}") for c in columns), *(a.alias(f"a_{c}") for a, c in zip(after, columns, strict=True))), s)
    changes = images.where("hit__").select(_op("UPDATE"), _image(columns, "a_", "inserted"), _image(columns, "o_", "deleted"))
    return Mutation(images.select(*(F.col(f"a_{c}").alias(c) for c in columns)), changes, _output(changes, s.returning, "inserted", dialect))


def _delete(engine, s: N.Delete, dialect: str) -> Mutation:
    table = engine.table(target(s))
    columns = table.columns
    if s.source or s.joins:
        rows = _numbered(engine, s)
        label = quoted(s.table.alias or s.table.parts[-1])
        found = _select(engine, s, rows, [f"{label}.{ROW}"], dialect, (s.source, s.joins)).distinct()
        kept, gone = rows.join(found, ROW, "left_anti").select(*columns), rows.join(found, ROW, "left_semi").select(*columns)
    else:
        hit = f"coalesce({engine.emitter(s.where, dialect).expr(s.where)}, false)" if s.where is not None else "true"
        images = settled(_select(engine, s, table, ["*", f"{hit} AS hit__"], dialect, ((), ())), s)
        kept, gone = images.where("not hit__").select(*columns), images.where("hit__").select(*columns)
    changes = gone.select(_op("DELETE"), F.struct(*columns).alias("deleted"), _none(table, "inserted"))
    return Mutation(kept, changes, _output(changes, s.returning, "deleted", dialect))


def _with_identity(engine, s: N.Merge, images: DataFrame, table: DataFrame) -> DataFrame:
    """images with generated numbers in the rows that are inserted, where no value is given."""
    from . import ddl

    definition = engine.state.definitions.get(target(s), ddl.Definition())
    for c in table.columns:
        if step := definition.identity(c):
            new = (F.col("act__") == "INSERT") & F.col(f"n_{c}").isNull()
            top = table.agg(F.max(c)).first()[0]
            engine.last_insert_id = first = step[0] if top is None else top + step[1]
            made = in_order(images.where(new), ORDINAL).withColumn(f"n_{c}", (F.lit(first) + F.col(ORDINAL) * step[1]).cast(table.schema[c].dataType)).drop(ORDINAL)
            images = stored(images.where(~new).unionByName(made))
    return images


def _merge(engine, s: N.Merge, dialect: str) -> Mutation:
    """A full join; of each joined row the first WHEN whose kind and condition hold decides."""
    table = engine.table(target(s))
    columns = table.columns
    rows = _numbered(engine, s)
    emit = engine.emitter((s.source, s.on, s.whens), dialect)
    view, label = f"{engine.prefix}target", quoted(s.table.alias or s.table.parts[-1])
    rows.createOrReplaceTempView(view)
    source_label = quoted(s.source.alias or s.source.parts[-1])
    kinds = {"MATCHED": f"{label}.{ROW} IS NOT NULL AND {source_label}.s__", "SOURCE": f"{label}.{ROW} IS NULL", "TARGET": f"{source_label}.s__ IS NULL"}
    whens = "".join(f" WHEN {kinds[w.kind]}{f' AND ({emit.expr(w.condition)})' if w.condition is not None else ''} THEN {i}" for i, w in enumerate(s.whens))
    choice = f"CASE{whens} END" if whens else "CAST(NULL AS int)"
    items = [f"{label}.{ROW} AS {ROW}", f"{choice} AS when__", *(f"{label}.{quoted(c)} AS {quoted('o_' + c)}" for c in columns)]
    for c in columns:
        cases = ""
        for i, w in enumerate(s.whens):
            values = dict(zip((x.lower() for x in (w.columns or (columns if w.action == "INSERT" else ()))), w.values, strict=True))
            if c.lower() in values:
                v = values[c.lower()]
                cases += f" WHEN {i} THEN {emit.expr(_default(engine, s, c) if v == DEFAULT else v)}"
            elif w.action == "INSERT":
                cases += f" WHEN {i} THEN {emit.expr(_default(engine, s, c))}"
        cases = f"CASE {choice}{cases} ELSE {label}.{quoted(c)} END" if cases else f"{label}.{quoted(c)}"
        items.append(f"CAST({cases} AS {table.schema[c].dataType.simpleString()}) AS {quoted('n_' + c)}")
    source = emit.table(replace(s.source, alias="src__"))
    text = f"SELECT {', '.join(items)} FROM {quoted(view)} AS {label} FULL JOIN (SELECT *, true AS s__ FROM {source}) AS {source_label} ON {emit.expr(s.on)}"
    images = stored(engine.spark_sql(text))
    acts = {i: w.action for i, w in enumerate(s.whens)}
    changing = images.where(F.col(ROW).isNotNull() & F.col("when__").isNotNull())
    if not changing.groupBy(ROW).count().where("count > 1").isEmpty():
        raise SqlError("a row of the target is matched by several rows of the source")
    action = F.coalesce(*(F.when(F.col("when__") == i, a) for i, a in acts.items()), F.lit("KEEP")) if acts else F.lit("KEEP")
    images = _with_identity(engine, s, images.withColumn("act__", action), table)
    # rows of the source that no WHEN takes vanish; a target row met by several rows, none taken, stays once
    idle = images.where(f"act__ = 'KEEP' and {ROW} is not null").dropDuplicates([ROW]).join(changing.select(ROW).distinct(), ROW, "left_anti")
    after = images.where("act__ in ('UPDATE', 'INSERT')").select(*(F.col(f"n_{c}").alias(c) for c in columns)).unionByName(idle.select(*(F.col(f"o_{c}").alias(c) for c in columns)))
    none = [F.when(F.col("act__") != "DELETE", F.col(f"n_{c}")).alias(c) for c in columns]
    changes = images.where("act__ <> 'KEEP'").select(F.col("act__").alias("op__"), F.struct(*none).alias("inserted"), _image(columns, "o_", "deleted"))
    return Mutation(after, changes, _output(changes, s.returning, "inserted", dialect))
