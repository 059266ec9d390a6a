"""Syntax tree: immutable nodes, with a walk and a transformation over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any


class Node:
    """Base of all nodes."""


def walk(x: Any) -> Iterator[Node]:
    """Every node at or below x, parents first."""
    if isinstance(x, (tuple, list)):
        for y in x:
            yield from walk(y)
    elif isinstance(x, Node):
        yield x
        for f in fields(x):
            yield from walk(getattr(x, f.name))


def transform(x: Any, change: Callable[[Node], Node]) -> Any:
    """x with change applied to every node, children first."""
    if isinstance(x, tuple):
        return tuple(transform(y, change) for y in x)
    if isinstance(x, Node) and is_dataclass(x):
        new = {f.name: transform(getattr(x, f.name), change) for f in fields(x)}
        return change(replace(x, **new))
    return x


def children(x: Node, change: Callable[[Any], Any]) -> Node:
    """x with change applied to what its fields hold, and no deeper."""
    return replace(x, **{f.name: change(getattr(x, f.name)) for f in fields(x)})


def _node(cls):
    return dataclass(frozen=True)(cls)


@_node
class Lit(Node):
    value: Any


@_node
class Param(Node):
    name: str  # of a positional one: ? and its number from 0


@_node
class Col(Node):
    parts: tuple[str, ...]


@_node
class Star(Node):
    table: tuple[str, ...] = ()
    but: tuple[str, ...] = ()  # columns left out


@_node
class Frame(Node):
    mode: str
    start: tuple  # (Node or None for unbounded, "PRECEDING" / "FOLLOWING" / "CURRENT ROW")
    end: tuple


@_node
class Window(Node):
    partition: tuple = ()
    order: tuple = ()
    frame: Frame | None = None


@_node
class Call(Node):
    name: str
    args: tuple = ()
    distinct: bool = False
    over: Window | None = None


@_node
class Bin(Node):
    op: str
    left: Node
    right: Node


@_node
class Un(Node):
    op: str
    arg: Node


@_node
class Like(Node):
    arg: Node
    pattern: Node
    escape: Node | None = None


@_node
class In(Node):
    arg: Node
    items: Any  # tuple of nodes or a Query
    negated: bool = False


@_node
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool = False


@_node
class IsNull(Node):
    arg: Node
    negated: bool = False


@_node
class Case(Node):
    base: Node | None
    whens: tuple
    default: Node | None


@_node
class Type(Node):
    name: str
    args: tuple = ()
    dims: int = 0


@_node
class Cast(Node):
    arg: Node
    type: Type


@_node
class Exists(Node):
    query: Node


@_node
class Sub(Node):
    query: Node


@_node
class Array(Node):
    items: tuple


@_node
class Index(Node):
    arg: Node
    low: Node | None
    high: Node | None = None
    slice: bool = False


@_node
class Json(Node):
    op: str
    left: Node
    right: Node


@_node
class Interval(Node):
    value: Node
    unit: str


@_node
class Item(Node):
    expr: Node
    alias: str | None = None


@_node
class Order(Node):
    expr: Node
    desc: bool = False
    nulls: str | None = None


@_node
class Table(Node):
    parts: tuple[str, ...]
    alias: str | None = None
    hints: tuple = ()


@_node
class Derived(Node):
    query: Node
    alias: str | None = None
    columns: tuple = ()


@_node
class Join(Node):
    kind: str
    right: Node
    on: Node | None = None
    using: tuple = ()


@_node
class Top(Node):
    count: Node
    percent: bool = False
    ties: bool = False


@_node
class Grouping(Node):
    kind: str  # "ROLLUP", "CUBE" or "GROUPING SETS"
    sets: tuple


@_node
class Select(Node):
    items: tuple
    distinct: bool = False
    top: Top | None = None
    into: str | None = None
    source: tuple = ()  # comma-separated tables
    joins: tuple = ()
    where: Node | None = None
    group: tuple = ()
    having: Node | None = None
    hints: tuple = ()


@_node
class Cte(Node):
    name: str
    columns: tuple
    query: Node


@_node
class Query(Node):
    first: Node  # Select or Query
    rest: tuple = ()  # (operation, Select or Query), applied left to right
    ctes: tuple = ()
    recursive: bool = False
    order: tuple = ()
    limit: Node | None = None
    offset: Node | None = None


@_node
class Conflict(Node):
    columns: tuple
    where: Node | None
    constraint: str | None
    sets: tuple  # empty: do nothing
    update_where: Node | None
    mysql: bool = False


@_node
class Insert(Node):
    table: Table
    columns: tuple
    rows: tuple
    query: Node | None
    conflict: Conflict | None = None
    returning: tuple = ()
    output_into: str | None = None


@_node
class Update(Node):
    table: Table
    sets: tuple
    source: tuple = ()
    joins: tuple = ()
    where: Node | None = None
    returning: tuple = ()
    output_into: str | None = None


@_node
class Delete(Node):
    table: Table
    source: tuple = ()
    joins: tuple = ()
    where: Node | None = None
    returning: tuple = ()
    output_into: str | None = None


@_node
class When(Node):
    kind: str  # "MATCHED", "SOURCE" (not matched by target) or "TARGET" (not matched by source)
    condition: Node | None
    action: str
    columns: tuple = ()
    values: tuple = ()


@_node
class Merge(Node):
    table: Table
    source: Node
    on: Node
    whens: tuple
    returning: tuple = ()
    output_into: str | None = None


@_node
class ColumnDef(Node):
    name: str
    type: Type
    nullable: bool = True
    unique: bool = False
    primary: bool = False
    default: Node | None = None
    identity: tuple | None = None
    check: Node | None = None
    references: tuple | None = None  # table, columns, and pairs of event and action


@_node
class Constraint(Node):
    kind: str  # "PRIMARY KEY", "UNIQUE", "FOREIGN KEY" or "CHECK"
    name: str | None
    columns: tuple = ()
    check: Node | None = None
    table: tuple = ()
    target: tuple = ()
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@_node
class CreateTable(Node):
    name: tuple
    columns: tuple
    constraints: tuple
    if_missing: bool = False
    query: Node | None = None


@_node
class Alter(Node):
    name: tuple
    actions: tuple  # (action, arguments...)


@_node
class Drop(Node):
    kind: str  # "TABLE", "VIEW" or "INDEX"
    names: tuple
    if_exists: bool = False


@_node
class Rename(Node):
    pairs: tuple


@_node
class CreateView(Node):
    name: tuple
    columns: tuple
    query: Node
    replace: bool = False
    alter: bool = False


@_node
class CreateIndex(Node):
    name: str
    table: tuple
    columns: tuple
    unique: bool
    where: Node | None = None


@_node
class Transaction(Node):
    action: str  # BEGIN, COMMIT, ROLLBACK, SAVEPOINT, ROLLBACK TO, RELEASE
    name: str | None = None
    isolation: str | None = None
