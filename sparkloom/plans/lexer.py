"""One tokenizer for all dialects; what differs is a table of quotes and operators."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SqlError(ValueError):
    """Text that cannot be read, or a reference that cannot be resolved; the message says why."""


@dataclass(frozen=True)
class Dialect:
    name: str
    identifier: str  # opening quotes of identifiers
    string: str  # quotes of strings
    json: bool = False
    escapes: bool = False  # a backslash escapes in patterns of LIKE
    whole_division: bool = False  # / of whole numbers is whole
    plus_joins: bool = False  # + of texts joins them


DIALECTS = {
    d.name: d
    for d in (
        Dialect("ansi", '"[', "'"),
        Dialect("mysql", "`[", "'\"", escapes=True),
        Dialect("postgresql", '"', "'", json=True, escapes=True, whole_division=True),
        Dialect("sqlserver", '"[', "'", whole_division=True, plus_joins=True),
    )
}


@dataclass(frozen=True)
class Token:
    kind: str  # id, quoted, string, number, param, op, end
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "id" else ""


_CLOSE = {'"': '"', "[": "]", "`": "`", "'": "'"}
_SPACE = re.compile(r"(\s+|--[^\n]*|/\*.*?\*/)+", re.S)
_WORD = re.compile(r"[^\W\d][\w$#]*")
_NUMBER = re.compile(r"(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")
_PARAM = re.compile(r"@[^\W\d]\w*")
_OPS = ["<=", ">=", "<>", "!=", "!<", "!>", "||"]
_JSON_OPS = ["#>>", "->>", "::", "->", "#>", "@>", "<@", "?|", "?&"]


def tokens(text: str, dialect: Dialect) -> list[Token]:
    """The tokens of text, with one of kind end at the end."""
    ops = (_JSON_OPS if dialect.json else ["::"]) + _OPS
    out, at = [], 0
    while at < len(text):
        if m := _SPACE.match(text, at):
            at = m.end()
            continue
        c = text[at]
        quotes = dialect.identifier + dialect.string
        # a bracket opens an identifier only where one can stand: after an operand it would be a subscript
        if c in quotes:
            close, end, value = _CLOSE[c], at + 1, ""
            while True:
                stop = text.find(close, end)
                if stop < 0:
                    raise SqlError(f"quote at {at} is not closed")
                value += text[end:stop]
                if text[stop : stop + 2] == close * 2:
                    value, end = value + close, stop + 2
                    continue
                break
            out.append(Token("string" if c in dialect.string else "quoted", value, at))
            at = stop + 1
        elif m := _WORD.match(text, at):
            out.append(Token("id", m[0], at))
            at = m.end()
        elif m := _NUMBER.match(text, at):
            out.append(Token("number", m[0], at))
            at = m.end()
        elif (m := _PARAM.match(text, at)) and not text.startswith("@>", at):
            out.append(Token("param", m[0][1:], at))
            at = m.end()
        elif op := next((o for o in ops if text.startswith(o, at)), None) or (c if c in "()[],.;=<>+-*/%&|^~?:" else None):
            out.append(Token("op", op, at))
            at += len(op)
        else:
            raise SqlError(f"unexpected {c!r} at {at}")
    return [*out, Token("end", "", len(text))]
