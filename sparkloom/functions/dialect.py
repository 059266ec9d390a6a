"""Function names, types and date patterns of the dialects, in terms of Spark's."""

from __future__ import annotations

from ..plans.lexer import SqlError

# Names of the dialects and Spark's.
RENAMED = {
    "LEN": "length", "STDEV": "stddev_samp", "STDEVP": "stddev_pop", "VAR": "var_samp", "VARP": "var_pop", "IFNULL": "ifnull",
    "ISNULL": "ifnull", "GETDATE": "now",
}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "STDEV", "STDEVP", "VAR", "VARP", "STDDEV_SAMP", "STDDEV_POP", "VAR_SAMP", "VAR_POP"}
TYPES = {
    "BOOL": "boolean", "BOOLEAN": "boolean", "BIT": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "DATETIME": "timestamp_ntz",
    "REAL": "float", "FLOAT": "double", "DOUBLE": "double", "SMALLINT": "smallint", "INT": "int", "INTEGER": "int", "BIGINT": "bigint",
    "TINYINT": "tinyint", "SERIAL": "int", "BIGSERIAL": "bigint", "SMALLSERIAL": "smallint", "CHAR": "string", "CHARACTER": "string",
    "VARCHAR": "string", "NCHAR": "string", "NVARCHAR": "string", "TEXT": "string", "NTEXT": "string", "STRING": "string", "JSON": "string",
    "JSONB": "string", "UUID": "string", "INET": "string", "CIDR": "string", "MACADDR": "string", "BYTEA": "binary", "IMAGE": "binary",
    "BINARY": "binary", "MONEY": "decimal(19,2)", "TIME": "time(6)", "INTERVAL": "string",
}
PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm",
    "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "M": "MMMM", "a": "EEE", "W": "EEEE", "j": "DDD", "T": "HH:mm:ss",
    "r": "hh:mm:ss a", "%": "%",
}
PARTS = {"MICROSECOND": 1, "SECOND": 2, "MINUTE": 3, "HOUR": 4, "DAY": 5, "MONTH": 6, "YEAR": 7}
# end of fixed values


def spark_type(name: str, args: tuple, dims: int) -> str:
    """The Spark type of a dialect's type."""
    if name in ("DECIMAL", "NUMERIC"):
        out = f"decimal({','.join(map(str, args or (10, 0)))})"
    elif name in TYPES:
        out = TYPES[name]
    else:
        raise SqlError(f"unknown type {name}")
    for _ in range(dims):
        out = f"array<{out}>"
    return out


def date_pattern(text: str) -> str:
    """A MySQL %-pattern as a Spark pattern; letters that stand for themselves are quoted."""
    out, at, quoted_run = "", 0, False
    while at < len(text):
        c = text[at]
        if c == "%" and at + 1 < len(text):
            if text[at + 1] not in PATTERNS:
                raise SqlError(f"pattern %{text[at + 1]} has no counterpart")
            out, at = out + PATTERNS[text[at + 1]], at + 2
        else:
            # letters that follow one another share their quotes
            out, at = out[:-1] + c + "'" if c.isalpha() and quoted_run else out + (f"'{c}'" if c.isalpha() else "''" if c == "'" else c), at + 1
            quoted_run = c.isalpha()
            continue
        quoted_run = False
    return out


def interval_parts(unit: str) -> list[str]:
    """The simple units of a unit, largest first: DAY_MINUTE gives DAY, HOUR, MINUTE."""
    if "_" not in unit:
        return [unit]
    first, last = unit.split("_")
    order = ["YEAR", "MONTH"] if first == "YEAR" else ["DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"]
    return order[order.index(first) : order.index(last) + 1]
