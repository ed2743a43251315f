"""Keys and values as readable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw_bytes(b: Column) -> Column:
    """Bytes between quotes: printable ASCII as it is, quotes and backslashes behind a backslash, tab, CR and LF by their
    letters, any other byte as a backslash, x and two digits."""
    pairs = F.filter(F.split(F.regexp_replace(F.hex(b), "(..)", "$1 "), " "), lambda p: p != "")

    def shown(p: Column) -> Column:
        code = F.conv(p, 16, 10).cast("int")
        named = F.when(code == 9, "\\t").when(code == 10, "\\n").when(code == 13, "\\r").when(code == 34, '\\"').when(code == 39, "\\'").when(code == 92, "\\\\")
        return named.when(code.between(32, 126), F.char(code.cast("bigint"))).otherwise(F.concat(F.lit("\\x"), F.lower(p)))

    return F.concat(F.lit('"'), F.array_join(F.transform(pairs, shown), ""), F.lit('"'))


def key_value(key: Column, value: Column) -> Column:
    """"key" → "value", or None for a value that doesn't exist."""
    return F.concat(raw_bytes(key), F.lit(" → "), F.coalesce(raw_bytes(value), F.lit("None")))
