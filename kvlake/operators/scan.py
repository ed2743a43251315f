"""Point, range and prefix reads of a mutation log."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.functions.ranges import KeyRange, prefix_range
from kvlake.operators.lww import live


def get(log: DataFrame, key: Any, *, key_col: str = "key", values: list[str] | None = None) -> DataFrame:
    """The row of key, or none. Equality is pushed to the scan."""
    return live(log.where(F.col(key_col) == F.lit(key)), [key_col], values)


def get_many(log: DataFrame, keys: DataFrame, *, key_col: str = "key", values: list[str] | None = None) -> DataFrame:
    """The rows of the keys in a table."""
    return live(log.join(keys.select(key_col).distinct(), key_col, "left_semi"), [key_col], values)


def scan(log: DataFrame, within: KeyRange | None = None, *, key_col: str = "key", values: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """Live rows with keys in the range, in the order of keys unless that isn't needed."""
    within = within or KeyRange()
    found = live(log.where(within.predicate(F.col(key_col))), [key_col], values)
    return found.orderBy(key_col) if ordered else found


def scan_prefix(log: DataFrame, prefix: bytes, *, key_col: str = "key", values: list[str] | None = None, ordered: bool = True) -> DataFrame:
    return scan(log, prefix_range(prefix), key_col=key_col, values=values, ordered=ordered)
