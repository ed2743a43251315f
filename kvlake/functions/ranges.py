"""Key ranges: bounds, prefixes, and the predicates that reach the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyRange:
    """A range of keys; a bound of None is open. Ends are excluded unless said otherwise, starts included."""

    start: Any = None
    end: Any = None
    start_included: bool = True
    end_included: bool = False

    def predicate(self, key: Column) -> Column:
        """Comparisons of the bare column with literals, which Parquet's statistics can answer."""
        found = F.lit(True)
        if self.start is not None:
            found = found & ((key >= self.start) if self.start_included else (key > self.start))
        if self.end is not None:
            found = found & ((key <= self.end) if self.end_included else (key < self.end))
        return found

    def meets(self, least: Any, most: Any) -> bool:
        """Whether keys from least to most can lie in the range."""
        if self.start is not None and (most < self.start or most == self.start and not self.start_included):
            return False
        return not (self.end is not None and (least > self.end or least == self.end and not self.end_included))


def prefix_range(prefix: bytes) -> KeyRange:
    """All keys that begin with prefix: the end is the prefix with its last byte below ff raised by one and the rest cut
    off; without such a byte it is open. BINARY's startswith isn't pushed to the scan, comparisons are."""
    kept = prefix.rstrip(b"\xff")
    return KeyRange(prefix, kept[:-1] + bytes([kept[-1] + 1]) if kept else None)


def text_prefix_range(prefix: str) -> KeyRange:
    """As prefix_range, for STRING keys, which Spark orders by their UTF-8 bytes: the end is the prefix with its last
    character raised."""
    for i in range(len(prefix) - 1, -1, -1):
        if (code := ord(prefix[i])) < 0x10FFFF:
            return KeyRange(prefix, prefix[:i] + chr(0xE000 if code == 0xD7FF else code + 1))
    return KeyRange(prefix)
