"""Cyclic redundancy checks that Spark lacks: CRC-32C (Castagnoli) and CRC-64 (ECMA-182, reflected), as Arrow functions.

All values of a batch go a byte at a time together, the longest first, so that the work is that of their bytes. A checksum
goes on where another one ended: crc64(b, crc64(a)) is that of a and b one after the other.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from kvlake.session import find_package

#: The polynomials with their bits reversed, by width.
POLYNOMIALS = {32: 0x82F63B78, 64: 0xC96C5795D7870F42}


@functools.cache
def _table(bits: int) -> np.ndarray:
    """What each byte does to a register that is shifted right."""
    made = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        made = np.where(made & np.uint64(1), (made >> np.uint64(1)) ^ np.uint64(POLYNOMIALS[bits]), made >> np.uint64(1))
    return made


def checksums(values: pa.Array, before: np.ndarray, bits: int) -> np.ndarray:
    """The checksum of each value (nulls count as empty) that goes on from one before (0 at the beginning)."""
    values = values.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    order = np.argsort(offsets[:-1] - offsets[1:], kind="stable")
    start, length = offsets[:-1][order], np.diff(offsets)[order]
    ones, table = np.uint64(2**bits - 1), _table(bits)
    state = before.astype(np.uint64)[order] ^ ones
    active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0))  # values longer than each place
    for j, n in enumerate(active.tolist()):
        state[:n] = table[(state[:n] & np.uint64(255)) ^ raw[start[:n] + j]] ^ (state[:n] >> np.uint64(8))
    found = np.empty(len(order), np.uint64)
    found[order] = state ^ ones
    return found


def _function(bits: int):
    find_package()

    @F.arrow_udf("bigint")
    def check(values: pa.Array, before: pa.Array) -> pa.Array:
        found = checksums(values, np.asarray(before.fill_null(0), np.int64).view(np.uint64), bits)
        return pc.if_else(values.is_valid(), pa.array(found.view(np.int64)), None)

    return check


def crc32c(value: Column, before: Column | None = None) -> Column:
    """CRC-32C of a BINARY or STRING column, as a number; null of null."""
    return _function(32)(value.cast("binary"), F.lit(0).cast("bigint") if before is None else before)


def crc64(value: Column, before: Column | None = None) -> Column:
    """CRC-64 of a BINARY or STRING column, as a number whose 64 bits are the checksum; null of null."""
    return _function(64)(value.cast("binary"), F.lit(0).cast("bigint") if before is None else before)
