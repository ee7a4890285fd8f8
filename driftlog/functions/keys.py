"""Keys in byte order: encoders, bounds of prefixes, limits of entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_KEY, MAX_VALUE = 64 * 1024, 1024 * 1024


def encode_long(col: Column) -> Column:
    """Eight bytes whose order is the signed order of the number."""
    return F.unhex(F.lpad(F.hex(col.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def successor(prefix):
    """The least key above every key with this prefix; None where there is none (empty, or all bytes 0xFF)."""
    if isinstance(prefix, str):
        for i in range(len(prefix) - 1, -1, -1):
            point = ord(prefix[i]) + 1
            if point <= 0x10FFFF:
                return prefix[:i] + chr(0xE000 if 0xD800 <= point < 0xE000 else point)
        return None
    for i in range(len(prefix) - 1, -1, -1):
        if prefix[i] != 0xFF:
            return prefix[:i] + bytes([prefix[i] + 1])
    return None


def in_range(key: Column, lower=None, upper=None) -> Column:
    """lower <= key < upper; None is unbounded. An empty upper key is a bound, and nothing is below it."""
    cond = F.lit(True)
    if lower is not None:
        cond = cond & (key >= F.lit(lower))
    if upper is not None:
        cond = cond & (key < F.lit(upper))
    return cond


def has_prefix(key: Column, prefix) -> Column:
    """A prefix as a range of keys, which a Parquet scan takes as bounds; startswith on binary keys would not be pushed down."""
    return in_range(key, prefix if len(prefix) else None, successor(prefix))


def within_limits(key: Column, value: Column) -> Column:
    return (F.octet_length(key) <= MAX_KEY) & (F.coalesce(F.octet_length(value), F.lit(0)) <= MAX_VALUE)
