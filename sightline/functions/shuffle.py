"""Seeded shuffle key: a 32-bit mix of id and seed in 64-bit arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
# Fixed values of the mix (results must agree with stored orders).
_GOLDEN, _FIRST, _SECOND = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35


def _low(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_MASK))


def _times(value: Column, factor: int) -> Column:
    """Product modulo 2^32 from 16-bit halves, so nothing overflows 64 bits."""
    low = value.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)
    high = (F.shiftright(value, 16) * F.lit(factor)).bitwiseAND(F.lit(0xFFFF))
    return _low(low + F.shiftleft(high, 16))


def seeded_key(identifier: Column | str, seed: int | None) -> Column:
    """Signed 32-bit sort key of an id for a seed (none counts as 0)."""
    column = F.col(identifier) if isinstance(identifier, str) else identifier
    value = _low(column.cast("bigint"))
    start = F.lit((int(seed or 0) & _MASK) + _GOLDEN)
    value = value.bitwiseXOR(_low(start + F.shiftleft(value, 6) + F.shiftright(value, 2)))
    value = _times(value, _FIRST)
    value = value.bitwiseXOR(F.shiftright(value, 13))
    value = _times(value, _SECOND)
    value = value.bitwiseXOR(F.shiftright(value, 16))
    return F.when(value >= F.lit(1 << 31), value - F.lit(1 << 32)).otherwise(value)
