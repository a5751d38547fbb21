"""Native decoding of event words (F1 to F5): 32-bit limbs, since 256-bit integers fit
no Spark type. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _limb(data: Column, start: int, chars: int = 8) -> Column:
    """`chars` hex characters from 0-based `start` after the 0x, as a long."""
    return F.conv(F.substring(data, start + 3, chars), 16, 10).cast("long")


def _limbs(data: Column, start: int, chars: int) -> Column:
    """The limbs as an array: a fold over it keeps the generated code small."""
    places = F.array(*(F.lit(at + 3) for at in range(start, start + chars, 8)))
    return F.transform(places, lambda at: F.conv(F.substring(data, at, F.lit(8)), 16, 10).cast("double"))


def unsigned_word(data: Column, start: int, chars: int = 64) -> Column:
    """Hex characters start to start + chars as a double (chars divisible by 8)."""
    return F.aggregate(_limbs(data, start, chars), F.lit(0.0), lambda total, x: total * 4294967296.0 + x)


def signed_word(data: Column, start: int) -> Column:
    """a signed 256-bit word. Negative values are complemented limb by limb, so
    small ones stay exact."""
    flipped = F.aggregate(_limbs(data, start, 64), F.lit(0.0), lambda total, x: total * 4294967296.0 + (4294967295.0 - x))
    return F.when(_limb(data, start, 1) >= 8, -(flipped + 1.0)).otherwise(unsigned_word(data, start))


def amount0(data: Column) -> Column:
    return signed_word(data, 0)


def amount1(data: Column) -> Column:
    return signed_word(data, 64)


def sqrt_price(data: Column) -> Column:
    """the square root price, uint160."""
    return unsigned_word(data, 128)


def liquidity(data: Column) -> Column:
    """uint128 liquidity; models take log1p of it."""
    return unsigned_word(data, 224, 32)


def tick(data: Column) -> Column:
    """int24."""
    raw = _limb(data, 314, 6)
    return F.when(raw >= 8388608, raw - 16777216).otherwise(raw)


def sign_of(amount: Column) -> Column:
    """1 for positive amounts, else -1 (0 too)."""
    return F.when(amount > 0, 1).otherwise(-1)


def address_of_topic(topics: Column, i: int) -> Column:
    """The address in the low 20 bytes of a topic, lower case, without 0x."""
    return F.lower(F.substring(F.get(topics, F.lit(i)), 27, 40))


def is_hex(data: Column, least: int = 10) -> Column:
    """starts with 0x and has at least `least` characters."""
    return data.startswith("0x") & (F.length(data) >= least)


def decoded(df: DataFrame, data: str = "data") -> DataFrame:
    """df with amount0, amount1, sqrt_price, liquidity and tick instead of data and any
    columns of those names. The words are generated as one row, which the optimiser does
    not inline, so they are decoded once however often they are used."""
    d = F.col(data)
    names = ("amount0", "amount1", "sqrt_price", "liquidity", "tick")
    row = F.struct(*(f(d).alias(n) for n, f in zip(names, (amount0, amount1, sqrt_price, liquidity, tick))))
    return df.select(*(c for c in df.columns if c not in (*names, data)), F.inline(F.array(row)))
