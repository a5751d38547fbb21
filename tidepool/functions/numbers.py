"""Scalar expressions of the market operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_USDC = 0.01


def direct_price(amount0: Column, amount1: Column, token0: Column, token1: Column, dec0: Column, dec1: Column, numeraire: str) -> Column:
    """struct(token, price, volume) of a swap with the numeraire on one side; null if
    it is on neither, the token amount is 0, or fewer than LEAST_USDC move."""
    ten = F.lit(10.0)
    out = lambda token, amount, dec, usdc: F.when(
        (F.abs(amount) > 0) & (F.abs(usdc) / F.pow(ten, F.lit(6)) >= LEAST_USDC),
        F.struct(token.alias("token"), (F.abs(usdc) * F.pow(ten, dec) / (F.abs(amount) * F.pow(ten, F.lit(6)))).alias("price"), (F.abs(usdc) / F.pow(ten, F.lit(6))).alias("volume")),
    )
    return F.when(token0 == numeraire, out(token1, amount1, dec1, amount0)).when(token1 == numeraire, out(token0, amount0, dec0, amount1))


def bar_threshold(volume_a: Column, volume_b: Column, fraction: float = 0.001, low: float = 1e4, high: float = 1e6, default: float = 1e5) -> Column:
    """F8: a fraction of the larger daily volume, clamped; the default without volume."""
    most = F.greatest(F.coalesce(volume_a, F.lit(0.0)), F.coalesce(volume_b, F.lit(0.0)))
    return F.when(most == 0, F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), most * fraction)))


def buying_pressure(src: Column, dest: Column) -> Column:
    """the share of the source flow; 0.5 where a flow is null."""
    return F.coalesce(F.abs(src) / (F.abs(src) + F.abs(dest) + 1e-8), F.lit(0.5))


def clip(c: Column, low: float, high: float) -> Column:
    """F11, P13."""
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def nan_to_null(c: Column) -> Column:
    """P14."""
    return F.when(~F.isnan(c), c)


def finite(*columns: str) -> Column:
    """All columns are neither null, NaN nor infinite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def seconds(ts: Column) -> Column:
    """a timestamp as fractional seconds."""
    return F.unix_micros(ts) / 1e6


def kelly(p_up: Column, p_down: Column, least: float = 0.1, most: float = 0.5) -> Column:
    """half the edge, null under the least edge, capped."""
    edge = p_up - p_down
    return F.when(edge >= least, F.least(edge / 2, F.lit(most)))


def dot(a: Column, b: Column) -> Column:
    """F18."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles by IEEE 754: an infinity, or NaN for 0 / 0, where b is 0, for which Spark
    raises an error."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows that have both; null where one does not vary, which
    the built-in aggregate takes for an error."""
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
