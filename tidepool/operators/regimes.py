"""Planned extras (Z1 to Z7): gas price, slippage, regimes, trailing stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.operators.ranges import numbered
from tidepool.operators.scans import carried, first, latest, most
from tidepool.operators.tables import written


def as_of(rows: DataFrame, other: DataFrame, ts: str, value: str, default: float) -> DataFrame:
    """The last `value` of other (ts, value) at or before each row's time."""
    mark = lambda df, kind, v: df.withColumn("_k", F.lit(kind)).withColumn(value, v)
    both = mark(rows, 1, F.lit(None).cast("double")).unionByName(mark(other.select(ts, value), 0, F.col(value)), allowMissingColumns=True)
    return carried(both, [], [ts, "_k"], **{value: latest(value)}).where("_k = 1").withColumn(value, F.coalesce(value, F.lit(default))).drop("_k")


def slippage(size: Column, tvl: Column, default: float = 0.1) -> Column:
    """min(sqrt(size / tvl), 1); 1 without value locked, the default if unknown."""
    return F.when(tvl.isNull(), F.lit(default)).when(tvl <= 0, F.lit(1.0)).otherwise(F.least(F.sqrt(size / F.greatest(tvl, F.lit(1e-12))), F.lit(1.0)))


def daily_volatility(prices: DataFrame, key: str, ts: str, price: str, days: int = 30) -> DataFrame:
    """By key and day the mean price, the deviation of the last `days` daily
    returns and its percentile rank among the key's days."""
    day = prices.groupBy(key, F.to_date(ts).alias("day")).agg(F.avg(price).alias("price"))
    w = Window.partitionBy(key).orderBy("day")
    ret = day.withColumn("ret", F.col("price") / F.lag("price").over(w) - 1)
    vol = ret.withColumn("vol", F.stddev_samp("ret").over(w.rowsBetween(-(days - 1), 0)))
    return vol.withColumn("rank", F.when(F.col("vol").isNotNull(), F.percent_rank().over(Window.partitionBy(key, F.col("vol").isNull()).orderBy("vol"))))


def regime(vol_rank: Column, slope: Column, high: float = 0.75, flat: float = 0.0) -> Column:
    """Z3: a label from volatility percentile and trend."""
    return F.when(vol_rank >= high, "volatile").when(slope > flat, "up").when(slope < -flat, "down").otherwise("flat")


def hourly(days: DataFrame, day: str) -> DataFrame:
    """Each day as 24 rows."""
    return days.withColumn("hour_at", F.explode(F.sequence(F.col(day).cast("timestamp"), F.col(day).cast("timestamp") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))))


def trailing_stop(prices: DataFrame, keys: list[str], *order: str, arm: float = 0.2, drop: float = 0.3) -> DataFrame:
    """The exit price of each key: the first price `drop` below the running peak once
    the peak is `arm` above entry; else the last."""
    run = carried(prices, keys, list(order), _e=first("price"), _p=most("price"))
    hit = (F.col("_p") >= (1 + arm) * F.col("_e")) & (F.col("price") <= (1 - drop) * F.col("_p"))
    at = F.struct(*order)
    return run.groupBy(*keys).agg(F.coalesce(F.min_by("price", F.when(hit, at)), F.max_by("price", at)).alias("exit_price"))


def barrier_multiple(df: DataFrame, vol: str, *tie: str) -> DataFrame:
    """1 + a quarter for each volatility quintile. Quintiles come from row numbers by ranges:
    the first ones have a row more where the rows don't divide by 5."""
    rows = written(df, "quintiles")
    size, more = divmod(rows.count(), 5)
    at = F.col("_row")
    quintile = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / max(size, 1))) + 1
    return numbered(rows, vol, *tie, out="_row").withColumn("multiple", 1 + quintile * 0.25).drop("_row")
