"""Tumbling windows that run the same on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_mean(prices: DataFrame, late: str = "2 hours") -> DataFrame:
    """Mean price of each token and hour. On a stream, rows later than `late` behind
    the newest are dropped and hours are emitted when they can't change."""
    src = prices.withWatermark("block_timestamp", late) if prices.isStreaming else prices
    per = src.groupBy("token_address", F.window("block_timestamp", "1 hour").alias("w")).agg(F.avg("price_in_usdc").alias("price"))
    return per.select("token_address", F.col("w.start").alias("hour_at"), "price")
