"""Prices: direct, outliers, references; components of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.functions.numbers import correlation, direct_price
from tidepool.operators.ranges import numbered_in_key
from tidepool.operators.scans import carried, latest
from tidepool.operators.tables import dropped, written

LEAST_PRICE, MOST_PRICE, MOST_VOLUME = 1e-9, 1e7, 1e9
ORDER = ("block_timestamp", "block_number", "event_id")


def direct_prices(swaps: DataFrame, numeraire: str) -> DataFrame:
    """One row for each swap with the numeraire, within the sanity bounds.
    swaps has amount0 and amount1 as doubles."""
    quote = direct_price(F.col("amount0"), F.col("amount1"), F.col("token0"), F.col("token1"), F.col("token0_decimals"), F.col("token1_decimals"), numeraire)
    # inline drops rows without a quote and keeps the quote from being worked out twice
    quotes = F.when(quote.isNull(), F.array().cast("array<struct<token:string,price:double,volume:double>>")).otherwise(F.array(quote))
    own = swaps.where((F.col("token0") == numeraire) | (F.col("token1") == numeraire))
    return sane(own.select(*ORDER, "pool", F.inline(quotes).alias("token_address", "price_in_usdc", "usdc_volume")))


def sane(prices: DataFrame) -> DataFrame:
    return prices.where(F.col("price_in_usdc").between(LEAST_PRICE, MOST_PRICE) & (F.col("usdc_volume") <= MOST_VOLUME))


def nearest_quantile(df: DataFrame, key: str, value: str, qs: dict[str, float]) -> DataFrame:
    """Quantiles by nearest rank, round(q * (n - 1)), for each key. Ranks come from
    ranges of (key, value), so a key of any size is dealt over tasks."""
    ranked = numbered_in_key(df.select(key, value), key, value)
    pick = {n: F.max(F.when(F.col("r") == F.round((F.col("n") - 1) * F.lit(q)).cast("long"), F.col(value))).alias(n) for n, q in qs.items()}
    return ranked.groupBy(key).agg(*pick.values())


def outlier_bounds(prices: DataFrame, k: float = 3.0) -> DataFrame:
    """A3: fences at k interquartile ranges, clamped to the sanity bounds, by token."""
    q = nearest_quantile(prices, "token_address", "price_in_usdc", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select("token_address", F.greatest(F.col("q1") - k * iqr, F.lit(LEAST_PRICE)).alias("low"), F.least(F.col("q3") + k * iqr, F.lit(MOST_PRICE)).alias("high"))


def filter_outliers(prices: DataFrame, k: float = 3.0) -> DataFrame:
    """Prices inside the fences of their token. The bounds are one row a token and
    written, so Spark broadcasts them by their true size while they are small."""
    return prices.join(written(outlier_bounds(prices, k), "fences"), "token_address").where(F.col("price_in_usdc").between(F.col("low"), F.col("high"))).drop("low", "high")


def last_known(events: DataFrame, lookups: DataFrame, key: str, ts: str, value: str, max_age_s: float) -> DataFrame:
    """For each lookup the last value of its key at or before its time, if not
    older than max_age_s: a union and a running last."""
    both = events.select(F.col(key), F.col(ts), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("lookup_id"), F.col(ts).alias("seen"), F.col(value).alias("v")).unionByName(
        lookups.select(F.col(key), F.col(ts), F.lit(1).alias("kind"), F.col("lookup_id").cast("long").alias("lookup_id"), F.lit(None).cast("timestamp").alias("seen"), F.lit(None).cast("double").alias("v"))
    )
    at = carried(both, [key], [ts, "kind"], at=latest(F.when(F.col("kind") == 0, F.struct("seen", "v"))))
    fresh = F.unix_micros(ts) - F.unix_micros("at.seen") <= F.lit(int(max_age_s * 1e6))
    return at.where("kind = 1").select("lookup_id", key, ts, F.when(fresh, F.col("at.v")).alias(value))


def components(edges: DataFrame) -> DataFrame:
    """(token, component) of the graph with edges (a, b); component is the least token
    reachable. A round takes the least label of the neighbours and then the label of that
    label, so a chain of n tokens takes about log n rounds; rounds go on until no label
    moves. Each one is written, so plans stay short."""
    ends = edges.select("a", "b").where("a <> b")
    both = written(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("token")).agg(F.min("b").alias("m")).select("token", F.least("token", "m").alias("component")), "labels")
    while True:
        near = both.join(label, F.col("b") == F.col("token")).groupBy(F.col("a").alias("token")).agg(F.min("component").alias("m"))
        near = written(label.join(near, "token").select("token", F.col("component").alias("old"), F.least("component", "m").alias("component")), "near")
        up = near.select(F.col("token").alias("component"), F.col("component").alias("top"))
        new = written(near.join(up, "component").select("token", "old", F.least("component", "top").alias("component")), "labels")
        moved = new.where("component <> old").limit(1).count()
        for old in (label, near):
            dropped(old)
        label = new
        if not moved:
            dropped(both)
            return label.select("token", "component")


def against_reference(prices: DataFrame, reference: DataFrame, unit: str, ts: str = "block_timestamp") -> DataFrame:
    """Correlation and MAPE of mean prices against reference prices, by
    token, on hours or days."""
    mine = prices.groupBy("token_address", F.date_trunc(unit, ts).alias("at")).agg(F.avg("price_in_usdc").alias("price"))
    theirs = reference.groupBy("token_address", F.date_trunc(unit, "timestamp").alias("at")).agg(F.avg("price_usd").alias("ref"))
    both = mine.join(theirs, ["token_address", "at"])
    return both.groupBy("token_address").agg(F.count("*").alias("n"), correlation(F.col("price"), F.col("ref")).alias("corr"), (F.avg(F.abs(F.col("price") - F.col("ref")) / (F.col("ref") + 1e-9)) * 100).alias("mape"))


def connected_to(swaps: DataFrame, numeraire: str) -> DataFrame:
    """Swaps with the numeraire on a side, or whose tokens both have a pool with it."""
    paired = swaps.where(F.col("token0") == numeraire).select(F.col("token1").alias("p")).union(swaps.where(F.col("token1") == numeraire).select("token0")).distinct()
    direct = (F.col("token0") == numeraire) | (F.col("token1") == numeraire)
    both = swaps.where(~direct).join(paired.withColumnRenamed("p", "token0"), "token0", "left_semi").join(paired.withColumnRenamed("p", "token1"), "token1", "left_semi")
    return swaps.where(direct).unionByName(both.select(*swaps.columns))


def keep_first(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
