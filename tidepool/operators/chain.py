"""From swaps to a labelled training table: the operators one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.bars import adaptive_thresholds, dollar_bars
from tidepool.operators.indirect import indirect_prices
from tidepool.operators.pricing import direct_prices
from tidepool.operators.series import concurrency_weights, frac_diff, standardised, stationary_series, token_series, triple_barrier, vertical_barrier
from tidepool.operators.tables import written


def priced_swaps(swaps: DataFrame, numeraire: str, ttl_s: float = 3600.0) -> DataFrame:
    """All price rows of decoded swaps (decode.decoded), as dollar_bars takes them: direct ones and
    those that are inferred, with the swap's pool, tick and liquidity and the sign of the
    token's amount."""
    columns = ("block_timestamp", "block_number", "event_id", "pool", "token0", "token1", "amount0", "amount1", "token0_decimals", "token1_decimals", "tick", "liquidity")
    swaps = written(swaps.select(*columns), "swaps")
    direct = direct_prices(swaps, numeraire).select("event_id", "token_address", "price_in_usdc", "usdc_volume")
    inferred = indirect_prices(swaps, numeraire, ttl_s).where("not direct").select(*direct.columns)
    prices = written(direct.unionByName(inferred), "prices")
    own = F.when(F.col("token_address") == F.col("token0"), F.col("amount0")).otherwise(F.col("amount1"))
    state = swaps.select("event_id", "block_timestamp", "pool", "token0", "token1", "amount0", "amount1", "tick", "liquidity")
    rows = prices.hint("merge").join(state.hint("merge"), "event_id").withColumn("flow_sign", F.signum(own).cast("int"))
    return rows.select("pool", "block_timestamp", "event_id", "token_address", "price_in_usdc", "usdc_volume", "flow_sign", "tick", "liquidity", "token0", "token1")


def labelled_bars(bars: DataFrame, d: float | None = None, horizon: int | None = None, up: float = 2.0, low: float = 2.0) -> DataFrame:
    """Bars with src_fracdiff, dest_fracdiff, rolling_volatility,
    label, sample_weight and barrier_touch_bars of the source, and dest_label,
    dest_sample_weight and dest_barrier_touch_bars. d and horizon: of all tokens; None: each
    token's least order, and half a day of its bars. Tokens that are not stationary have no
    difference, tokens with too few bars no label."""
    bars = written(bars, "bars")
    series = written(token_series(bars), "series")
    if d is None:
        moved = stationary_series(series).select("token", "ts", "fracdiff")
    else:
        logs = series.withColumn("x", F.log(F.greatest("price", F.lit(1e-18))))
        moved = standardised(frac_diff(logs, d), "frac", out="fracdiff", least=1e-8).select("token", "ts", "fracdiff")
    if horizon is None:
        spans = written(vertical_barrier(series).select("token", "horizon"), "horizons")
        barriers = triple_barrier(series.join(spans, "token"), "horizon", up, low).drop("horizon")
    else:
        barriers = triple_barrier(series, horizon, up, low)
    labels = concurrency_weights(written(barriers, "barriers"))
    known = labels.hint("merge").join(moved.hint("merge"), ["token", "ts"], "left").select("token", "ts", "fracdiff", "vol", "label", "weight", "touch")
    known = written(known, "known")
    out = bars
    for side, names in (("src", ("src_fracdiff", "rolling_volatility", "label", "sample_weight", "barrier_touch_bars")), ("dest", ("dest_fracdiff", None, "dest_label", "dest_sample_weight", "dest_barrier_touch_bars"))):
        own = known.select(F.col("token").alias(f"{side}_token_id"), F.col("ts").alias("bar_close_timestamp"), *(F.col(c).alias(n) for c, n in zip(("fracdiff", "vol", "label", "weight", "touch"), names) if n))
        out = out.hint("merge").join(own.hint("merge"), [f"{side}_token_id", "bar_close_timestamp"], "left")
    return out


def training_table(swaps: DataFrame, numeraire: str, ttl_s: float = 3600.0, low: float = 500.0, **barriers: float) -> DataFrame:
    """The whole chain on decoded swaps: prices, adaptive bars, labels."""
    prices = written(priced_swaps(swaps, numeraire, ttl_s), "priced")
    pools = prices.groupBy("pool").agg(F.first("token0").alias("token_a"), F.first("token1").alias("token_b"))
    limits = adaptive_thresholds(prices, pools, low=low)
    return labelled_bars(dollar_bars(prices.drop("token0", "token1"), limits, numeraire=numeraire), **barriers)
