"""Streams of ordered operators in full (E4, E5), with the results of the batch forms.

Rows of a key may come in any order within the lateness. They are held back until the
watermark has passed them and then worked through in order of time; a timer wakes a key whose
rows become due without new ones. Rows behind the watermark count nowhere. State is kept in
Spark's state store (RocksDB): what is held back, the recent prices of a component, the open
bar of a pool. Recent prices go by timers of event time once they are too old for any row that
may still come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidepool.operators.bars import MICRO, directed
from tidepool.operators.indirect import graph_rows, infer

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers and map state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InTimeOrder(StatefulProcessor):
    """schema: the held rows, whose first column is the time in microseconds and which are
    ordered by all columns up to `ranked`. Subclasses say what to do with rows that are due,
    and when to wake a key that holds none."""

    schema: str
    ranked: int
    out: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.schema.split(", ")]
        self.pending = handle.getListState("pending", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        new = [row for pdf in rows for row in zip(*(pdf[c].tolist() for c in self.names)) if row[0] > mark]
        yield from self._advance(key, mark, new)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, [])

    def _advance(self, key: tuple, mark: int, new: list[tuple]) -> Iterator[pd.DataFrame]:
        held = [*(self.pending.get() if self.pending.exists() else ()), *new]
        due = sorted((tuple(r) for r in held if r[0] <= mark), key=lambda r: r[: self.ranked])
        later = [tuple(r) for r in held if r[0] > mark]
        if later:
            self.pending.put(later)
        else:
            self.pending.clear()
        found = self.step(key, due, mark)
        idle = self.wake(mark)
        wake = [min(r[0] for r in later)] if later else [] if idle is None else [idle]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for at in wake:
            self.handle.registerTimer(max(at, mark) // 1000 + 1)
        if found:
            yield pd.DataFrame(found, columns=list(self.out))

    def step(self, key: tuple, due: list[tuple], mark: int) -> list[tuple]:
        raise NotImplementedError

    def wake(self, mark: int) -> int | None:
        """When to look at a key that holds no rows."""
        return None

    def close(self) -> None:
        pass


class IndirectPrices(InTimeOrder):
    """The cache of T1 by component: token to price and origin."""

    schema = "micros long, block_number long, event_id long, direct boolean, token0 string, token1 string, amount0 double, amount1 double, price double, volume double"
    ranked = 3
    out = ("component", "event_id", "micros", "token_address", "price_in_usdc", "usdc_volume", "direct")

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.cache = handle.getMapState("cache", "token string", "price double, origin long")

    def step(self, key: tuple, due: list[tuple], mark: int) -> list[tuple]:
        known = {k[0]: (v[0], v[1]) for k, v in self.cache.iterator()} if self.cache.exists() else {}
        cache, out = dict(known), []
        for at, _, event, direct, t0, t1, a0, a1, price, volume in due:
            if direct:
                cache[t0] = (price, at)
                found = [(t0, price, volume)]
            else:
                # both sides take the new prices, of the older origin
                found = infer(cache, at, t0, t1, a0, a1, self.ttl)
            out += [(key[0], event, at, t, p, v, bool(direct)) for t, p, v in found]
        # a row that is still to come is later than the watermark
        fresh = {t: e for t, e in cache.items() if mark - e[1] <= self.ttl}
        for token, entry in fresh.items():
            if known.get(token) != entry:
                self.cache.updateValue((token,), entry)
        for token in known.keys() - fresh.keys():
            self.cache.removeKey((token,))
        self.oldest = min((o for _, o in fresh.values()), default=None)
        return out

    def wake(self, mark: int) -> int | None:
        return None if self.oldest is None else self.oldest + self.ttl + 1000


def stream_indirect_prices(swaps: DataFrame, numeraire: str, labels: DataFrame, ttl_s: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """T1 on a stream of decoded swaps. labels: (token, component) from a batch
    (pricing.components over the pools), as which tokens can meet is not known from a stream.
    Rows as those of indirect_prices, when the watermark has passed them."""
    rows = graph_rows(swaps.withWatermark("block_timestamp", late), numeraire, labels, keep="block_timestamp")
    out = rows.groupBy("component").transformWithStateInPandas(
        IndirectPrices(int(ttl_s * 1e6)), "component string, event_id long, micros long, token_address string, price_in_usdc double, usdc_volume double, direct boolean", "Append", "EventTime"
    )
    return out.select("event_id", "token_address", "price_in_usdc", "usdc_volume", "direct", F.timestamp_micros("micros").alias("block_timestamp"))


class Bars(InTimeOrder):
    """The open bar of T2 by pool, and what goes on to the next: bar number, last close, and
    the liquidity last seen."""

    schema = "micros long, tie long, side string, micro long, limit long, price double, flow double, tick double, liquidity double"
    ranked = 3
    out = ("pool", "bar_no", "close", "tick_count", "volume_micro", "flow_a", "flow_b", "price_a", "price_b", "delta", "tick_delta", "liquidity")
    #: an open bar that nothing has been added to
    EMPTY = (0, 0, None, None, None, None, None, None, None, None)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "bar long, close long, liquidity double, volume long, ticks long, at long, tie long, flow_a double, flow_b double, price_a double, price_b double, tick_open double, tick_close double")

    def step(self, key: tuple, due: list[tuple], mark: int) -> list[tuple]:
        if not due:
            return []
        bar, close, liquidity, *own = self.open.get() if self.open.exists() else (0, None, None, *self.EMPTY)
        out = []
        for at, tie, side, micro, limit, price, flow, tick, liq in due:
            volume, ticks, last_at, last_tie, flow_a, flow_b, price_a, price_b, tick_open, tick_close = own
            volume += micro
            ticks += (at, tie) != (last_at, last_tie)
            if side == "a":
                flow_a, price_a = (flow_a or 0.0) + flow, price
            elif side == "b":
                flow_b, price_b = (flow_b or 0.0) + flow, price
            if tick is not None and tick == tick:
                tick_open, tick_close = tick if tick_open is None else tick_open, tick
            if liq is not None and liq == liq:
                liquidity = liq
            own = (volume, ticks, at, tie, flow_a, flow_b, price_a, price_b, tick_open, tick_close)
            if volume >= limit:
                if price_a is not None and price_b is not None:
                    delta = 0.0 if close is None else (at - close) / 1e6
                    moved = None if tick_open is None else tick_close - tick_open
                    out.append((key[0], bar, at, ticks, volume, flow_a, flow_b, price_a, price_b, delta, moved, liquidity))
                bar, close, own = bar + 1, at, self.EMPTY
        self.open.update((bar, close, liquidity, *own))
        return out


def stream_dollar_bars(prices: DataFrame, thresholds: DataFrame, late: str = "1 hour") -> DataFrame:
    """E5: T2 with T9, T11 and T12 on a stream of priced swaps (as of dollar_bars, with tick and
    liquidity): each bar when it is closed and the watermark has passed it. thresholds is a
    static table."""
    rows = prices.withWatermark("block_timestamp", late).join(thresholds, "pool").select(
        "pool", "block_timestamp", F.unix_micros("block_timestamp").alias("micros"), F.col("event_id").alias("tie"), F.round(F.col("usdc_volume") * MICRO).cast("long").alias("micro"),
        F.round(F.col("threshold") * MICRO).cast("long").alias("limit"), F.when(F.col("token_address") == F.col("token_a"), "a").when(F.col("token_address") == F.col("token_b"), "b").otherwise("c").alias("side"),
        F.col("price_in_usdc").alias("price"), (F.col("flow_sign") * F.col("usdc_volume")).alias("flow"), F.col("tick").cast("double").alias("tick"), F.col("liquidity").cast("double").alias("liquidity"),
    )
    found = rows.groupBy("pool").transformWithStateInPandas(
        Bars(), "pool string, bar_no long, close long, tick_count long, volume_micro long, flow_a double, flow_b double, price_a double, price_b double, delta double, tick_delta double, liquidity double", "Append", "EventTime"
    )
    named = found.join(thresholds.select("pool", "token_a", "token_b"), "pool").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("flow_a", "flow_b")})
    return directed(named.select("*", F.timestamp_micros("close").alias("bar_close_timestamp"), F.col("delta").alias("bar_time_delta_sec"), F.log1p("liquidity").alias("liquidity_close")))
