"""Stateful stream forms of the ordered operators (E4, E5). State is small and bounded: a
few numbers for each pool, or the entries of a component that are not older than the time
to live. Rows are sorted inside a micro-batch. Spark hands rows behind the watermark to
stateful functions, so they are dropped here; a cache that sees nothing more expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICRO = 1_000_000


def _watermark(state: GroupState, zone: str) -> pd.Timestamp:
    """The watermark as rows show times: in the session's zone."""
    return pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms", tz="UTC").tz_convert(zone).tz_localize(None)


def _in_time(frames: Iterator[pd.DataFrame], mark: pd.Timestamp) -> pd.DataFrame:
    rows = pd.concat(list(frames))
    return rows[rows["ts"] >= mark].sort_values(["ts", "tie"])


def _bars(zone: str):  # noqa: ANN202
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _numbered(key, _in_time(frames, _watermark(state, zone)), state)

    return step


def _numbered(key: tuple, rows: pd.DataFrame, state: GroupState) -> Iterator[pd.DataFrame]:
    open_, bar = state.get if state.exists else (0, 0)
    out = []
    for ts, tie, micro, limit in zip(rows["ts"], rows["tie"], rows["micro"], rows["limit"]):
        open_ += int(micro)
        closes = open_ >= limit
        out.append((key[0], ts, int(tie), bar, closes))
        if closes:
            open_, bar = 0, bar + 1
    state.update((open_, bar))
    yield pd.DataFrame(out, columns=["pool", "ts", "tie", "bar_no", "closes"])


def stream_bars(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """E5: bar numbers on a stream of rows (pool, ts, tie, micro, limit)."""
    return rows.withWatermark("ts", late).groupBy("pool").applyInPandasWithState(
        _bars(rows.sparkSession.conf.get("spark.sql.session.timeZone")), "pool string, ts timestamp, tie long, bar_no long, closes boolean", "open long, bar long", "append", GroupStateTimeout.NoTimeout
    )


def _cache(ttl_s: float, zone: str):  # noqa: ANN202
    ttl = pd.Timedelta(seconds=ttl_s)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark = _watermark(state, zone)
        tokens, prices, seen = state.get if state.exists else ([], [], [])
        cache = {t: (p, pd.Timestamp(s)) for t, p, s in zip(tokens, prices, seen)}
        out = []
        rows = _in_time(frames, mark)
        for ts, tie, token, price, lookup in zip(rows["ts"], rows["tie"], rows["token"], rows["price"], rows["is_lookup"]):
            if lookup:
                known = cache.get(token)
                # time to live is of event time: equal age is fresh
                out.append((key[0], ts, int(tie), token, known[0] if known and ts - known[1] <= ttl else None))
            else:
                cache[token] = (float(price), ts)
        # what no row in time can use any more goes
        cache = {t: (p, s) for t, (p, s) in cache.items() if mark - s <= ttl}
        state.update(([*cache], [p for p, _ in cache.values()], [str(s) for _, s in cache.values()]))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + int(ttl_s * 1000) + 1)
        yield pd.DataFrame(out, columns=["component", "ts", "tie", "token", "price"])

    return step


def stream_last_known(rows: DataFrame, ttl_s: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """Rows (component, ts, tie, token, price, is_lookup): each lookup gets the last
    price of its token not older than ttl_s, by event time."""
    return rows.withWatermark("ts", late).groupBy("component").applyInPandasWithState(
        _cache(ttl_s, rows.sparkSession.conf.get("spark.sql.session.timeZone")), "component string, ts timestamp, tie long, token string, price double", "tokens array<string>, prices array<double>, seen array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )
