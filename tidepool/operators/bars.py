"""Dollar bars and what belongs to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.numbers import bar_threshold
from tidepool.operators.scans import carried, latest
from tidepool.operators.tables import written

MICRO = 1_000_000


def _order(rows: DataFrame) -> list[str]:
    """Rows of one swap come in the order of `sub` where there is one."""
    return ["ts", "tie", *(["sub"] if "sub" in rows.columns else [])]


def daily_volume(prices: DataFrame) -> DataFrame:
    """A2: mean volume of the days a token is active."""
    days = prices.groupBy("token_address", F.to_date("block_timestamp").alias("day")).agg(F.sum("usdc_volume").alias("v"))
    return days.groupBy("token_address").agg(F.avg("v").alias("daily_volume"))


def adaptive_thresholds(prices: DataFrame, pools: DataFrame, **bounds: float) -> DataFrame:
    """F8: a threshold for each pool (pool, token_a, token_b)."""
    v = daily_volume(prices)
    a = v.select(F.col("token_address").alias("token_a"), F.col("daily_volume").alias("va"))
    b = v.select(F.col("token_address").alias("token_b"), F.col("daily_volume").alias("vb"))
    return pools.join(a, "token_a", "left").join(b, "token_b", "left").select("pool", "token_a", "token_b", bar_threshold(F.col("va"), F.col("vb"), **bounds).alias("threshold"))


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pool and time: the bar number of each and whether it closes it.
    Between closes, a binary search in the running volume finds the next close. State
    from batch to batch is the pool, its bar number and its open volume."""
    pool, bar, open_ = None, 0, 0
    for batch in batches:
        pools = np.array(batch.column("pool").to_pylist(), dtype=object)
        volume, limit = batch.column("micro").to_numpy(), batch.column("limit").to_numpy()
        numbers, closed = np.zeros(len(pools), np.int64), np.zeros(len(pools), bool)
        cuts = np.flatnonzero(pools[1:] != pools[:-1]) + 1 if len(pools) else np.empty(0, int)
        for begin, end in zip(np.append(0, cuts), np.append(cuts, len(pools))):
            if begin == end:
                continue
            if pools[begin] != pool:
                pool, bar, open_ = pools[begin], 0, 0
            run = np.cumsum(volume[begin:end])
            at, gone, want = 0, 0, int(limit[begin])
            while True:
                # a zero limit is reached by any row, so search from `at` on
                hit = at + int(np.searchsorted(run[at:], gone + want - open_, "left"))
                if hit >= len(run):
                    numbers[begin + at : end] = bar
                    open_ += int(run[-1]) - gone if at < len(run) else 0
                    break
                numbers[begin + at : begin + hit + 1] = bar
                closed[begin + hit] = True
                bar, gone, open_, at = bar + 1, int(run[hit]), 0, hit + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers), pa.array(closed)], [*batch.schema.names, "bar_no", "closes"])


def assign_bars(rows: DataFrame) -> DataFrame:
    """T2, first step, serial form: rows (pool, ts, tie, micro, limit, ...) get bar_no and
    closes. A pool is a chain of constant state; its rows come sorted by Spark, so no pool
    is held in memory. Volumes are whole micro-dollars, so sums do not depend on order."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", bar_no long, closes boolean"
    return rows.repartition("pool").sortWithinPartitions("pool", *_order(rows)).mapInArrow(_assign, schema)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pool, chunk, time): what a chunk does to the open volume it gets. A
    row of the first bar of a chunk that starts empty is the first close if the open volume
    is at least `need`; from there on all is known: bars closed and volume left open."""
    key, volumes, limit = None, [], 0

    def settle() -> tuple:
        v = np.concatenate(volumes)
        run = np.concatenate([[0], np.cumsum(v)])
        n = len(v)
        # the close after starting empty at each row, then the rest of the chunk from behind
        close = np.maximum(np.searchsorted(run, run[:-1] + limit, "left"), np.arange(1, n + 1)) - 1
        bars, left = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            j = close[i]
            bars[i], left[i] = (1 + bars[j + 1], left[j + 1]) if j < n else (0, run[n] - run[i])
        last = min(int(close[0]), n - 1)
        need = limit - run[1 : last + 2]
        return (*key, int(run[n]), need.tolist(), (1 + bars[1 : last + 2]).tolist(), left[1 : last + 2].tolist())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["pool", "chunk", "total", "need", "bars", "left"])

    for batch in batches:
        pools, chunks = batch.column("pool").to_pylist(), batch.column("chunk").to_pylist()
        micro, limits = batch.column("micro").to_numpy(), batch.column("limit").to_numpy()
        keys = list(zip(pools, chunks))
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        done = []
        for begin, end in zip([0, *cuts], [*cuts, len(keys)]):
            if begin == end:
                continue
            if keys[begin] != key and volumes:
                done.append(settle())
                volumes = []
            key, limit = keys[begin], int(limits[begin])
            volumes.append(micro[begin:end])
        if done:
            yield batch_of(done)
    if volumes:
        yield batch_of([settle()])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries sorted by (pool, chunk): the bar number and open volume each chunk starts with."""
    pool, bar, open_ = None, 0, 0
    for batch in batches:
        out = []
        for p, chunk, total, need, bars, left in zip(*(batch.column(c).to_pylist() for c in ("pool", "chunk", "total", "need", "bars", "left"))):
            if p != pool:
                pool, bar, open_ = p, 0, 0
            out.append((p, chunk, bar, open_))
            hit = next((i for i, x in enumerate(need) if open_ >= x), None)
            bar, open_ = (bar, open_ + total) if hit is None else (bar + bars[hit], left[hit])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["pool", "chunk", "_bar", "_open"])


def _assign_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pool, chunk, time) that carry what their chunk starts with."""
    key, bar, open_ = None, 0, 0
    for batch in batches:
        keys = list(zip(batch.column("pool").to_pylist(), batch.column("chunk").to_pylist()))
        micro, limits, bars, opens = (batch.column(c).to_pylist() for c in ("micro", "limit", "_bar", "_open"))
        numbers, closed = [], []
        for k, m, limit, b, o in zip(keys, micro, limits, bars, opens):
            if k != key:
                key, bar, open_ = k, b, o
            open_ += m
            numbers.append(bar)
            closed.append(open_ >= limit)
            if closed[-1]:
                bar, open_ = bar + 1, 0
        keep = [n for n in batch.schema.names if n not in ("chunk", "_bar", "_open")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(numbers, pa.int64()), pa.array(closed, pa.bool_())], [*keep, "bar_no", "closes"])


def assign_bars_in_chunks(rows: DataFrame, seconds: int = 86_400) -> DataFrame:
    """T2, first step, parallel inside a pool: the same result as assign_bars. Chunks of time
    are summed up on their own; only the summaries, one small row a chunk, are chained by
    pool; then all chunks are numbered on their own. For pools that hold a large share of
    all rows."""
    chunked = rows.withColumn("chunk", F.floor(F.unix_micros("ts") / (seconds * MICRO)).cast("long"))
    own = chunked.select("pool", "chunk", *_order(rows), "micro", "limit").repartition("pool", "chunk").sortWithinPartitions("pool", "chunk", *_order(rows))
    summaries = own.mapInArrow(_summaries, "pool string, chunk long, total long, need array<long>, bars array<long>, left array<long>")
    starts = summaries.repartition("pool").sortWithinPartitions("pool", "chunk").mapInArrow(_chain, "pool string, chunk long, _bar long, _open long")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", bar_no long, closes boolean"
    joined = chunked.hint("merge").join(starts.hint("merge"), ["pool", "chunk"])
    return joined.repartition("pool", "chunk").sortWithinPartitions("pool", "chunk", *_order(rows)).select(*chunked.columns, "_bar", "_open").mapInArrow(_assign_chunk, schema)


#: Rows of a pool beyond which its bars are numbered in chunks of a day.
HOT_POOL_ROWS = 1_000_000


def dollar_bars(prices: DataFrame, thresholds: DataFrame, chunk_seconds: int | None = None, numeraire: str | None = None) -> DataFrame:
    """Closed bars of each pool. prices: pool, block_timestamp,
    event_id, token_address, price_in_usdc, usdc_volume, flow_sign; thresholds: pool,
    token_a, token_b, threshold. A bar without a price of a side is left out, but counts
    for the number of the next, its time delta and its liquidity. Where prices has tick and
    liquidity, bars get, for both sides, the closing minus the opening tick and the log1p of
    the liquidity last seen, in the bar or before it. chunk_seconds: number the bars in
    parallel chunks of a pool; None: days, where a pool has over HOT_POOL_ROWS rows.
    numeraire: a token whose price is always 1."""
    state = {"tick", "liquidity"} <= set(prices.columns)
    joined = prices.join(thresholds, "pool")
    rows = joined.select(
        "pool", F.col("block_timestamp").alias("ts"), F.col("event_id").alias("tie"), F.round(F.col("usdc_volume") * MICRO).cast("long").alias("micro"),
        F.round(F.col("threshold") * MICRO).cast("long").alias("limit"), "token_address", F.col("price_in_usdc").alias("price"), (F.col("flow_sign") * F.col("usdc_volume")).alias("flow"), "token_a", "token_b",
        # a swap between two tokens has a row for each, that of token_a first; a bar may end between them
        F.when(F.col("token_address") == F.col("token_a"), 0).otherwise(1).alias("sub"),
        *((F.col("tick").cast("double").alias("tick"), F.col("liquidity").cast("double").alias("liquidity")) if state else ()),
    )
    if chunk_seconds is None and (prices.groupBy("pool").count().agg(F.max("count")).first()[0] or 0) > HOT_POOL_ROWS:
        chunk_seconds = 86_400
    order = F.struct("ts", "tie")
    side = lambda t, e: F.when(F.col("token_address") == F.col(t), e)
    known = lambda c: F.when(F.col(c).isNotNull(), order)
    assigned = assign_bars_in_chunks(rows, chunk_seconds) if chunk_seconds else assign_bars(rows)
    bars = assigned.groupBy("pool", "bar_no").agg(
        F.max("closes").alias("closed"), F.max("ts").alias("bar_close_timestamp"), F.first("token_a").alias("token_a"), F.first("token_b").alias("token_b"),
        F.countDistinct("ts", "tie").alias("tick_count"), F.sum("micro").alias("volume_micro"),
        F.sum(side("token_a", F.col("flow"))).alias("flow_a"), F.sum(side("token_b", F.col("flow"))).alias("flow_b"),
        F.max_by(F.col("price"), side("token_a", order)).alias("price_a"), F.max_by(F.col("price"), side("token_b", order)).alias("price_b"),
        *((F.max_by("tick", known("tick")) - F.min_by("tick", known("tick"))).alias("tick_delta") for _ in range(state)), *(F.max_by("liquidity", known("liquidity")).alias("_l") for _ in range(state)),
    ).where("closed")
    # what goes from bar to bar is a scan: a pool's bars may be in many tasks
    run = carried(bars, ["pool"], ["bar_no"], _before=latest("bar_close_timestamp", own=False), **({"_l": latest("_l")} if state else {}))
    delta = (F.unix_micros("bar_close_timestamp") - F.unix_micros("_before")) / 1e6
    own = lambda s: F.when(F.col(f"token_{s}") == F.lit(numeraire), F.lit(1.0)).otherwise(F.col(f"price_{s}"))
    flows = {f"flow_{s}": F.coalesce(f"flow_{s}", F.lit(0.0)) for s in "ab"}
    out = run.withColumns({"bar_time_delta_sec": F.coalesce(delta, F.lit(0.0)), "price_a": own("a"), "price_b": own("b")} | flows).where("price_a is not null and price_b is not null")
    return directed(out.withColumn("liquidity_close", F.log1p("_l")) if state else out)


def directed(bars: DataFrame) -> DataFrame:
    """The source is the token of larger net flow; on a tie token_b."""
    a = F.abs("flow_a") > F.abs("flow_b")
    pick = lambda x, y: F.when(a, F.col(x)).otherwise(F.col(y))
    both = [F.col(c).alias(f"{s}_{c}") for c in ("liquidity_close", "tick_delta") if c in bars.columns for s in ("src", "dest")]
    return bars.select(
        "pool", "bar_no", "bar_close_timestamp", pick("token_a", "token_b").alias("src_token_id"), pick("token_b", "token_a").alias("dest_token_id"),
        pick("flow_a", "flow_b").alias("src_flow_usdc"), pick("flow_b", "flow_a").alias("dest_flow_usdc"), pick("price_a", "price_b").alias("src_price_usdc"), pick("price_b", "price_a").alias("dest_price_usdc"),
        "bar_time_delta_sec", "tick_count", "volume_micro", *both,
    )


def illiquid_tokens(bars: DataFrame, max_gap_s: float = 86_400.0, share: float = 0.2) -> DataFrame:
    """Tokens of which over `share` of the bars, in either role, follow a gap
    longer than max_gap_s; one pass for both counts."""
    role = lambda c: bars.select(F.col(c).alias("token"), (F.col("bar_time_delta_sec") > max_gap_s).cast("double").alias("gap"))
    per = lambda c: role(c).groupBy("token").agg(F.avg("gap").alias("ratio")).where(F.col("ratio") > share).select("token")
    return per("src_token_id").union(per("dest_token_id")).distinct()


def filter_illiquid(bars: DataFrame, max_gap_s: float = 86_400.0, share: float = 0.2) -> DataFrame:
    """Bars with neither token illiquid."""
    bars = written(bars, "bars")
    # written, so that Spark knows how few they are
    bad = written(illiquid_tokens(bars, max_gap_s, share), "illiquid")
    return bars.join(bad, bars.src_token_id == bad.token, "left_anti").join(bad, bars.dest_token_id == bad.token, "left_anti")


def tick_and_liquidity(rows: DataFrame) -> DataFrame:
    """Per (pool, bar_no): closing minus opening tick, and the closing liquidity
    as log1p, carried on from earlier bars where a bar has none."""
    order = F.struct("ts", "tie")
    per = rows.groupBy("pool", "bar_no").agg((F.max_by("tick", order) - F.min_by("tick", order)).alias("tick_delta"), F.max_by(F.col("liquidity"), F.when(F.col("liquidity").isNotNull(), order)).alias("l"))
    return carried(per, ["pool"], ["bar_no"], l=latest("l")).select("pool", "bar_no", "tick_delta", F.log1p("l").alias("liquidity_close"))


def z_scored(df: DataFrame, column: str, out: str) -> DataFrame:
    """Global z-score with the sample deviation; unchanged if that is 0. The
    statistics are one row."""
    s = df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    return df.crossJoin(F.broadcast(s)).withColumn(out, F.when(F.col("_s") > 0, (F.col(column) - F.col("_m")) / F.col("_s")).otherwise(F.col(column))).drop("_m", "_s")
