"""Streams in full: rows out of order over micro-batches give what the batch gives."""

import datetime as dt
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidepool.operators import bars, indirect, pricing
from tidepool.streaming import ordered

T0 = dt.datetime(2024, 1, 1)
SWAPS = "block_timestamp timestamp, block_number long, event_id long, token0 string, token1 string, amount0 double, amount1 double, token0_decimals int, token1_decimals int, pool string"
PRICES = "pool string, block_timestamp timestamp, event_id long, token_address string, price_in_usdc double, usdc_volume double, flow_sign int, tick int, liquidity double"


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    ordered.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, batches, schema, transform, tmp_path):
    src, name = tmp_path / "in", f"ordered_{abs(hash(str(tmp_path)))}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None, q.exception()
    return spark.table(name), q


def mixed(rows, size, reach, seed):
    """Batches of rows in time order, each row moved by up to `reach` places."""
    rng = random.Random(seed)
    moved = [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rng.random() * reach)]
    return [moved[i : i + size] for i in range(0, len(moved), size)]


def swaps(n, seed):
    rng, now, out = random.Random(seed), 0, []
    for e in range(n):
        now += rng.choice([1, 2, 3, 8, 30])
        direct = rng.random() < 0.55
        t0, t1 = ("u", rng.choice("abcdef")) if direct else rng.sample("abc" if rng.random() < 0.6 else "def", 2)
        out.append((T0 + dt.timedelta(seconds=now), now, e, t0, t1, rng.randint(1, 900) * 1e6, rng.randint(1, 90) * 1e6, 6, 6, "p"))
    return out


def priced(rows, indirect_only=True):
    return sorted((r.event_id, r.token_address, round(r.price_in_usdc, 9), round(r.usdc_volume, 6)) for r in rows if not (indirect_only and r.direct))


def test_indirect_prices(few, tmp_path):
    rows = swaps(600, 3)
    df = few.createDataFrame(rows, SWAPS)
    want = priced(indirect.indirect_prices(df, "u", 100.0).collect())
    cross = df.where("token0 <> 'u' and token1 <> 'u'")
    labels = pricing.components(cross.select(F.col("token0").alias("a"), F.col("token1").alias("b")))
    end = [(rows[-1][0] + dt.timedelta(days=3), 0, 10**6, "u", "a", 1e6, 1e6, 6, 6, "p")]
    out, _ = streamed(few, [*mixed(rows, 150, 20, 1), end], SWAPS, lambda s: ordered.stream_indirect_prices(s, "u", labels, 100.0, "30 minutes"), tmp_path)
    got = priced(out.where("event_id < 1000000").collect())
    assert got == want and len(got) > 20


def test_late_rows_and_expiry(few, tmp_path):
    """A row behind the watermark counts nowhere, and prices that are too old leave the state
    though their component sees nothing more."""
    def row(s, e, t0, t1, a0, a1):
        return (T0 + dt.timedelta(seconds=s), s, e, t0, t1, a0 * 1e6, a1 * 1e6, 6, 6, "p")

    labels = few.createDataFrame([("a", "a"), ("b", "a"), ("x", "x"), ("y", "x")], "token string, component string")
    batches = [
        [row(10, 1, "u", "a", 20, 10), row(11, 2, "u", "b", 30, 10), row(12, 3, "a", "b", 5, 5)],
        [row(5000, 4, "u", "x", 1, 1)],
        # behind the watermark: would change the prices of a and b
        [row(13, 5, "u", "a", 900, 1), row(14, 6, "a", "b", 5, 5), row(5001, 7, "u", "y", 1, 1)],
        [row(9000, 8, "x", "y", 1, 1)],
        [row(20000, 9, "u", "x", 1, 1)],
        [row(20001, 10, "u", "x", 1, 1)],
    ]
    out, q = streamed(few, batches, SWAPS, lambda s: ordered.stream_indirect_prices(s, "u", labels, 100.0, "10 seconds"), tmp_path)
    got = priced(out.collect(), indirect_only=False)
    assert [g[0] for g in got if g[0] < 9] == [1, 2, 3, 3, 4, 7]
    # event 8 comes 4,000 s after the prices of x and y; those of a and b are gone from the state
    removed = sum(int(s["numRowsRemoved"]) for p in q.recentProgress for s in p["stateOperators"])
    assert removed >= 2


def test_dollar_bars(few, tmp_path):
    rng, now, rows = random.Random(7), 0, []
    for e in range(1200):
        now += rng.choice([0, 1, 5, 60])
        rows.append((f"p{e % 3}", T0 + dt.timedelta(seconds=now), e, rng.choice("ab"), rng.randint(1, 90) / 7, rng.randint(0, 900) / 1.0, rng.choice([1, -1]), None if rng.random() < 0.3 else rng.randint(-50, 50), None if rng.random() < 0.8 else float(rng.randint(1, 10**6))))
    df = few.createDataFrame(rows, PRICES)
    limits = few.createDataFrame([("p0", "a", "b", 2500.0), ("p1", "a", "b", 300.0), ("p2", "b", "a", 0.0)], "pool string, token_a string, token_b string, threshold double")
    columns = ["pool", "bar_no", "bar_close_timestamp", "src_token_id", "tick_count", "volume_micro", "src_flow_usdc", "dest_flow_usdc", "src_price_usdc", "dest_price_usdc", "bar_time_delta_sec", "src_tick_delta", "dest_liquidity_close"]

    def plain(found):
        return sorted((tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in found.select(*columns).collect()), key=str)

    want = plain(bars.dollar_bars(df, limits))
    assert plain(bars.dollar_bars(df, limits, 600)) == want
    end = [(p, rows[-1][1] + dt.timedelta(days=3), 10**6, "a", 1.0, 0.0, 1, None, None) for p in ("p0", "p1")]
    out, _ = streamed(few, [*mixed(rows, 300, 30, 2), end], PRICES, lambda s: ordered.stream_dollar_bars(s, limits, "2 hours"), tmp_path)
    assert plain(out) == want and len(want) > 100
    assert any(r[-1] is not None for r in want) and any(r[-2] is None for r in want)
