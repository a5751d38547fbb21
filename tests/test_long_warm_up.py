"""T1 where a warm-up is longer than an Arrow batch: such a batch has no output."""

import random

import numpy as np

from tests.test_operators import at, slow_prices
from tidepool.operators import indirect

SWAPS = "block_timestamp timestamp, block_number long, event_id long, token0 string, token1 string, amount0 double, amount1 double, token0_decimals int, token1_decimals int, pool string"


def test_batches_without_output(spark):
    rng, swaps, now = random.Random(3), [], 0
    for e in range(900):
        now += rng.choice([1, 1, 2])
        t0, t1 = ("u", rng.choice("abc")) if rng.random() < 0.6 else rng.sample("abc", 2)
        swaps.append((e, now, t0, t1, float(rng.randint(20, 90)), float(rng.randint(20, 90))))
    df = spark.createDataFrame([(at(s), s, e, t0, t1, a0 * 1e6, a1 * 1e6, 6, 6, "p") for e, s, t0, t1, a0, a1 in swaps], SWAPS)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "8")
    try:
        got = sorted((r.event_id, r.token_address, r.price_in_usdc) for r in indirect.indirect_prices(df, "u", 60.0, 120.0).where("not direct").collect())
    finally:
        spark.conf.set(name, before)
    want = sorted(slow_prices(swaps, 60))
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) > 100
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-9)
