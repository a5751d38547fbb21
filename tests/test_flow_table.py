"""M9's table of flows: equal to plain loops, bars shuffled once, files of a write deleted with it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import features, folds, graph
from tidepool.operators.tables import settled

FIELDS = "row long, batch long, pool_id long, src_token_id long, dest_token_id long, src_flow_usdc double, src_liquidity_close double, src_fracdiff double, dest_fracdiff double, rolling_volatility double, src_tick_delta double"


def _rows(n: int, size: int) -> list[tuple]:
    rng = random.Random(4)
    some = lambda share, v: v if rng.random() < share else None
    # pool 8 has bars in the first and in the last batches only, pool 9 one
    pool = lambda i: 9 if i == 7 else 8 if (i < 4 or i > n - 4) else some(0.95, rng.randint(1, 7))
    return [
        (i, i // size, pool(i), some(0.95, rng.randint(1, 6)), some(0.95, rng.randint(1, 6)), some(0.95, rng.uniform(-90, 90)), some(0.8, rng.uniform(0, 9)), some(0.9, rng.uniform(-1, 1)), rng.uniform(-1, 1), some(0.9, float("nan") if i % 50 == 0 else rng.random()), rng.random())
        for i in range(n)
    ]


def test_flows_equal_plain_loops(spark):
    """150 batches in at most 64 groups; null pools, tokens and flows."""
    rows = _rows(1500, 10)
    bars = spark.createDataFrame(rows, FIELDS)
    hops = {(r.batch, r.node): (r.hop1, r.hop2) for r in graph.temporal_messages(bars, "batch", "src_fracdiff").collect() if r.node is not None}
    known = [r[6] for r in rows if r[6] is not None]
    mean = sum(known) / len(known)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in known) / len(known))
    log = lambda x: None if x is None else math.log1p(abs(x))
    zero = lambda x: 0.0 if x is None or math.isnan(x) else x
    want, ahead = {}, {}
    for r in reversed(rows):
        target, ahead[r[2]] = ahead.get(r[2]), log(r[5])
        if target is not None:
            near = [*hops.get((r[1], r[3]), (None, None)), *hops.get((r[1], r[4]), (None, None))]
            want[r[0]] = [zero(x) for x in (r[7], r[8], r[9], None if r[6] is None else (r[6] - mean) / deviation, r[10], log(r[5]), *near)] + [target]
    got = {r.row: list(r)[1:] for r in features.flow_table(bars, "batch", "pool_id", "row").collect()}
    assert got.keys() == want.keys() and len(got) > 1300 and {r[2] for r in rows if r[0] in got} >= {None, 8}
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_bars_are_shuffled_once(spark):
    bars = settled(spark.createDataFrame(_rows(400, 10), FIELDS), "test_bars")
    plan = features.flow_table(bars, "batch", "pool_id", "row")._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.splitlines() if "Exchange " in x and "REPARTITION" in x] and "Join" not in plan
    # the others are the first flows of pools in groups
    assert len([x for x in plan.splitlines() if "Exchange " in x]) <= 3, plan


def test_split_in_place_is_the_temporal_split(spark):
    for n in (0, 1, 9, 4000):
        df = settled(spark.createDataFrame([(i % 13, i, float(i)) for i in range(n)], "a long, b long, v double"), "test_split")
        split = folds.split_in_place(df, "a", "b")
        assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
        same = folds.temporal_split(df, "a", "b").select("a", "b", F.col("split").alias("other")).join(split, ["a", "b"])
        assert same.where("split = other").count() == n


def test_settled_leaves_no_shuffle_files(spark):
    files = lambda: sum("shuffle_" in str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString().split(","))
    before = files()
    out = settled(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("s")), "test_settled")
    assert files() <= before and out.count() == 97
