"""The price report where a token's least price, or all of its prices, are 0."""

import datetime as dt
import math

from tests.compare import oracle, same
from tidepool.operators import quality
from tidepool.plans import catalog

PRICES = "block_timestamp timestamp, event_id long, pool string, token_address string, price_in_usdc double, usdc_volume double"


def test_ratio_to_a_price_of_zero(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(minutes=i), i, "p", t, x, 1.0) for t, prices in (("a", (0.0, 2.0)), ("b", (1.0, 4.0))) for i, x in enumerate(prices * 6)]
    got = {(r["check"], r.metric): r.value for r in quality.prices_report(spark.createDataFrame(rows, PRICES)).collect()}
    assert math.isinf(got["tokens", "largest_range_ratio"])
    only = quality.prices_report(spark.createDataFrame([r for r in rows if r[3] == "b"] + [(at, 99, "p", "c", 0.0, 1.0)] * 12, PRICES))
    assert math.isnan({(r["check"], r.metric): r.value for r in only.collect()}["tokens", "largest_cv"])


def test_against_sql_where_a_price_is_zero(spark):
    big = "/root/testdata/sf0.1"
    assert oracle("SELECT count(*) AS n FROM events WHERE value = 0", big)["n"][0] > 0
    for name in ("q2_prices_report", "a6_volatility"):
        same(catalog.QUERIES[name](spark, big).toPandas(), oracle(catalog.ORACLE_SQL[name], big))
