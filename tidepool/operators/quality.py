"""Data-quality reports: DataFrame(check, metric, value, status), each from one pass of
aggregates stacked into rows (Q1 to Q9), and the shared checks (A5 to A11, A21 to A25)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.functions import decode
from tidepool.functions.numbers import correlation, finite, quotient
from tidepool.operators.ranges import RANGES, with_range
from tidepool.operators.quantiles import exact_quantiles
from tidepool.operators.scans import RANGE_ROWS, carried, most
from tidepool.operators.tables import written
from tidepool.sources.readers import require


#: (check, metric) to (aggregate, least, most)
Rules = dict[tuple[str, str], tuple[Column, float | None, float | None]]


def report(df: DataFrame, rules: Rules) -> DataFrame:
    """A row for each rule; a value outside its bounds is `fail`."""
    names = list(rules)
    one = df.agg(*(rules[n][0].cast("double").alias(f"v{i}") for i, n in enumerate(names)))
    rows = []
    for i, (check, metric) in enumerate(names):
        _, low, high = rules[(check, metric)]
        v = F.col(f"v{i}")
        bad = F.lit(False)
        if low is not None:
            bad = bad | (v < low)
        if high is not None:
            bad = bad | (v > high)
        rows.append(F.struct(F.lit(check).alias("check"), F.lit(metric).alias("metric"), v.alias("value"), F.when(v.isNull(), "none").when(bad, "fail").otherwise("pass").alias("status")))
    return one.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def null_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(column, nulls), one pass."""
    columns = columns or tuple(df.columns)
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(columns)))).alias("e")).select("e.*")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """A1: how many keys occur more than once, and how many rows they have."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return per.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def stats(df: DataFrame, column: str) -> DataFrame:
    """A5: a block of statistics; the median is exact. All are one row."""
    middle = exact_quantiles(df, [column], [0.5]).select(F.col("value").alias("median"))
    return df.agg(F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.sum(column).alias("total")).crossJoin(F.broadcast(middle))


def largest_gap(df: DataFrame, ts: str) -> DataFrame:
    """The largest time between consecutive rows. Gaps inside a range of times are found by
    a window on the range, those between ranges from each range's first and last row."""
    times = written(df.select(F.col(ts).alias("t")).where("t is not null").distinct(), "times")
    parts = with_range(times, "t", ranges=max(RANGES, times.count() // RANGE_ROWS))
    inside = parts.select((F.unix_micros("t") - F.unix_micros(F.lag("t").over(Window.partitionBy("_range").orderBy("t")))).alias("g"))
    ends = parts.groupBy("_range").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    between = ends.select((F.unix_micros("a") - F.unix_micros(F.lag("z").over(Window.orderBy("_range")))).alias("g"))
    return inside.unionByName(between).agg((F.max("g") / 1e6).alias("gap_sec"))


def out_of_order(df: DataFrame, ts: str, *arrival: str) -> DataFrame:
    """How many rows are earlier than one that arrived before them."""
    seen = carried(df.select(F.col(ts).alias("t"), *(F.col(c).alias(f"a{i}") for i, c in enumerate(arrival))), [], [f"a{i}" for i in range(len(arrival))], latest_=most("t", own=False))
    return seen.agg(F.count_if(F.col("t") < F.col("latest_")).alias("rows"))


def quantile_rows(df: DataFrame, *columns: tuple[str, str], qs: dict[str, float] | None = None) -> DataFrame:
    """Report rows of exact quantiles, of all columns in the same passes; columns: (check,
    column); qs: metric to quantile, the median by default."""
    qs = qs or {"median": 0.5}
    found = exact_quantiles(df, [c for _, c in columns], list(qs.values()))
    name = F.create_map(*(x for c, k in columns for x in (F.lit(k), F.lit(c))))
    metric = F.create_map(*(x for m, q in qs.items() for x in (F.lit(q), F.lit(m))))
    return found.select(name[F.col("column")].alias("check"), metric[F.col("q")].alias("metric"), "value", F.when(F.col("value").isNull(), "none").otherwise("pass").alias("status"))


def medians(df: DataFrame, *columns: str) -> DataFrame:
    """Report rows (median, column) of exact medians."""
    found = exact_quantiles(df, list(columns), [0.5])
    return found.select(F.lit("median").alias("check"), F.col("column").alias("metric"), "value", F.when(F.col("value").isNull(), "none").otherwise("pass").alias("status"))


def distribution(df: DataFrame, check: str, column: Column) -> DataFrame:
    """A row for each value of a column: how many rows have it."""
    per = df.groupBy(column.cast("string").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return per.select(F.lit(check).alias("check"), "metric", "value", F.lit("pass").alias("status"))


def worst(df: DataFrame, check: str, key: str, value: Column, k: int = 5) -> DataFrame:
    """K3: the k keys of largest value, ties to the smaller key."""
    per = df.groupBy(F.col(key).cast("string").alias("metric")).agg(value.cast("double").alias("value"))
    top = per.orderBy(F.desc_nulls_last("value"), "metric").limit(k)
    return top.select(F.lit(check).alias("check"), "metric", "value", F.lit("pass").alias("status"))


def price_jumps(bars: DataFrame, key: str, price: str, *order: str, most: float = 0.5) -> DataFrame:
    """Rows of each key whose price moved by over `most` of the one before."""
    before = F.lag(price).over(Window.partitionBy(key).orderBy(*order))
    return bars.withColumn("_b", before).groupBy(key).agg(F.count_if(F.abs(F.col(price) - F.col("_b")) / (F.col("_b") + 1e-9) > most).alias("jumps"), F.count("*").alias("n"))


def concentration(df: DataFrame, column: str, *tops: int) -> DataFrame:
    """The share of rows of the largest addresses."""
    per = df.groupBy(column).agg(F.count("*").alias("n"))
    # the largest are found by a distributed top-k; the total is one row
    most = per.orderBy(F.desc("n"), column).limit(max(tops)).withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), column)))
    total = per.agg(F.sum("n").alias("total"))
    return most.crossJoin(F.broadcast(total)).agg(*((F.sum(F.when(F.col("k") <= t, F.col("n")).otherwise(0)) / F.max("total")).alias(f"top{t}") for t in tops))


def coverage(swaps: DataFrame, numeraire: object, bars: DataFrame, token: object) -> DataFrame:
    """One row of shares: swaps with the numeraire as token0, as token1, on a side, on
    none; bars with a token as source, as destination, on a side; bars with a label."""
    share = lambda c: F.avg(c.cast("double"))
    t0, t1, src, dest = F.col("token0") == numeraire, F.col("token1") == numeraire, F.col("src_token_id") == token, F.col("dest_token_id") == token
    of_swaps = swaps.agg(share(t0).alias("swaps_token0"), share(t1).alias("swaps_token1"), share(t0 | t1).alias("swaps_direct"), share(~(t0 | t1)).alias("swaps_indirect"))
    of_bars = bars.agg(share(src).alias("bars_src"), share(dest).alias("bars_dest"), share(src | dest).alias("bars_either"), (F.count("label") / F.count("*")).alias("labels"))
    return of_swaps.crossJoin(F.broadcast(of_bars))  # one row each


def low_days(df: DataFrame, ts: str, share: float = 0.1) -> DataFrame:
    """Days with fewer rows than `share` of the median day."""
    per = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.median("n").alias("m")))).where(F.col("n") < share * F.col("m")).select("day", "n")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Least over most class, and whether the imbalance is severe."""
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n"), (F.min("n") / F.max("n")).alias("ratio"), ((F.max("n") / F.sum("n") > 0.8) | (F.min("n") / F.max("n") < 0.1)).alias("severe"))


def label_summary(labels: DataFrame, key: str = "token") -> DataFrame:
    """Q9: of each token the labels (label, touch, weight; label null: not labelled), how far
    off their touches are, and their mean weight."""
    n = lambda x: F.count_if(F.col("label") == x)
    touch = F.avg(F.when(F.col("label").isNotNull(), F.col("touch")))
    return labels.groupBy(key).agg(F.count("*").alias("n"), F.count("label").alias("labelled"), n(1).alias("up"), n(-1).alias("down"), n(0).alias("none"), touch.alias("touch"), F.avg("weight").alias("weight"))


def correlations(df: DataFrame, *columns: str) -> DataFrame:
    """The correlation of each pair of columns on complete rows, one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.dropna(subset=list(columns)).agg(*(correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("e")).select("e.*")


def nulls(*columns: str) -> Rules:
    """A rule for each column: no nulls."""
    return {("nulls", c): (F.count_if(F.col(c).isNull()), 0, 0) for c in columns}


def spread(check: str, column: str, low: float | None = None, high: float | None = None) -> Rules:
    """Least, mean, most and deviation of a column; least and most have bounds."""
    return {(check, "least"): (F.min(column), low, None), (check, "mean"): (F.avg(column), None, None), (check, "most"): (F.max(column), None, high), (check, "std"): (F.stddev_samp(column), None, None)}


def together(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def swaps_report(swaps: DataFrame, address_chars: int = 42, max_gap_s: float = 3600.0, arrival: tuple[str, ...] = ("block_number", "event_id")) -> DataFrame:
    """Q1: duplicates, nulls, form of data and addresses, decimals and their distribution,
    decodability of every row, order and largest gap, concentration of pools, and of the
    senders that are their own recipient."""
    swaps = written(swaps, "swaps")
    alike = swaps.where(F.col("sender") == F.col("recipient"))
    d0, d1 = F.col("token0_decimals"), F.col("token1_decimals")
    rules = nulls("block_timestamp", "transaction_hash", "pool", "token0", "token1", "data") | {
        ("form", "not_hex"): (F.count_if(~decode.is_hex(F.col("data"))), 0, 0), ("form", "data_length"): (F.count_if(F.length("data") != 322), 0, 0),
        ("form", "address_length"): (F.count_if((F.length("token0") != address_chars) | (F.length("token1") != address_chars)), 0, 0),
        ("form", "same_tokens"): (F.count_if(F.col("token0") == F.col("token1")), 0, 0), ("decode", "failed"): (F.count_if(~F.col("data").rlike("^0x[0-9a-fA-F]{320}$")), 0, 0),
        ("decimals", "out_of_range"): (F.count_if(~d0.between(0, 77) | ~d1.between(0, 77)), 0, 0), ("decimals", "least"): (F.min(F.least(d0, d1)), 0, None), ("decimals", "most"): (F.max(F.greatest(d0, d1)), None, 77),
        ("rows", "n"): (F.count("*"), 1, None),
    }
    return together(
        report(swaps, rules), report(duplicate_keys(swaps, "transaction_hash", "pool"), {("duplicates", "rows"): (F.max("rows"), 0, 0)}),
        report(largest_gap(swaps, "block_timestamp"), {("order", "largest_gap_sec"): (F.max("gap_sec"), None, max_gap_s)}),
        report(out_of_order(swaps, "block_timestamp", *arrival), {("order", "rows"): (F.max("rows"), 0, 0)}),
        distribution(swaps, "decimals0", F.col("token0_decimals")), distribution(swaps, "decimals1", F.col("token1_decimals")),
        report(concentration(swaps, "pool", 1, 10, 100), {("concentration", f"top{n}"): (F.max(f"top{n}"), None, None) for n in (1, 10, 100)}),
        report(swaps, {("own_recipient", "share"): (F.avg((F.col("sender") == F.col("recipient")).cast("double")), None, None)}),
        report(alike, {("own_recipient", "rows"): (F.count("*"), None, None), ("own_recipient", "senders"): (F.countDistinct("sender"), None, None)}),
        report(concentration(alike, "sender", 10, 100), {("own_recipient", f"top{n}"): (F.max(f"top{n}"), None, None) for n in (10, 100)}),
    )


def prices_report(prices: DataFrame, max_gap_s: float = 3600.0, observed: int = 10, arrival: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Q2: nulls, order and gap, price and volume statistics with medians, prices out of range,
    tokens of extreme variation (deviation over twice the mean), volume of tokens of low
    price, rows a token."""
    prices = written(prices, "prices")
    p = F.col("price_in_usdc")
    rules = nulls("block_timestamp", "pool", "token_address", "price_in_usdc", "usdc_volume") | spread("price", "price_in_usdc", 1e-6, 1e6) | spread("volume", "usdc_volume", 0) | {
        ("price", "tiny"): (F.count_if(p < 1e-6), 0, 0), ("price", "huge"): (F.count_if(p > 1e6), 0, 0), ("price", "low"): (F.count_if(p < 1e-4), None, None),
        ("volume", "total"): (F.sum("usdc_volume"), None, None), ("rows", "n"): (F.count("*"), 1, None),
    }
    per = prices.groupBy("token_address").agg(F.count("*").alias("n"), quotient(F.stddev_samp(p), F.avg(p)).alias("cv"), quotient(F.max(p), F.min(p)).alias("ratio"), F.count_if(p < 1e-4).alias("low"), F.sum(F.when(p < 1e-4, F.col("usdc_volume"))).alias("low_volume"))
    per = written(per, "tokens")
    tokens = {
        ("tokens", "n"): (F.count("*"), 1, None), ("tokens", "extreme_variation"): (F.count_if((F.col("n") >= observed) & (F.col("cv") > 2.0)), 0, 0), ("tokens", "with_low_price"): (F.count_if(F.col("low") > 0), None, None), ("tokens", "low_price_volume"): (F.coalesce(F.sum("low_volume"), F.lit(0.0)), None, None),
        ("tokens", "largest_cv"): (F.max(F.when(F.col("n") >= observed, F.col("cv"))), None, None), ("tokens", "largest_range_ratio"): (F.max(F.when(F.col("n") >= observed, F.col("ratio"))), None, None),
        ("tokens", "least_rows"): (F.min("n"), None, None), ("tokens", "most_rows"): (F.max("n"), None, None),
    }
    return together(
        report(prices, rules), report(largest_gap(prices, "block_timestamp"), {("order", "largest_gap_sec"): (F.max("gap_sec"), None, max_gap_s)}), report(per, tokens),
        report(out_of_order(prices, "block_timestamp", *arrival), {("order", "rows"): (F.max("rows"), 0, 0)}), quantile_rows(prices, ("price", "price_in_usdc"), ("volume", "usdc_volume")), quantile_rows(per, ("tokens", "n"), qs={"median_rows": 0.5}),
    )


def bars_report(bars: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], day_s: float = 86_400.0) -> DataFrame:
    """Q3: duplicates of keys, nulls, order, time deltas and the pools with most late bars, tick
    counts, flows, prices and their jumps in order, liquidity, tick movement, rows a pool,
    medians. A pool's bars come in `order`."""
    bars = written(bars, "bars")
    count = lambda c: (F.count_if(c), None, None)
    none = lambda c: (F.count_if(c), 0, 0)
    late = F.col("bar_time_delta_sec") > day_s
    rules = nulls("bar_close_timestamp", "pool_id", "src_token_id", "dest_token_id", "src_flow_usdc", "dest_flow_usdc", "src_price_usdc", "dest_price_usdc")
    rules |= spread("delta", "bar_time_delta_sec", 0, day_s) | spread("ticks", "tick_count", 1) | spread("src_tick_delta", "src_tick_delta") | spread("dest_tick_delta", "dest_tick_delta")
    rules |= {("delta", "over_a_day"): none(late), ("ticks", "single"): count(F.col("tick_count") == 1), ("rows", "n"): (F.count("*"), 1, None)}
    for side in ("src", "dest"):
        flow, price, liquidity = (F.col(f"{side}_{c}") for c in ("flow_usdc", "price_usdc", "liquidity_close"))
        rules |= {
            ("flow", f"zero_{side}"): none(flow == 0), ("flow", f"mean_abs_{side}"): (F.avg(F.abs(flow)), 0, None), ("price", f"negative_{side}"): none(price < 0),
            ("liquidity", f"missing_{side}"): (F.avg(liquidity.isNull().cast("double")), None, None), ("liquidity", f"negative_{side}"): none(liquidity < 0),
        }
    jumps = price_jumps(bars, "pool_id", "src_price_usdc", *order)
    per = written(bars.groupBy("pool_id").agg(F.count("*").alias("n"), F.avg(late.cast("double")).alias("late")), "pools")
    pools = {("pools", "n"): (F.count("*"), 1, None), ("pools", "least_rows"): (F.min("n"), None, None), ("pools", "most_rows"): (F.max("n"), None, None), ("pools", "largest_late_share"): (F.max("late"), None, None)}
    return together(
        report(bars, rules), report(duplicate_keys(bars, *keys), {("duplicates", "rows"): (F.max("rows"), 0, 0)}), report(jumps, {("price", "jumps"): (F.sum("jumps"), None, None)}), report(per, pools),
        report(out_of_order(bars, "bar_close_timestamp", *order[1:]) if len(order) > 1 else out_of_order(bars, "bar_close_timestamp", order[0]), {("order", "rows"): (F.max("rows"), None, None)}),
        quantile_rows(bars, ("delta", "bar_time_delta_sec"), ("ticks", "tick_count"), ("src_tick_delta", "src_tick_delta"), ("dest_tick_delta", "dest_tick_delta"), ("liquidity", "src_liquidity_close")), quantile_rows(per, ("pools", "n"), qs={"median_rows": 0.5}),
        worst(bars, "late_pools", "pool_id", F.avg(late.cast("double"))),
    )


def stationary_report(bars: DataFrame) -> DataFrame:
    """Q4: types and nulls of the required columns (an error if one is missing), statistics
    of the differences, counts and days."""
    columns = ("src_fracdiff", "dest_fracdiff")
    require(bars, "bar_close_timestamp", "src_token_id", "dest_token_id", *columns)
    types = dict(bars.dtypes)
    rules: Rules = {("double", c): (F.max(F.lit(int(types[c] == "double"))), 1, 1) for c in columns}
    rules |= {("missing", c): (F.avg(F.col(c).isNull().cast("double")), None, 0.5) for c in columns}
    rules |= nulls("bar_close_timestamp", "src_token_id", "dest_token_id")
    for c in columns:
        rules |= spread(c, c)
    day = F.datediff(F.to_date("bar_close_timestamp"), F.lit("1970-01-01").cast("date"))
    rules |= {
        ("rows", "n"): (F.count("*"), 1, None), ("tokens", "src"): (F.countDistinct("src_token_id"), 1, None), ("tokens", "dest"): (F.countDistinct("dest_token_id"), 1, None),
        ("days", "first"): (F.min(day), None, None), ("days", "last"): (F.max(day), None, None),
    }
    return report(bars, rules)


def label_report(labels: DataFrame, label: str = "label", weight: str = "weight", touch: str = "touch", key: str = "token", ts: str = "ts", volatility: str = "vol") -> DataFrame:
    """Q5: the required columns (an error if one is missing), label distribution and imbalance
    (no label with over 80 % of the labelled rows), missing values, weights in [0, 1] with
    their mean and median, touches, tokens and days."""
    require(labels, label, weight, touch, key, ts, volatility)
    labels = written(labels, "labels")
    x, w = F.col(label), F.col(weight)
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    rules: Rules = {
        ("label", "unlabelled"): (F.count_if(x.isNull()), None, None), ("label", "up"): (F.count_if(x == 1), 1, None), ("label", "down"): (F.count_if(x == -1), 1, None), ("label", "none"): (F.count_if(x == 0), None, None),
        ("label", "others"): (F.count_if(~x.isin(-1, 0, 1)), 0, 0), ("label", "coverage"): (F.count(x) / F.count("*"), None, None),
        ("label", "largest_share"): (F.greatest(*(F.count_if(x == v) for v in (-1, 0, 1))) / F.count(x), None, 0.8),
        ("weight", "missing"): (F.count_if(x.isNotNull() & w.isNull()), 0, 0), ("weight", "least"): (F.min(w), 0, 1), ("weight", "most"): (F.max(w), 0, 1), ("weight", "mean"): (F.avg(w), None, None),
        ("volatility", "missing"): (F.count_if(x.isNotNull() & F.col(volatility).isNull()), 0, 0), ("touch", "least"): (F.min(touch), 1, None), ("touch", "most"): (F.max(touch), None, None), ("touch", "mean"): (F.avg(touch), None, None),
        ("rows", "n"): (F.count("*"), 1, None), ("tokens", "n"): (F.countDistinct(key), 1, None), ("days", "first"): (F.min(day), None, None), ("days", "last"): (F.max(day), None, None),
    }
    return together(report(labels, rules), quantile_rows(labels, ("weight", weight), ("touch", touch)))


# Expected range of each column of the training set.
EXPECTED = {
    "src_flow_usdc": (-1e8, 1e8), "dest_flow_usdc": (-1e5, 1e5), "src_fracdiff": (-5.0, 10.0), "dest_fracdiff": (-5.0, 10.0), "rolling_volatility": (0.0, 1.0), "bar_time_delta_sec": (0.0, 86400.0), "tick_count": (1, 10000),
    "label": (-1.0, 1.0), "sample_weight": (0.0, 1.0), "src_liquidity_close": (10.0, 100.0), "dest_liquidity_close": (10.0, 100.0), "src_tick_delta": (-5.0, 5.0), "dest_tick_delta": (-5.0, 5.0),
}


#: Columns whose six correlations are reported.
CORRELATED = ("src_flow_usdc", "dest_flow_usdc", "src_fracdiff", "rolling_volatility")


def training_report(bars: DataFrame, keys: tuple[str, ...], max_gap_s: float = 3600.0) -> DataFrame:
    """Q6: not finite and missing values, duplicates, expected ranges (ten times the upper
    bound; ten times a negative and a tenth of a positive lower one), zero shares,
    stationarity, negatives, z-scores, correlation, label quality, gaps and quiet days."""
    bars = written(bars, "training")
    rules: Rules = {}
    for c, (low, high) in EXPECTED.items():
        x = F.col(c).cast("double")
        rules |= {
            ("finite", c): (F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))), 0, 0), ("missing", c): (F.avg(F.col(c).isNull().cast("double")), None, None),
            ("least", c): (F.min(x), low * (10 if low < 0 else 0.1), None), ("most", c): (F.max(x), None, high * 10),
        }
    for c in ("src_flow_usdc", "dest_flow_usdc", "src_tick_delta", "dest_tick_delta"):
        rules[("zero_share", c)] = (F.avg((F.col(c) == 0).cast("double")), None, 0.5)
    rules[("zero_share", "rolling_volatility")] = (F.avg((F.col("rolling_volatility") < 1e-10).cast("double")), None, 0.1)
    rules |= {("stationary", c): (F.abs(F.avg(c)), None, 2.0) for c in ("src_fracdiff", "dest_fracdiff")}
    rules |= {("negatives", c): (F.count_if(F.col(c) < 0), 0, 0) for c in ("tick_count", "bar_time_delta_sec", "src_liquidity_close", "dest_liquidity_close")}
    for c in ("src_tick_delta", "dest_tick_delta"):
        rules |= {("z_mean", c): (F.abs(F.avg(c)), None, 0.1), ("z_std", c): (F.stddev_samp(c), 0.8, 1.2)}
    # on rows where all four are finite, and only if there are over 1,000 of them
    whole = reduce(lambda a, b: a & b, (finite(c) for c in CORRELATED))
    rules |= {("correlation", f"{a}/{b}"): (F.when(F.count_if(whole) > 1000, correlation(F.when(whole, F.col(a)), F.when(whole, F.col(b)))), None, None) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]}
    rules |= {("correlation", "src_dest_fracdiff"): (F.abs(correlation(F.col("src_fracdiff"), F.col("dest_fracdiff"))), None, 0.5), ("labels", "coverage"): (F.count("label") / F.count("*"), 0.1, None), ("rows", "n"): (F.count("*"), 1, None)}
    labels = bars.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return together(
        report(bars, rules), report(duplicate_keys(bars, *keys), {("duplicates", "rows"): (F.max("rows"), 0, 0)}), report(labels, {("labels", "balance"): (F.min("n") / F.max("n"), 0.1, None)}),
        report(largest_gap(bars, "bar_close_timestamp"), {("time", "largest_gap_sec"): (F.max("gap_sec"), None, max_gap_s)}),
        report(low_days(bars, "bar_close_timestamp"), {("time", "quiet_days"): (F.count("*"), 0, 0)}),
        medians(bars, *(c for c in EXPECTED if c != "label")),
    )
