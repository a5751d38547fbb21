"""Series of each token: fractional differences, stationarity, volatility, barriers,
weights (T3 to T8, W5 to W7)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.operators.ranges import BLOCK_ROWS, row_blocks
from tidepool.operators.scans import carried, total
from tidepool.operators.tables import written

CUT = 1e-3
D_GRID = tuple(round(0.05 * i, 2) for i in range(21))
LEAST_OBSERVATIONS = 20
WINDOW = 20


def token_series(bars: DataFrame) -> DataFrame:
    """Mean price of each (token, ts) over both roles."""
    side = lambda r: bars.select(F.col(f"{r}_token_id").alias("token"), F.col("bar_close_timestamp").alias("ts"), F.col(f"{r}_price_usdc").alias("price"))
    return side("src").unionByName(side("dest")).groupBy("token", "ts").agg(F.avg("price").alias("price"))


def frac_weights(d: float, cut: float = CUT) -> list[float]:
    """The kernel of order d, up to the first weight below cut."""
    w, k = [1.0], 1
    while abs(nxt := -w[-1] * (d - k + 1) / k) >= cut:
        w.append(nxt)
        k += 1
    return w


def in_blocks(f, df: DataFrame, key: str, order: tuple[str, ...], before: int = 0, after: int = 0, size: int = BLOCK_ROWS) -> DataFrame:  # noqa: ANN001
    """f(df, window, first) with windows over blocks of a key's rows instead of whole keys: for
    keys that hold a large share of all rows. window is unframed; first is the number of
    the row in its key, from 1."""
    rows = row_blocks(df, key, *order, before=before, after=after, size=size)
    out = f(rows, Window.partitionBy(key, "block").orderBy("r"), F.col("r") + 1)
    return out.where("own").drop("own", "block", "r", "n")


def frac_diff(series: DataFrame, d: float, key: str = "token", order: tuple[str, ...] = ("ts",), value: str = "x", out: str = "frac", block: int | None = None) -> DataFrame:
    """Fixed-width fractional difference; null until the kernel is full. block: deal keys
    in blocks of so many rows."""
    w = frac_weights(d)
    if block:
        return in_blocks(lambda df, frame, _: _convolved(df, w, frame, value, out), series, key, order, before=len(w) - 1, size=block)
    return _convolved(series, w, Window.partitionBy(key).orderBy(*order), value, out)


def _convolved(series: DataFrame, w: list[float], frame, value: str, out: str) -> DataFrame:  # noqa: ANN001
    past = F.collect_list(value).over(frame.rowsBetween(-(len(w) - 1), 0))
    kernel = F.array(*(F.lit(x) for x in reversed(w)))
    dot = F.aggregate(F.zip_with("_past", kernel, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return series.withColumn("_past", past).withColumn(out, F.when(F.size("_past") == len(w), dot)).drop("_past")


#: Fixed value: the 5 % point of the unit-root distribution with constant and trend.
TAU_5 = -3.41


def most_lags(n: int) -> int:
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 3))


#: Rows of a lag matrix that are multiplied at once.
STEP = 8192


def lag_rows(y: np.ndarray, first: int, stop: int, lags: int, offset: int, n: int) -> np.ndarray:
    """Rows first .. stop of the regression: target, lagged level, 1, trend, lagged differences.
    Row t is about the step from y[t] to y[t + 1]; offset is the place of y[0] in a series of
    n values."""
    dy, rows = np.diff(y), np.arange(first, stop)
    return np.column_stack([dy[rows], y[rows], np.ones(len(rows)), (rows + offset) / (n - 1) - 0.5, *(dy[rows - i] for i in range(1, lags + 1))])


def tau_of(products: np.ndarray, head: np.ndarray, n: int) -> float:
    """t-ratio of the lagged level in the augmented Dickey-Fuller regression with constant and
    trend. products: of the columns of lag_rows over all rows from the greatest lag on; head:
    the first values of the series, from which the rows before are made. The number of lags
    is chosen by AIC on the common sample, then the rows it spares are added."""
    most = products.shape[0] - 4

    def solved(gram: np.ndarray, lags: int) -> tuple[np.ndarray, float, np.ndarray]:
        x, with_target = gram[1 : 4 + lags, 1 : 4 + lags], gram[1 : 4 + lags, 0]
        beta = np.linalg.lstsq(x, with_target, rcond=None)[0]
        return beta, gram[0, 0] - float(beta @ with_target), x

    def aic(lags: int) -> float:
        rows = products[2, 2]
        return rows * math.log(max(solved(products, lags)[1], 1e-300) / rows) + 2 * (3 + lags)

    best = min(range(most + 1), key=aic)
    early = lag_rows(head, best, most, best, 0, n) if best < most else np.empty((0, 4 + best))
    gram = products[: 4 + best, : 4 + best] + early.T @ early
    beta, ssr, x = solved(gram, best)
    free = gram[2, 2] - x.shape[0]
    if free <= 0 or ssr <= 1e-12 * max(gram[0, 0], 1e-300) or np.linalg.matrix_rank(x, hermitian=True) < x.shape[0]:
        return 0.0
    return float(beta[0] / math.sqrt(np.linalg.inv(x)[0, 0] * ssr / free))


def _block_products(orders: dict[float, list[float]]):  # noqa: ANN202
    """Of a block of a series: for each order the products of its own rows, the least and
    greatest value, and the head of the series if it is here."""

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["token", "d", "n", "gram", "least", "most", "head"]
        if not pdf["own"].any():
            return pd.DataFrame(columns=names)
        pdf = pdf.sort_values("r")
        n, at, own, x = int(pdf["n"].iloc[0]), int(pdf["r"].iloc[0]), pdf["own"].to_numpy(), pdf["x"].to_numpy()
        begin, end = at + int(own.argmax()), at + len(own) - int(own[::-1].argmax())  # own places in the series
        out = []
        for d, w in orders.items():
            values, lost = n - len(w) + 1, len(w) - 1
            if values < LEAST_OBSERVATIONS:
                continue
            lags = most_lags(values)
            # y[0] is at place max(at, 0) of x; its number among the values of this order:
            y, offset = np.convolve(x, w, "valid"), at
            low, high = max(begin - lost, 0), min(end - lost, values)
            first, stop = max(low - 1, lags), high - 1  # regression rows whose target is own
            gram = np.zeros((4 + lags, 4 + lags))
            for step in range(first, stop, STEP):
                z = lag_rows(y, step - offset, min(step + STEP, stop) - offset, lags, offset, values)
                gram += z.T @ z
            mine = y[max(low - offset, 0) : high - offset]
            head = y[: lags + 1] if at == 0 else np.empty(0)
            out.append((pdf["token"].iloc[0], d, values, gram.ravel(), mine.min() if len(mine) else np.inf, mine.max() if len(mine) else -np.inf, head))
        return pd.DataFrame(out, columns=names)

    return products


def _decided(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks sorted by (token, d): products are added up, one matrix at a time is held."""
    key, n, gram, least, most, head = None, 0, None, 0.0, 0.0, None

    def decision() -> tuple:
        good = most > least and tau_of(gram, head, n) < TAU_5
        return (*key, bool(good), n)

    for pdf in frames:
        out = []
        for token, d, values, own, low, high, start in zip(*(pdf[c] for c in ("token", "d", "n", "gram", "least", "most", "head"))):
            if (token, d) != key:
                if key is not None:
                    out.append(decision())
                side = math.isqrt(len(own))
                key, n, gram, least, most, head = (token, d), int(values), np.zeros((side, side)), math.inf, -math.inf, np.empty(0)
            gram += np.asarray(own).reshape(gram.shape)
            least, most, head = min(least, low), max(most, high), np.asarray(start) if len(start) else head
        yield pd.DataFrame(out, columns=["token", "d", "stationary", "n"])
    if key is not None:
        yield pd.DataFrame([decision()], columns=["token", "d", "stationary", "n"])


#: Orders that are tried in one round.
ROUND = 7


def minimum_d(series: DataFrame, grid: tuple[float, ...] = D_GRID, block: int = BLOCK_ROWS) -> DataFrame:
    """(token, d): the least order of the grid whose difference of log prices is
    stationary. The test is a least-squares fit, so all it needs of a series are the products
    of its lagged columns, which are summed over blocks of rows (with margins for kernel and
    lags): no task holds a series. Orders are tried in ascending rounds, tokens that are
    stationary leave. Series are scaled by their token's mean and deviation first, which
    leaves the test as it is."""
    log = F.log(F.greatest("price", F.lit(1e-18)))
    scale = series.groupBy("token").agg(F.avg(log).alias("_m"), F.stddev_pop(log).alias("_s"), F.count("*").alias("_n"))
    longest = max(len(frac_weights(d)) for d in grid)
    # one row a token: Spark knows its size from what is written
    scale = written(scale, "scale")
    lags = most_lags(scale.agg(F.max("_n")).first()[0] or 0)
    scaled = series.join(scale, "token").select("token", "ts", ((log - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).alias("x"))
    rows = written(row_blocks(written(scaled, "scaled"), "token", "ts", before=longest + lags + 1, size=block), "blocks")
    found, left = None, scale.select("token")
    for i in range(0, len(grid), ROUND):
        orders = {d: frac_weights(d) for d in grid[i : i + ROUND]}
        open_ = rows.join(left.hint("merge"), "token", "left_semi") if i else rows
        parts = open_.groupBy("token", "block").applyInPandas(_block_products(orders), "token string, d double, n long, gram array<double>, least double, most double, head array<double>")
        tests = parts.repartition("token", "d").sortWithinPartitions("token", "d").mapInPandas(_decided, "token string, d double, stationary boolean, n long")
        best = written(tests.where("stationary").groupBy("token").agg(F.min("d").alias("d")), "orders")
        found = best if found is None else found.unionByName(best)
        left = written(left.join(best.hint("merge"), "token", "left_anti"), "left")
        if i + ROUND < len(grid) and left.isEmpty():
            break
    return found


def standardised(df: DataFrame, value: str, key: str = "token", out: str = "z", least: float = 1e-12) -> DataFrame:
    """Mean 0, population deviation 1 by key; constant series become 0. The statistics are
    one row a key and joined back, so a key is never in one window."""
    stats = df.groupBy(F.col(key).alias("_key")).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    scaled = F.when(F.col("_s") > least, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.when(F.col(value).isNotNull(), 0.0))
    return df.join(stats, F.col(key).eqNullSafe(F.col("_key"))).withColumn(out, scaled).drop("_key", "_m", "_s")


# Log prices of less deviation are constant, and the order that they report.
CONSTANT_LOG, CONSTANT_D = 1e-6, 0.05


def stationary_series(series: DataFrame, grid: tuple[float, ...] = D_GRID, block: int = BLOCK_ROWS) -> DataFrame:
    """Series (token, ts, price) with d and fracdiff, the standardised fractional
    difference of log prices of the token's least order; null until the kernel is full. A token
    that is stationary at no order is left out; a constant one keeps its log prices,
    standardised or 0, and reports CONSTANT_D."""
    series = written(series, "series")
    log = F.log(F.greatest("price", F.lit(1e-18)))
    flat = series.groupBy("token").agg(F.stddev_pop(log).alias("_s")).where(F.col("_s") < CONSTANT_LOG)
    flat = written(flat.select("token", F.lit(CONSTANT_D).alias("d"), F.lit(True).alias("_flat")), "flat")
    moving = series.join(flat.hint("merge"), "token", "left_anti")
    orders = minimum_d(moving, grid, block).withColumn("_flat", F.lit(False)).unionByName(flat)
    rows = series.join(orders.hint("merge"), "token").withColumn("x", log)
    kernels = {d: frac_weights(d) for d in grid}
    longest = max(map(len, kernels.values()))
    table = F.array(*(F.array(*(F.lit(v) for v in reversed(w))) for w in kernels.values()))
    place = F.array_position(F.array(*(F.lit(d) for d in kernels)), F.col("d")).cast("int") - 1

    def differenced(df: DataFrame, frame, _) -> DataFrame:  # noqa: ANN001
        # a constant series is not differenced
        df = df.withColumn("_k", F.when(F.col("_flat"), F.array(F.lit(1.0))).otherwise(F.get(table, place)))
        df = df.withColumn("_past", F.collect_list("x").over(frame.rowsBetween(-(longest - 1), 0)))
        own = F.slice("_past", -F.size("_k"), F.size("_k"))
        dot = F.aggregate(F.zip_with(own, "_k", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
        return df.withColumn("_f", F.when(F.size("_past") >= F.size("_k"), dot)).drop("_past", "_k")

    out = in_blocks(differenced, written(rows, "rows"), "token", ("ts",), before=longest - 1, size=block)
    return standardised(out, "_f", out="fracdiff", least=1e-8).drop("_f", "x", "_flat")


def log_return(price: Column, w) -> Column:  # noqa: ANN001
    """Log return, 0 for the first row."""
    lp = F.log(F.greatest(price, F.lit(1e-18)))
    return F.coalesce(lp - F.lag(lp).over(w), F.lit(0.0))


def rolling_volatility(df: DataFrame, value: str, key: str, order: tuple[str, ...], width: int = WINDOW, out: str = "vol", block: int | None = None) -> DataFrame:
    """Sample deviation of the last `width` values, null until there are as many.
    block: deal keys in blocks of so many rows."""
    def rolled(rows: DataFrame, w, first) -> DataFrame:  # noqa: ANN001
        return rows.withColumn(out, F.when(first >= width, F.stddev_samp(value).over(w.rowsBetween(-(width - 1), 0))))

    if block:
        return in_blocks(rolled, df, key, order, before=width - 1, size=block)
    w = Window.partitionBy(key).orderBy(*order)
    return rolled(df, w, F.row_number().over(w))


def vertical_barrier(series: DataFrame, fraction: float = 0.5, key: str = "token", ts: str = "ts", most: int = 1000) -> DataFrame:
    """T5: (key, n, horizon): bars to the vertical barrier, a fraction of a day's bars."""
    days = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 86_400e6
    per = series.groupBy(key).agg(F.count("*").alias("n"), days.alias("days"))
    horizon = F.when((F.col("n") < 2) | (F.col("days") <= 0), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("n") / F.col("days") * fraction)))).cast("int")
    return per.select(key, "n", horizon.alias("horizon"))


#: Horizons up to this are resolved in a window; longer ones by a bucketed range join.
ARRAY_HORIZON = 256


def triple_barrier(series: DataFrame, horizon: int | str, up: float = 2.0, low: float = 2.0, key: str = "token", order: tuple[str, ...] = ("ts",), width: int = WINDOW, block: int = BLOCK_ROWS) -> DataFrame:
    """Series (key, order, price) plus r (row number), vol, label and touch: the
    first of the next `horizon` rows at or beyond a barrier of up or low volatilities;
    0 with touch = horizon if none; null without volatility or a full horizon. horizon: rows,
    or a column that has them by key. Keys are dealt in blocks of rows with margins."""
    far = isinstance(horizon, str) or horizon > ARRAY_HORIZON
    h = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    logs = written(series.withColumn("lp", F.log(F.greatest("price", F.lit(1e-18)))), "series")
    rows = row_blocks(logs, key, *order, before=width + 1, after=0 if far else horizon, size=block)
    w = Window.partitionBy(key, "block").orderBy("r")
    df = rows.withColumn("ret", log_return(F.col("price"), w)).withColumn("r", F.col("r") + 1)
    df = df.withColumn("vol", F.when(F.col("r") >= width, F.stddev_samp("ret").over(w.rowsBetween(-(width - 1), 0))))
    high, floor = F.col("lp") + up * F.col("vol"), F.col("lp") - low * F.col("vol")
    valid = (F.col("vol") > 0) & (F.col("r") + h <= F.col("n")) & (F.col("n") >= width + h)
    df = df.withColumn("high", F.when(valid, high)).withColumn("low", F.when(valid, floor))
    if not far:
        ahead = F.collect_list("lp").over(w.rowsBetween(1, horizon))
        # only the place of the first hit is looked for, then its side
        hits = F.filter(F.transform("_ahead", lambda x, i: F.when(x >= F.col("high"), (i + 1)).when(x <= F.col("low"), -(i + 1))), lambda x: x.isNotNull())
        df = df.withColumn("_ahead", ahead).withColumn("_hit", F.when(F.col("high").isNotNull(), F.coalesce(F.get(hits, F.lit(0)), F.lit(0)))).drop("_ahead")
        df = df.where("own").drop("own", "block")
    else:
        df = written(df.where("own").drop("own", "block"), "barriers")
        part = lambda c: F.floor(c / h)
        # a row looks at its own part of the key and the next
        left = df.where("high is not null").select(F.col(key).alias("k"), F.col("r").alias("r0"), "high", "low", h.alias("h"), F.explode(F.array(part(F.col("r")), part(F.col("r")) + 1)).alias("b"))
        right = df.select(F.col(key).alias("k"), F.col("r").alias("r1"), F.col("lp").alias("x"), part(F.col("r")).alias("b"))
        near = left.hint("merge").join(right.hint("merge"), ["k", "b"]).where((F.col("r1") > F.col("r0")) & (F.col("r1") <= F.col("r0") + F.col("h")) & ((F.col("x") >= F.col("high")) | (F.col("x") <= F.col("low"))))
        first = near.groupBy("k", "r0").agg(F.min_by(F.when(F.col("x") >= F.col("high"), F.col("r1") - F.col("r0")).otherwise(F.col("r0") - F.col("r1")), "r1").alias("_first"))
        df = df.hint("merge").join(first.hint("merge"), (df[key] == first.k) & (df.r == first.r0), "left").drop("k", "r0").withColumn("_hit", F.when(F.col("high").isNotNull(), F.coalesce("_first", F.lit(0)))).drop("_first")
    return df.withColumn("label", F.signum(F.col("_hit")).cast("int")).withColumn("touch", F.when(F.col("_hit") == 0, h).otherwise(F.abs("_hit")).cast("long")).drop("_hit", "high", "low", "lp", "ret", "n")


def concurrency_weights(labels: DataFrame, key: str = "token") -> DataFrame:
    """Labels (key, r, touch; touch null: not labelled) plus weight: 1 over the
    number of labels whose span r .. r + touch covers the row, by a sweep over begins and
    ends."""
    spans = labels.where("touch is not null")
    ends = spans.select(key, F.explode(F.array(F.struct(F.col("r").alias("r"), F.lit(1).alias("step")), F.struct((F.col("r") + F.col("touch") + 1).alias("r"), F.lit(-1).alias("step")))).alias("e")).select(key, "e.r", "e.step")
    steps = ends.groupBy(key, "r").agg(F.sum("step").alias("step"))
    joined = labels.hint("merge").join(steps.hint("merge"), [key, "r"], "left")
    # ends behind the last row of a key have no row and open nothing
    run = carried(joined, [key], ["r"], active=total(F.coalesce("step", F.lit(0)))).drop("step")
    return run.withColumn("weight", F.when(F.col("touch").isNotNull(), 1.0 / F.col("active")))


def with_labels(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """Bars with src_label, src_weight, dest_label and dest_weight, from labels (token, ts,
    label, weight) at the close of the bar; null where a token has no label then."""
    out = bars
    for side in ("src", "dest"):
        own = labels.where("label is not null").select(F.col("token").alias(f"{side}_token_id"), F.col("ts").alias("bar_close_timestamp"), F.col("label").alias(f"{side}_label"), F.col("weight").alias(f"{side}_weight"))
        out = out.hint("merge").join(own.hint("merge"), [f"{side}_token_id", "bar_close_timestamp"], "left")
    return out
