"""Walk-forward folds, splits, signals and performance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.functions.numbers import kelly
from tidepool.operators.ranges import numbered, reached, with_range
from tidepool.operators.tables import written

STOP, TAKE = -0.2, 2.0


def trade_days(df: DataFrame, ts: str) -> DataFrame:
    """The distinct days with their rank; one row a day."""
    return df.select(F.to_date(ts).alias("trade_date")).distinct().withColumn("day_rank", F.row_number().over(Window.orderBy("trade_date")))


def fold_days(days: DataFrame, train_days: int) -> DataFrame:
    """(trade_date, fold): the folds that each day serves, its own and those of the next
    `train_days` trade days. days: (trade_date, day_rank), one row a day."""
    last = days.agg(F.max("day_rank").alias("_last"))
    serves = days.crossJoin(F.broadcast(last)).select("trade_date", F.explode(F.sequence("day_rank", F.least(F.col("day_rank") + train_days, F.col("_last")))).alias("fold_rank")).where(F.col("fold_rank") > train_days)
    named = days.select(F.col("day_rank").alias("fold_rank"), F.col("trade_date").alias("fold"))
    return serves.hint("merge").join(named.hint("merge"), "fold_rank").select("trade_date", "fold")


def walk_forward(df: DataFrame, ts: str, train_days: int, open_hour: int = 9, close_hour: int = 17, least_train: int = 0, fall_back: bool = False) -> DataFrame:
    """Df once for each fold it belongs to, with fold (the trade day) and split:
    train (the days before), morning (before open_hour) or trade. Each day explodes into
    the folds it serves and meets its rows by equality; no theta join. Folds of fewer than
    least_train train rows are left out; fall_back: train rows stand for a missing morning."""
    days = trade_days(df, ts)
    rows = df.withColumn("trade_date", F.to_date(ts)).join(fold_days(days, train_days), "trade_date")
    hour = F.hour(ts)
    split = F.when(F.col("trade_date") < F.col("fold"), "train").when(hour < open_hour, "morning").when(hour < close_hour, "trade")
    out = rows.withColumn("split", split).where("split is not null")
    if not least_train and not fall_back:
        return out
    # one row a fold
    sizes = written(out.groupBy("fold").agg(F.count_if(F.col("split") == "train").alias("_train"), F.count_if(F.col("split") == "morning").alias("_morning")), "folds")
    kept = out.join(sizes, "fold").where(F.col("_train") >= least_train)
    if fall_back:
        also = F.when((F.col("split") == "train") & (F.col("_morning") == 0), F.array(F.lit("train"), F.lit("morning"))).otherwise(F.array("split"))
        kept = kept.withColumn("split", F.explode(also))
    return kept.drop("_train", "_morning")


def temporal_split(df: DataFrame, *order: str, train: float = 0.7, val: float = 0.15, by_size: bool = False) -> DataFrame:
    """Split by place in time: train, val, test. The validation part ends at the share
    train + val of the rows; by_size: it has the share val of them, rounded down on its own."""
    n = df.agg(F.count("*").alias("_n"))
    rows = numbered(df, *order).crossJoin(F.broadcast(n))
    part = lambda share: F.floor(F.col("_n") * F.lit(share))
    end = part(train) + part(val) if by_size else part(train + val)
    return rows.withColumn("split", F.when(F.col("row") < part(train), "train").when(F.col("row") < end, "val").otherwise("test")).drop("_n")


def split_in_place(df: DataFrame, *order: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """temporal_split where the split is all that is asked: a row is compared with the first
    rows of val and test instead of being shuffled for its number. Rows of equal order stay
    together, on the later side. df is read several times."""
    counts = {r["_range"]: r["_c"] for r in with_range(df, *order).groupBy("_range").agg(F.count("*").alias("_c")).collect()}  # one row a range
    n = sum(counts.values())
    split = F.lit("train")
    for name, place in (("val", math.floor(n * train)), ("test", math.floor(n * (train + val)))):
        before, at = 0, None
        for at in sorted(counts):
            if place < before + counts[at]:
                break
            before += counts[at]
        own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
        cut = with_range(df, *order).where(F.col("_range") == at).select(*order, "_range").withColumn("_i", own).where(F.col("_i") == place - before).first() if n else None
        if cut is not None:
            split = F.when(reached(dict(df.dtypes), order, cut), name).otherwise(split)
    return df.withColumn("split", split)


def time_blocks(df: DataFrame, blocks: int, *order: str) -> DataFrame:
    """Equal blocks of rows in order, numbered from 0: block."""
    n = df.agg(F.count("*").alias("_n"))
    rows = numbered(df, *order).crossJoin(F.broadcast(n))
    return rows.withColumn("block", F.floor(F.col("row") * blocks / F.col("_n")).cast("int")).drop("_n", "row")


def event_batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Consecutive batches of `size` events."""
    return numbered(df, *order).withColumn("batch_id", F.floor(F.col("row") / size).cast("long"))


def exit_returns(prices: DataFrame, keys: list[str], *order: str, stop: float = STOP, take: float = TAKE) -> DataFrame:
    """For each key the return of holding from the first price: stop or take at the
    first later price at or beyond them, else last / first - 1; 0 with under two prices or
    no positive entry. Two aggregations, no window: a key of any size is summed up in parts."""
    at = F.struct(*order)
    entries = prices.groupBy(*keys).agg(F.min_by("price", at).alias("_entry"), F.min(at).alias("_at"))
    rows = prices.join(entries, keys)
    hit = F.when(at > F.col("_at"), F.when(F.col("price") <= (1 + stop) * F.col("_entry"), stop).when(F.col("price") >= (1 + take) * F.col("_entry"), take))
    per = rows.withColumn("_hit", hit).groupBy(*keys).agg(
        F.min_by("_hit", F.when(F.col("_hit").isNotNull(), at)).alias("_out"), F.max_by("price", at).alias("_last"), F.first("_entry").alias("_entry"), F.count("*").alias("_c")
    )
    value = F.when((F.col("_c") < 2) | (F.col("_entry") <= 0), 0.0).otherwise(F.coalesce("_out", F.col("_last") / F.col("_entry") - 1))
    return per.select(*keys, value.alias("ret"))


def top_signals(predictions: DataFrame, n: int = 5, sizing: str = "capped") -> DataFrame:
    """Mean edge of each token and day; positive ones, the n best a day, with
    a position size."""
    per = predictions.groupBy("trade_date", "token").agg(F.avg(F.col("p_up") - F.col("p_down")).alias("signal"), F.avg("p_up").alias("up"), F.avg("p_down").alias("down")).where("signal > 0")
    size = F.least(F.abs("signal"), F.lit(0.5)) if sizing == "capped" else kelly(F.col("up"), F.col("down"))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("signal"), "token"))).where(F.col("rank") <= n)
    return ranked.withColumn("size", size).where("size is not null").drop("up", "down")


def portfolio(trades: DataFrame) -> DataFrame:
    """M6: the day's return on all capital, and on what was invested."""
    return trades.groupBy("trade_date").agg(F.sum(F.col("ret") * F.col("size")).alias("on_capital"), (F.sum(F.col("ret") * F.col("size")) / F.sum("size")).alias("on_invested"))


def performance(daily: DataFrame, day: str = "trade_date", value: str = "ret") -> DataFrame:
    """One row of performance figures over days. There is one row a day, so a
    window over all days is small."""
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("_e", F.exp(F.sum(F.log1p(value)).over(w)))
    curve = curve.withColumn("_d", F.col("_e") / F.greatest(F.max("_e").over(w), F.lit(1.0)) - 1)
    std = F.stddev_pop(value)
    return curve.agg(
        F.count("*").alias("days"), F.sum(value).alias("total"), (F.max_by("_e", day) - 1).alias("cumulative"), F.avg(value).alias("mean"), std.alias("std"),
        F.when(std > 0, F.avg(value) / std * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"),
        F.count_if(F.col(value) < 0).alias("losing"), F.count_if(F.col(value) == 0).alias("break_even"), F.min("_d").alias("max_drawdown"),
        F.max_by(F.col(day), F.struct(F.col(value), F.col(day))).alias("best_day"), F.min_by(F.col(day), F.struct(F.col(value), F.col(day))).alias("worst_day"),
    )


def class_weights(df: DataFrame, label: str, classes: list[int] | None = None, floored: bool = False) -> DataFrame:
    """Inverse frequency weights N / (K n_c). classes: all K classes that there are; one
    without rows has weight 1, or, floored, that of one row."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    if classes is not None:
        kind = dict(df.dtypes)[label]
        listed = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label} {kind}")
        counts = F.broadcast(listed).join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))
    all_ = counts.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    weight = F.col("_n") / (F.col("_k") * F.greatest(F.col("n"), F.lit(1)))
    return counts.crossJoin(F.broadcast(all_)).select(label, "n", (weight if floored else F.when(F.col("n") == 0, 1.0).otherwise(weight)).alias("weight"))


def confusion(df: DataFrame, label: str, prediction: str, *keys: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, by key if there are any."""
    cells = df.groupBy(*keys, F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(*keys, F.explode(F.array(F.struct(F.col("l").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("e")).select(*keys, "e.*")
    per = sides.groupBy(*keys, "c").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    per = per.withColumn("precision", ratio("hit", "predicted")).withColumn("recall", ratio("hit", "support"))
    return per.select(*keys, F.col("c").alias("label"), "support", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """M8: MSE, MAE and R squared in one pass."""
    e = F.col(label) - F.col(prediction)
    return df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(label) * F.count(label))).alias("r2"))
