"""Feature tables of labelled bars and the models over them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.functions.numbers import buying_pressure, finite
from tidepool.operators import folds, graph
from tidepool.operators.ranges import RANGES
from tidepool.operators.tables import settled, written

# The columns of the feature table, in order.
FEATURES = (
    "src_fracdiff", "dest_fracdiff", "rolling_volatility", "log_src_flow", "log_dest_flow", "buying_pressure",
    "bar_time_delta_sec", "log_tick_count", "src_tick_delta", "dest_tick_delta", "log_src_liquidity", "log_dest_liquidity",
)


def feature_table(bars: DataFrame, *keep: str) -> DataFrame:
    """M1: keep, trade_date, label_encoded (0 to 2), sample_weight and FEATURES of the bars
    with a finite label, in one projection. Missing values are 0, a tick count 1."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    flow = lambda side: F.log1p(F.abs(zero(f"{side}_flow_usdc"))).alias(f"log_{side}_flow")
    liquidity = lambda side: F.log1p(zero(f"{side}_liquidity_close")).alias(f"log_{side}_liquidity")
    made = {
        "log_src_flow": flow("src"), "log_dest_flow": flow("dest"), "log_src_liquidity": liquidity("src"), "log_dest_liquidity": liquidity("dest"),
        "buying_pressure": buying_pressure(F.col("src_flow_usdc"), F.col("dest_flow_usdc")).alias("buying_pressure"),
        "log_tick_count": F.log1p(F.coalesce(F.col("tick_count"), F.lit(1)).cast("double")).alias("log_tick_count"),
    }
    return bars.where(finite("label")).select(
        *keep, F.to_date("bar_close_timestamp").alias("trade_date"), (F.col("label").cast("int") + 1).alias("label_encoded"), "sample_weight",
        *(made.get(c, zero(c).alias(c)) for c in FEATURES),
    )


#: A fold needs so many train rows.
LEAST_TRAIN = 100


def _moments() -> list[Column]:
    """The sums that a discriminant needs: weights, weighted features, their products."""
    w, x = F.col("w"), [F.col(c) for c in FEATURES]
    return [F.count("*").alias("n"), F.sum(w).alias("w"), F.array(*(F.sum(w * a) for a in x)).alias("first"), F.array(*(F.sum(w * a * b) for i, a in enumerate(x) for b in x[i:])).alias("second")]


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    """One fold: a row a class with its moments becomes the model, softmax(bias + coef x).
    Class weights N / (K n_c) multiply a class's moments."""
    n, k = pdf["n"].sum(), len(FEATURES)
    upper = np.triu_indices(k)
    weights = n / (len(pdf) * pdf["n"].to_numpy())
    mass = weights * pdf["w"].to_numpy()
    means, spread, raw = [], np.zeros((k, k)), np.zeros(k)
    for c, weight in enumerate(weights):
        own, first = pdf["w"].iloc[c], np.asarray(pdf["first"].iloc[c])
        second = np.zeros((k, k))
        second[upper] = pdf["second"].iloc[c]
        second = second + np.triu(second, 1).T
        mean = first / own if own > 0 else first * 0
        means.append(mean)
        spread += weight * (second - own * np.outer(mean, mean))
        raw += weight * np.diag(second)
    # less than the rounding of the products is no variation
    live = np.diag(spread) > 1e-10 * raw
    spread /= max(mass.sum(), 1e-300)
    # on one scale; features that do not vary count nothing
    scale = np.sqrt(np.maximum(np.diag(spread), 0))
    unit = np.where(live, scale, 1.0)
    inner = np.where(np.outer(live, live), spread / np.outer(unit, unit), 0.0) + np.diag(np.where(live, 1e-6, 1.0))
    bias, coef = np.full(3, -1e30), np.zeros((3, k))
    for label, mean, m in zip(pdf["label_encoded"], means, mass):
        if m > 0:
            beta = np.where(live, np.linalg.solve(inner, np.where(live, mean / unit, 0.0)) / unit, 0.0)
            bias[label], coef[label] = math.log(m / mass.sum()) - 0.5 * float(beta @ mean), beta
    return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "train_rows": [int(n)], "bias": [bias], "coef": [coef.ravel()]})


def fold_models(table: DataFrame, train_days: int = 30, least_train: int = LEAST_TRAIN) -> DataFrame:
    """M3 on the folds of M2: (fold, train_rows, bias, coef), a weighted multinomial linear
    model (a discriminant with one covariance) for each trade day, of the `train_days` trade
    days before it. All it needs of the rows are sums by day and class, made in one pass; a
    fold's sums are those of its days, and the folds are solved side by side, so a row is read
    once however many folds it serves. Folds of fewer than least_train rows are left out."""
    known = {c: F.when(finite(c), F.col(c)).otherwise(0.0) for c in FEATURES} | {"w": F.coalesce("sample_weight", F.lit(1.0)).cast("double")}
    by_day = written(table.withColumns(known).groupBy("trade_date", "label_encoded").agg(*_moments()), "moments")
    days = by_day.select("trade_date").distinct().withColumn("day_rank", F.row_number().over(Window.orderBy("trade_date")))  # one row a day
    serves = folds.fold_days(days, train_days).where("trade_date < fold")
    width = len(FEATURES)
    total = lambda c, size: F.array(*(F.sum(F.col(c)[i]) for i in range(size))).alias(c)
    sums = serves.hint("merge").join(by_day.hint("merge"), "trade_date").groupBy("fold", "label_encoded").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), total("first", width), total("second", width * (width + 1) // 2))
    models = sums.groupBy("fold").applyInPandas(_fitted, "fold date, train_rows long, bias array<double>, coef array<double>")
    return written(models.where(F.col("train_rows") >= least_train), "models")


def predicted(table: DataFrame, models: DataFrame) -> DataFrame:
    """table's rows on the days that have a model, with p_down, p_none, p_up and prediction (0 to
    2; ties to the smaller)."""
    x = F.array(*(F.when(finite(c), F.col(c)).otherwise(0.0) for c in FEATURES))
    width = len(FEATURES)
    score = lambda c: F.get("bias", F.lit(c)) + F.aggregate(F.zip_with(F.slice("coef", c * width + 1, width), "_x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = table.withColumn("_x", x).join(models, F.col("trade_date") == F.col("fold")).withColumns({f"_s{c}": score(c) for c in range(3)})
    top = F.greatest("_s0", "_s1", "_s2")
    rows = rows.withColumns({f"_e{c}": F.exp(F.col(f"_s{c}") - top) for c in range(3)}).withColumn("_t", F.col("_e0") + F.col("_e1") + F.col("_e2"))
    return rows.withColumn("prediction", F.when(F.col("_s0") == top, 0).when(F.col("_s1") == top, 1).otherwise(2)).select(*table.columns, "fold", *((F.col(f"_e{c}") / F.col("_t")).alias(n) for c, n in enumerate(("p_down", "p_none", "p_up"))), "prediction")


def fold_scores(table: DataFrame, train_days: int = 30, least_train: int = LEAST_TRAIN) -> DataFrame:
    """Precision, recall, F1 and support of each class on each trade day, by the model
    of the days before it."""
    return folds.confusion(predicted(table, fold_models(table, train_days, least_train)), "label_encoded", "prediction", "fold")


def token_metrics(bars: DataFrame, tokens: DataFrame) -> DataFrame:
    """For each token of tokens (token) what it did as a source: total and mean absolute
    flow, population deviation of flow, mean and deviation of fracdiff, bars, and the shares of
    bars labelled up and down (a missing label is none); 0 for tokens without bars."""
    flow, diff, label = F.col("src_flow_usdc"), F.col("src_fracdiff"), F.coalesce("label", F.lit(0))
    real = lambda c: F.when(~F.isnan(c), c)
    per = bars.groupBy(F.col("src_token_id").alias("token")).agg(
        F.sum(F.abs(real(flow))).alias("total_flow"), F.avg(F.abs(real(flow))).alias("mean_flow"), F.stddev_pop(real(flow)).alias("flow_volatility"), F.avg(real(diff)).alias("mean_fracdiff"),
        F.stddev_pop(real(diff)).alias("fracdiff_volatility"), F.count("*").alias("num_swaps"), F.avg((label == 1).cast("double")).alias("up_ratio"), F.avg((label == -1).cast("double")).alias("down_ratio"),
    )
    names = [c for c in per.columns if c != "token"]  # fixed values: the names of the metrics
    return tokens.select("token").join(per, "token", "left").select("token", *(F.coalesce(c, F.lit(0)).cast("long" if c == "num_swaps" else "double").alias(c) for c in names))


def token_vectors(bars: DataFrame) -> DataFrame:
    """(token, embedding): the mean of a token's features over its labelled bars as a source,
    an embedding that the library makes itself."""
    rows = feature_table(bars, "src_token_id")
    means = rows.groupBy(F.col("src_token_id").alias("token")).agg(*(F.avg(c).alias(c) for c in FEATURES))
    return means.select("token", F.array(*FEATURES).alias("embedding"))


def event_features(bars: DataFrame, ids: DataFrame, *keep: str) -> DataFrame:
    """Keep, token_index (of the source in ids: token, token_index), label (0 to 2, -1 if it
    is missing), weight (1 if missing) and the four features of an event as an array."""
    zero = lambda c: F.coalesce(F.when(finite(c), F.col(c)), F.lit(0.0)).cast("double")
    size, other = F.abs(zero("src_flow_usdc")), F.abs(zero("dest_flow_usdc"))
    values = F.array(zero("src_fracdiff"), zero("rolling_volatility"), F.log1p(size), size / (size + other + 1e-8))
    rows = bars.join(ids.select(F.col("token").alias("src_token_id"), "token_index"), "src_token_id")
    return rows.select(*keep, "token_index", F.when(finite("label"), F.col("label").cast("int") + 1).otherwise(-1).alias("label"), F.when(finite("sample_weight"), F.col("sample_weight")).otherwise(1.0).alias("weight"), values.alias("features"))


#: Node, edge and neighbour features of a bar, for the regression of the next flow.
FLOW_FEATURES = (
    "src_fracdiff", "dest_fracdiff", "rolling_volatility", "liquidity", "src_tick_delta", "log_flow",
    "src_hop1", "src_hop2", "dest_hop1", "dest_hop2",
)

#: What flow_table reads of the bars besides batch, pool and order.
FLOW_INPUT = ("src_token_id", "dest_token_id", "src_flow_usdc", "src_liquidity_close", "src_fracdiff", "dest_fracdiff", "rolling_volatility", "src_tick_delta")


def flow_table(bars: DataFrame, batch: str, pool: str, *order: str) -> DataFrame:
    """Order, FLOW_FEATURES and target, the log flow of the pool's next bar; last bars of
    pools have none and are left out. Liquidity is put to mean 0 and deviation 1 over all rows;
    neighbour features are temporal messages of earlier batches; what is missing is 0. Batches
    are whole numbers and follow each other in the order, as event_batches makes them.

    Bars are shuffled once, by groups of consecutive batches. The messages of a batch and, behind
    the last bar of a pool in a group, its first flow in a later one come as rows beside the bars;
    windows within the group take them from there."""
    if not hasattr(bars, "_written_path"):
        bars = settled(bars.select(*dict.fromkeys((batch, pool, *order, *FLOW_INPUT))), "flow_bars")
    hops = settled(graph.temporal_messages(bars, batch, "src_fracdiff"), "hops")
    scale = bars.agg(F.min(batch).alias("_low"), F.max(batch).alias("_high"), F.avg("src_liquidity_close").alias("_m"), F.stddev_pop("src_liquidity_close").alias("_s")).first()  # one row
    width = max(1, -(-((scale["_high"] or 0) - (scale["_low"] or 0) + 1) // RANGES))
    group = F.floor((F.col(batch) - F.lit(scale["_low"])) / width).cast("long").alias("_group")
    flow = F.log1p(F.abs("src_flow_usdc"))
    liquidity = (F.col("src_liquidity_close") - F.lit(scale["_m"])) / F.lit(scale["_s"]) if (scale["_s"] or 0) > 0 else F.lit(None).cast("double")
    own = [F.col(c) if c in FLOW_INPUT else {"log_flow": flow, "liquidity": liquidity}[c].alias(c) for c in FLOW_FEATURES if "hop" not in c]
    rows = bars.select(group, F.lit(0).alias("_kind"), batch, pool, *order, "src_token_id", "dest_token_id", *own)

    at = F.struct(*order)
    first = bars.groupBy(pool, group).agg(F.min_by(flow, at).alias("log_flow"))
    after = first.withColumn("log_flow", F.lead("log_flow").over(Window.partitionBy(pool).orderBy("_group")))
    after = after.where("log_flow is not null").select("_group", F.lit(1).alias("_kind"), pool, "log_flow")
    token = F.col("node")
    told = hops.where("node is not null").select(group, F.lit(2).alias("_kind"), batch, token.alias("src_token_id"), token.alias("dest_token_id"), "hop1", "hop2")
    rows = rows.unionByName(after, allowMissingColumns=True).unionByName(told, allowMissingColumns=True).repartition("_group")

    ahead = F.lead("log_flow").over(Window.partitionBy("_group", pool, F.col("_kind") == 2).orderBy("_kind", *order))
    rows = rows.withColumn("target", ahead).where("_kind = 2 or _kind = 0 and target is not null")
    for side in ("src", "dest"):
        near = Window.partitionBy("_group", batch, f"{side}_token_id")
        rows = rows.withColumns({f"{side}_{hop}": F.max(hop).over(near) for hop in ("hop1", "hop2")})
    return rows.where("_kind = 0").select(*order, *(F.when(finite(c), F.col(c)).otherwise(0.0).cast("double").alias(c) for c in FLOW_FEATURES), "target")


def flow_regression(bars: DataFrame, batch: str, pool: str, *order: str) -> DataFrame:
    """M9, M8: MSE, MAE and R squared of a Huber regression on flow_table, fitted on the train
    part of a temporal split and scored on its test part."""
    rows = folds.split_in_place(settled(flow_table(bars, batch, pool, *order), "flows"), *order)
    data = VectorAssembler(inputCols=list(FLOW_FEATURES), outputCol="features").transform(rows).select("split", "features", "target")
    model = LinearRegression(labelCol="target", loss="huber", maxIter=30).fit(data.where("split = 'train'"))
    return folds.regression_metrics(model.transform(data.where("split = 'test'")), "target", "prediction")
