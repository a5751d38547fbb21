"""Further registered queries: single predicates, joins, windows, sorts, sets and model
tables."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.functions import decode, numbers
from tidepool.operators import bars, chain, embeddings, features, folds, graph, pricing, quality, series
from tidepool.plans.catalog import BAR_SQL, BARRIER, _bars, _pool_series, duplicates_sql, gap_sql, median_sql, nulls_sql, query, r6, report_sql, rounded, spread_sql
from tidepool.operators.tables import dropped, settled, stored, written
from tidepool.sources.readers import of_chains, read_embeddings, watch_list

# ---- sources ----


@query("SELECT event_id, ts, value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def s1_scan(t):  # noqa: ANN001, ANN201
    day = F.lit("2024-01-15").cast("timestamp")
    return t("events").where((F.col("ts") >= day) & (F.col("ts") < day + F.expr("INTERVAL 1 DAY"))).select("event_id", "ts", "value")


@query("""SELECT event_type AS chain, CAST(ts AS DATE) AS trade_date, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING avg(value) > (SELECT avg(value) FROM events)) GROUP BY 1, 2""", dates="trade_date")
def s4_chain_route(t):  # noqa: ANN001, ANN201
    """Logs stored by chain and date; which chains are read is decided at run time."""
    e = t("events").select(F.col("event_type").alias("chain"), F.to_date("ts").alias("trade_date"), "value")
    logs = stored(e, "logs", "chain", "trade_date")
    means = e.groupBy("chain").agg(F.avg("value").alias("mean")).join(F.broadcast(e.agg(F.avg("value").alias("all"))))
    busy = written(means, "chains").where("mean > all").select("chain")
    return of_chains(logs, busy).groupBy("chain", "trade_date").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type AS token_address, date_trunc('hour', ts) AS timestamp, round(avg(value), 6) AS price_usd FROM events GROUP BY 1, 2")
def s12_reference_prices(t):  # noqa: ANN001, ANN201
    e = t("events")
    return rounded(e.groupBy(F.col("event_type").alias("token_address"), F.date_trunc("hour", "ts").alias("timestamp")).agg(F.avg("value").alias("price_usd")))


@query("SELECT 'a' || s_suppkey AS address, 'S' || s_nationkey AS symbol, 'id' || s_suppkey AS coingecko_id, s_acctbal AS volatility, s_suppkey AS liquidity FROM supplier WHERE s_suppkey % 3 <> 0")
def s13_watch_list(t):  # noqa: ANN001, ANN201
    entry = F.struct(
        F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("symbol"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("id"), F.col("s_suppkey").cast("string"))).alias("coingecko_id"),
        F.col("s_acctbal").alias("volatility"), F.col("s_suppkey").alias("liquidity"),
    )
    text = F.to_json(F.create_map(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")), entry))
    return watch_list(t("supplier").select(text.alias("j")), "j")


@query("""SELECT trade_date, count(*) AS n, count(DISTINCT label) AS labels FROM (SELECT *, DATE '2024-01-01' + CAST(vec_id % 4 AS INTEGER) AS trade_date FROM embeddings) WHERE trade_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-03' GROUP BY 1""", dates="trade_date")
def s14_dated_files(t):  # noqa: ANN001, ANN201
    """Embeddings stored by date, and the report of a range of dates, which reads only these."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 4).cast("int"))
    dated = t("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label", day.alias("trade_date"))
    path = stored(dated, "embeddings", "trade_date")._stored_path
    found = read_embeddings(dated.sparkSession, path, "2024-01-02", "2024-01-03")
    return found.groupBy("trade_date").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


# ---- predicates and projections ----


@query("SELECT event_id, lower(substr('0x' || repeat('AB', 32), 27, 40)) AS sender, lower(pool) AS pool FROM fx_swaps WHERE token0 = 'tok1'", "fx_swaps")
def p3_topic_addresses(t):  # noqa: ANN001, ANN201
    topics = F.array("token0", F.concat(F.lit("0x"), F.repeat(F.lit("AB"), 32)))
    s = t("fx_swaps").withColumn("topics", topics).where(F.get("topics", F.lit(0)) == "tok1")
    return s.select("event_id", decode.address_of_topic(F.col("topics"), 1).alias("sender"), F.lower("pool").alias("pool"))


@query("SELECT l_orderkey, l_partkey, CASE WHEN tick_count < 3 THEN -1 WHEN tick_count < 6 THEN 0 ELSE 1 END + 1 AS label FROM fx_bars WHERE tick_count <> 4 OR l_tax > 0.05", "fx_bars")
def p8_valid_labels(t):  # noqa: ANN001, ANN201
    b = t("fx_bars").withColumn("label", F.when(F.col("tick_count") < 3, -1).when(F.col("tick_count") < 6, 0).otherwise(1)).where((F.col("tick_count") != 4) | (F.col("l_tax") > 0.05))
    return b.select("l_orderkey", "l_partkey", (F.col("label").cast("int") + 1).alias("label"))


@query("SELECT l_orderkey, l_partkey, greatest(src_price_usdc, dest_price_usdc) AS most, least(src_price_usdc, dest_price_usdc) AS least, least(CAST(tick_count * 200000 AS DOUBLE), 604800.0) AS capped FROM fx_bars", "fx_bars")
def p12_horizontal(t):  # noqa: ANN001, ANN201
    b = t("fx_bars")
    return b.select("l_orderkey", "l_partkey", F.greatest("src_price_usdc", "dest_price_usdc").alias("most"), F.least("src_price_usdc", "dest_price_usdc").alias("least"), F.least((F.col("tick_count") * 200000).cast("double"), F.lit(604800.0)).alias("capped"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END, -1) AS filled FROM events")
def p14_nan_to_null(t):  # noqa: ANN001, ANN201
    v = numbers.nan_to_null(F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value")))
    return t("events").select("event_id", v.alias("value"), F.coalesce(v, F.lit(-1.0)).alias("filled"))


@query()
def p17_sample(t):  # noqa: ANN001, ANN201
    return t("events").orderBy(F.xxhash64("event_id", F.lit(42)), "event_id").limit(1000)


@query("SELECT vec_id, label FROM embeddings WHERE label >= 3")
def p19_labelled(t):  # noqa: ANN001, ANN201
    return t("embeddings").where("label >= 3").select("vec_id", "label")


@query("SELECT event_id, CASE WHEN amount0 > 0 THEN usdc ELSE -usdc END AS signed FROM (SELECT event_id, amount0, cents / 100.0::DOUBLE AS usdc FROM fx_swaps)", "fx_swaps")
def f7_signed_volume(t):  # noqa: ANN001, ANN201
    s = t("fx_swaps").select("event_id", (decode.sign_of(F.col("amount0")) * (F.col("cents") / 100.0)).alias("signed"), "cents")
    # zero amounts have sign -1
    return s.select("event_id", F.when(F.col("cents") == 0, -0.0).otherwise(F.col("signed")).alias("signed"))


@query("""SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dist
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def f18_vector_functions(t):  # noqa: ANN001, ANN201
    e = embeddings.doubles(t("embeddings"))
    both = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    x, y = F.col("x"), F.col("y")
    return rounded(both.select("vec_id", numbers.dot(x, y).alias("dot"), numbers.cosine(x, y).alias("cos"), numbers.distance(x, y).alias("dist")))


# ---- joins and sets ----


@query("""WITH s AS (SELECT pool AS tok, avg(price_in_usdc) AS m FROM fx_prices GROUP BY 1) SELECT event_id, round(price_in_usdc / m, 6) AS relative FROM fx_prices JOIN s ON pool = tok""", "fx_prices")
def j3_aggregate_back(t):  # noqa: ANN001, ANN201
    p = t("fx_prices")
    return rounded(p.join(p.groupBy("pool").agg(F.avg("price_in_usdc").alias("m")), "pool").select("event_id", (F.col("price_in_usdc") / F.col("m")).alias("relative")))


@query("""SELECT src_token_id, round(count(*) FILTER (WHERE tick_count > 4) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM fx_bars GROUP BY 1""", "fx_bars")
def j4_ratio_in_one_pass(t):  # noqa: ANN001, ANN201
    return rounded(t("fx_bars").groupBy("src_token_id").agg((F.count_if(F.col("tick_count") > 4) / F.count("*")).alias("ratio")))


@query("""WITH s AS (SELECT tok, ts, avg(price) AS price FROM (SELECT src_token_id AS tok, bar_close_timestamp AS ts, src_price_usdc AS price FROM fx_bars UNION ALL SELECT dest_token_id, bar_close_timestamp, dest_price_usdc FROM fx_bars) GROUP BY 1, 2)
SELECT l_orderkey, l_partkey, pool_id, tick_count, round(a.price, 6) AS src_x, round(b.price, 6) AS dest_x FROM fx_bars LEFT JOIN s a ON a.tok = src_token_id AND a.ts = bar_close_timestamp LEFT JOIN s b ON b.tok = dest_token_id AND b.ts = bar_close_timestamp""", "fx_bars")
def j5_double_lookup(t):  # noqa: ANN001, ANN201
    b = t("fx_bars")
    s = series.token_series(b)
    side = lambda r: s.select(F.col("token").alias(f"{r}_token_id"), F.col("ts").alias("bar_close_timestamp"), F.col("price").alias(f"{r}_x"))
    out = b.join(side("src"), ["src_token_id", "bar_close_timestamp"], "left").join(side("dest"), ["dest_token_id", "bar_close_timestamp"], "left")
    return rounded(out.select("l_orderkey", "l_partkey", "pool_id", "tick_count", "src_x", "dest_x"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def j8_semi(t):  # noqa: ANN001, ANN201
    return t("supplier").join(t("nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_semi").select("s_suppkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def j9_anti(t):  # noqa: ANN001, ANN201
    return t("supplier").join(t("nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_anti").select("s_suppkey")


@query("SELECT s_suppkey, coalesce(CASE WHEN n_regionkey < 2 THEN n_name END, substr(s_name, 1, 10)) AS shown FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j14_display_name(t):  # noqa: ANN001, ANN201
    n = t("nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return t("supplier").join(n, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.substring("s_name", 1, 10)).alias("shown"))


@query("""WITH n AS (SELECT DISTINCT tick_count AS batch, src_token_id AS node FROM fx_bars WHERE l_tax > 0.04), k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY node) - 1 AS local FROM n)
SELECT b.tick_count AS batch, x.local AS src, y.local AS dst, count(*) AS n FROM fx_bars b JOIN k x ON x.batch = b.tick_count AND x.node = src_token_id JOIN k y ON y.batch = b.tick_count AND y.node = dest_token_id GROUP BY 1, 2, 3""", "fx_bars")
def j16_local_edges(t):  # noqa: ANN001, ANN201
    b = t("fx_bars").withColumnRenamed("tick_count", "batch")
    nodes = b.where("l_tax > 0.04").select("batch", F.col("src_token_id").alias("node")).distinct()
    local = nodes.withColumn("local", (F.row_number().over(Window.partitionBy("batch").orderBy("node")) - 1).cast("long"))
    end = lambda side, out: local.select("batch", F.col("node").alias(side), F.col("local").alias(out))
    return b.join(end("src_token_id", "src"), ["batch", "src_token_id"]).join(end("dest_token_id", "dst"), ["batch", "dest_token_id"]).groupBy("batch", "src", "dst").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT src_token_id AS tok, count(*) AS n FROM fx_bars WHERE l_tax > 0.07 GROUP BY 1), b AS (SELECT dest_token_id AS tok, count(*) AS n FROM fx_bars WHERE l_tax < 0.01 GROUP BY 1)
SELECT coalesce(a.tok, b.tok) AS token, coalesce(a.n, 0) AS as_src, coalesce(b.n, 0) AS as_dest FROM a FULL JOIN b ON a.tok = b.tok""", "fx_bars")
def j17_full_merge(t):  # noqa: ANN001, ANN201
    b = t("fx_bars")
    a = b.where("l_tax > 0.07").groupBy(F.col("src_token_id").alias("token")).agg(F.count("*").alias("as_src"))
    d = b.where("l_tax < 0.01").groupBy(F.col("dest_token_id").alias("token")).agg(F.count("*").alias("as_dest"))
    return a.join(d, "token", "full_outer").select("token", F.coalesce("as_src", F.lit(0)).alias("as_src"), F.coalesce("as_dest", F.lit(0)).alias("as_dest"))


@query("SELECT s_nationkey AS id, 'supplier' AS side FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer")
def u1_union_all(t):  # noqa: ANN001, ANN201
    return t("supplier").select(F.col("s_nationkey").alias("id"), F.lit("supplier").alias("side")).unionByName(t("customer").select(F.col("c_nationkey").alias("id"), F.lit("customer").alias("side")))


@query("SELECT count(DISTINCT event_type) AS types, count(DISTINCT user_id) AS users, count(DISTINCT (user_id, event_type)) AS pairs FROM events")
def a10_distinct_counts(t):  # noqa: ANN001, ANN201
    return t("events").agg(F.countDistinct("event_type").alias("types"), F.countDistinct("user_id").alias("users"), F.countDistinct("user_id", "event_type").alias("pairs"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def a17_last_seen(t):  # noqa: ANN001, ANN201
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e")
    return t("events").groupBy("user_id").agg(last).select("user_id", "e.event_id", "e.value")


# ---- windows, sorts ----


@query("SELECT count(*) AS n, count(*) FILTER (WHERE ts < p) AS disorder FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)")
def w3_is_sorted(t):  # noqa: ANN001, ANN201
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t("events").select("ts", F.lag("ts").over(w).alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.col("p")).alias("disorder"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value - 49) / 100 AS ret FROM events GROUP BY 1), e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY day)) AS equity FROM d) SELECT day, round(equity, 6) AS equity, round(equity / max(equity) OVER (ORDER BY day) - 1, 6) AS drawdown FROM e""", dates="day")
def w9_equity_curve(t):  # noqa: ANN001, ANN201
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = t("events").groupBy(F.to_date("ts").alias("day")).agg((F.avg(F.col("value") - 49) / 100).alias("ret"))
    e = d.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(w)))
    return rounded(e.select("day", "equity", (F.col("equity") / F.max("equity").over(w) - 1).alias("drawdown")))


@query("SELECT event_id, round(coalesce(epoch_us(block_timestamp) - epoch_us(lag(block_timestamp) OVER (PARTITION BY pool ORDER BY block_timestamp, event_id)), 0) / 1000000.0::DOUBLE, 6) AS delta FROM fx_prices", "fx_prices")
def w12_time_delta(t):  # noqa: ANN001, ANN201
    at = numbers.seconds(F.col("block_timestamp"))
    micros = F.unix_micros("block_timestamp")
    before = F.lag(micros).over(Window.partitionBy("pool").orderBy("block_timestamp", "event_id"))
    return t("fx_prices").where(at.isNotNull()).select("event_id", r6(F.coalesce((micros - before) / 1e6, F.lit(0.0))).alias("delta"))


@query("SELECT pool, CAST(block_timestamp AS DATE) AS day, arg_min(price_in_usdc, (block_timestamp, event_id)) AS open, arg_max(price_in_usdc, (block_timestamp, event_id)) AS close, max(price_in_usdc) AS high, min(price_in_usdc) AS low FROM fx_prices GROUP BY 1, 2", "fx_prices", dates="day")
def w14_open_close(t):  # noqa: ANN001, ANN201
    at = F.struct("block_timestamp", "event_id")
    return t("fx_prices").groupBy("pool", F.to_date("block_timestamp").alias("day")).agg(F.min_by("price_in_usdc", at).alias("open"), F.max_by("price_in_usdc", at).alias("close"), F.max("price_in_usdc").alias("high"), F.min("price_in_usdc").alias("low"))


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def k1_global_sort(t):  # noqa: ANN001, ANN201
    return t("supplier").select("s_nationkey", "s_suppkey", "s_acctbal").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def k3_top_n(t):  # noqa: ANN001, ANN201
    return t("events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


# ---- bars, graph, model tables ----


_ALL_BARS, _BAR_ROWS = BAR_SQL.rsplit("\nSELECT pool, ", 1)
_LATE = "avg(CASE WHEN bar_time_delta_sec > 86400 THEN 1.0 ELSE 0 END) > 0.2"


@query(f"""{_ALL_BARS}, z AS (SELECT pool, {_BAR_ROWS}), bad AS (SELECT src_token_id AS tok FROM z GROUP BY 1 HAVING {_LATE} UNION SELECT dest_token_id FROM z GROUP BY 1 HAVING {_LATE})
SELECT * FROM z WHERE src_token_id NOT IN (SELECT tok FROM bad) AND dest_token_id NOT IN (SELECT tok FROM bad)""", "fx_prices")
def t9_bars_filtered(t):  # noqa: ANN001, ANN201
    return rounded(bars.filter_illiquid(_bars(t)))


@query("""WITH i AS (SELECT src_token_id, row_number() OVER (ORDER BY src_token_id) - 1 AS token_index FROM (SELECT DISTINCT src_token_id FROM fx_labelled))
SELECT l_orderkey, l_linenumber, token_index, CASE WHEN label IS NULL THEN -1 ELSE CAST(label AS INTEGER) + 1 END AS label, round(coalesce(sample_weight, 1.0), 6) AS weight, round(coalesce(src_fracdiff, 0), 6) AS f0, round(rolling_volatility, 6) AS f1,
round(ln(1 + abs(src_flow_usdc)), 6) AS f2, round(abs(src_flow_usdc) / (abs(src_flow_usdc) + abs(dest_flow_usdc) + 1e-8), 6) AS f3 FROM fx_labelled JOIN i USING (src_token_id)""", "fx_labelled")
def g9_event_features(t):  # noqa: ANN001, ANN201
    b = t("fx_labelled")
    ids = graph.encoded(b.select(F.col("src_token_id").alias("token")).distinct(), "token", "token_index")
    f = features.event_features(b, ids, "l_orderkey", "l_linenumber")
    return rounded(f.select("l_orderkey", "l_linenumber", "token_index", "label", "weight", *(F.col("features")[i].alias(f"f{i}") for i in range(4))))


@query("""SELECT l_orderkey, l_partkey, CAST(bar_close_timestamp AS DATE) AS trade_date, CAST(label AS INT) + 1 AS label_encoded, round(sample_weight, 6) AS sample_weight, round(coalesce(src_fracdiff, 0), 6) AS src_fracdiff, round(coalesce(dest_fracdiff, 0), 6) AS dest_fracdiff,
round(rolling_volatility, 6) AS rolling_volatility, round(ln(1 + abs(src_flow_usdc)), 6) AS log_src_flow, round(ln(1 + abs(dest_flow_usdc)), 6) AS log_dest_flow, round(abs(src_flow_usdc) / (abs(src_flow_usdc) + abs(dest_flow_usdc) + 1e-8), 6) AS buying_pressure,
round(bar_time_delta_sec, 6) AS bar_time_delta_sec, round(ln(1 + tick_count), 6) AS log_tick_count, round(coalesce(src_tick_delta, 0), 6) AS src_tick_delta, round(coalesce(dest_tick_delta, 0), 6) AS dest_tick_delta,
round(ln(1 + coalesce(src_liquidity_close, 0)), 6) AS log_src_liquidity, round(ln(1 + coalesce(dest_liquidity_close, 0)), 6) AS log_dest_liquidity FROM fx_labelled WHERE label IS NOT NULL""", "fx_labelled", dates="trade_date")
def m1_feature_table(t):  # noqa: ANN001, ANN201
    return rounded(features.feature_table(t("fx_labelled"), "l_orderkey", "l_partkey"))


@query(dates="fold")
def m3_weighted_classifier(t):  # noqa: ANN001, ANN201
    """A model for each trade day of the library's own labelled bars."""
    return rounded(features.fold_scores(features.feature_table(_chain(t)), 5))


_BATCHED = "b AS (SELECT *, CAST((row_number() OVER (ORDER BY bar_close_timestamp, l_orderkey, l_partkey, l_linenumber) - 1) // 5000 AS BIGINT) AS batch FROM fx_labelled)"
_HOP = "{to} AS (SELECT e.batch, e.dst AS node, sum(e.w * f.x) / sum(e.w) AS x FROM e JOIN {of} f ON f.batch = e.batch AND f.node = e.src GROUP BY 1, 2)"
_LATER = "{to} AS (SELECT k AS batch, node, sum(x * pow(0.7, k - batch - 1)) AS x FROM (SELECT *, unnest(range(batch + 1, batch + 17)) AS k FROM {of}) GROUP BY 1, 2)"


def _batched(t, *columns: str) -> DataFrame:  # noqa: ANN001
    """row, batch and columns of the labelled bars; only these are shuffled for the numbers."""
    order = ("bar_close_timestamp", "l_orderkey", "l_partkey", "l_linenumber")
    rows = settled(t("fx_labelled").select(*order, *columns), "rows")
    out = settled(folds.event_batches(rows, 5000, *order).select("row", F.col("batch_id").alias("batch"), *columns), "batched")
    dropped(rows)
    return out


@query(f"""WITH {_BATCHED}, e AS (SELECT batch, src, dst, sum(w) AS w FROM (SELECT batch, src_token_id AS src, dest_token_id AS dst, abs(src_flow_usdc) AS w FROM b UNION ALL SELECT batch, dest_token_id, src_token_id, abs(src_flow_usdc) FROM b) WHERE w > 0 GROUP BY 1, 2, 3),
f0 AS (SELECT batch, src_token_id AS node, avg(coalesce(src_fracdiff, 0)) AS x FROM b GROUP BY 1, 2), {_HOP.format(to='f1', of='f0')}, {_HOP.format(to='f2', of='f1')}, {_LATER.format(to='g1', of='f1')}, {_LATER.format(to='g2', of='f2')}
SELECT batch, node, round(g1.x, 6) + 0 AS hop1, round(g2.x, 6) + 0 AS hop2 FROM g1 FULL JOIN g2 USING (batch, node)""", "fx_labelled")
def g10_temporal_messages(t):  # noqa: ANN001, ANN201
    m = graph.temporal_messages(_batched(t, "src_token_id", "dest_token_id", "src_flow_usdc", "src_fracdiff"), "batch", "src_fracdiff")
    return m.select("batch", "node", *((r6(c) + 0).alias(c) for c in ("hop1", "hop2")))


@query()
def m9_huber_regression(t):  # noqa: ANN001, ANN201
    """Next-bar log flow of a pool with the Huber loss, on node, edge and neighbour features;
    fitted on the first 70 % in time and scored on the last 15 %."""
    return rounded(features.flow_regression(_batched(t, "pool_id", *features.FLOW_INPUT), "batch", "pool_id", "row"))


def _token_space(t) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """The library's own token vectors, and what the tokens did."""
    b = t("fx_labelled")
    vectors = written(features.token_vectors(b), "vectors")
    return vectors, features.token_metrics(b, vectors.select("token"))


@query()
def m14_component_correlations(t):  # noqa: ANN001, ANN201
    """The token metric that each principal component of the token vectors follows most."""
    vectors, metrics = _token_space(t)
    return rounded(embeddings.component_correlations(vectors, metrics, 3, "token"))


@query()
def m15_linear_probe(t):  # noqa: ANN001, ANN201
    """Accuracy of a linear probe on a stratified, hash-ranked fifth of the vectors."""
    e = embeddings.scaled(embeddings.doubles(t("embeddings")))
    part = F.percent_rank().over(Window.partitionBy("label").orderBy(F.xxhash64("vec_id", F.lit(42))))
    split = e.select("vec_id", "label", array_to_vector(vector_to_array("z")).alias("features"), (part >= 0.8).alias("test"))
    model = LogisticRegression(maxIter=30, family="multinomial").fit(split.where("not test"))
    return rounded(model.transform(split.where("test")).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")))


@query()
def m22_quality_score(t):  # noqa: ANN001, ANN201
    vectors, metrics = _token_space(t)
    return rounded(embeddings.quality_score(vectors, metrics, "token"))


# ---- quality ----


def _labelled(t) -> DataFrame:  # noqa: ANN001
    return series.triple_barrier(_pool_series(t), 30, 0.5, 0.5, order=("ts", "event_id"))


# ---- the chain: bars, differences, barriers, weights, labels of one table ----

_TICKED = (
    BAR_SQL.replace("flow_sign * usdc_volume AS flow,", "flow_sign * usdc_volume AS flow, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 201 - 100 AS DOUBLE) END AS tick, CASE WHEN event_id % 5 = 0 THEN usdc_volume * 1000 END AS liq,")
    .replace("count(*) AS tick_count,", "count(*) AS tick_count, arg_max(tick, (ts, tie)) FILTER (WHERE tick IS NOT NULL) - arg_min(tick, (ts, tie)) FILTER (WHERE tick IS NOT NULL) AS tick_delta, arg_max(liq, (ts, tie)) FILTER (WHERE liq IS NOT NULL) AS liq,")
    .replace("d AS (SELECT *,", "d AS (SELECT *, last_value(liq IGNORE NULLS) OVER (PARTITION BY pool ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS liquidity,")
    .replace("tick_count, CAST(volume_micro", "tick_count, round(ln(1 + liquidity), 6) AS src_liquidity_close, round(ln(1 + liquidity), 6) AS dest_liquidity_close, tick_delta AS src_tick_delta, tick_delta AS dest_tick_delta, CAST(volume_micro")
)
_TICKED_BARS, _TICKED_ROWS = _TICKED.rsplit("\nSELECT pool, ", 1)
_ON_BARS = (
    BARRIER.replace("WITH a AS", "a AS").replace("SELECT pool AS tok, event_id,", "SELECT tok, ts,").replace("price_in_usdc", "price").replace("PARTITION BY pool", "PARTITION BY tok").replace("ORDER BY block_timestamp, event_id", "ORDER BY ts")
    .replace("v.event_id", "v.ts, v.vol").replace("{N}", "20").replace("FROM fx_prices", "FROM s")
)
_KERNEL_ROWS = ", ".join(f"({k}, {w!r})" for k, w in enumerate(series.frac_weights(0.4)))
_CHAIN = f"""{_TICKED_BARS}, z AS (SELECT pool, {_TICKED_ROWS}), s AS (SELECT tok, ts, avg(price) AS price FROM (SELECT src_token_id AS tok, bar_close_timestamp AS ts, src_price_usdc AS price FROM z UNION ALL SELECT dest_token_id, bar_close_timestamp, dest_price_usdc FROM z) GROUP BY 1, 2),
{_ON_BARS},
wt AS (SELECT x.tok, x.ts, 1.0 / count(y.r) AS weight FROM l x JOIN l y ON x.tok = y.tok AND y.r <= x.r AND y.r >= x.r - 20 AND y.r + y.touch >= x.r WHERE x.touch IS NOT NULL AND y.touch IS NOT NULL GROUP BY 1, 2),
kw(k, w) AS (VALUES {_KERNEL_ROWS}),
fr AS (SELECT x.tok, x.ts, CASE WHEN count(y.lp) = (SELECT count(*) FROM kw) THEN sum(kw.w * y.lp) END AS f FROM a x CROSS JOIN kw LEFT JOIN a y ON x.tok = y.tok AND y.r = x.r - kw.k GROUP BY 1, 2),
st AS (SELECT tok, ts, (f - avg(f) OVER (PARTITION BY tok)) / stddev_pop(f) OVER (PARTITION BY tok) AS fracdiff FROM fr),
kn AS (SELECT l.tok, l.ts, l.vol, CAST(l.label AS INTEGER) AS label, l.touch, wt.weight, st.fracdiff FROM l LEFT JOIN wt USING (tok, ts) LEFT JOIN st USING (tok, ts)),
fx_chain AS (SELECT z.*, z.pool AS pool_id, x.fracdiff AS src_fracdiff, x.vol AS rolling_volatility, x.label, x.weight AS sample_weight, CAST(x.touch AS BIGINT) AS barrier_touch_bars, y.fracdiff AS dest_fracdiff, y.label AS dest_label, y.weight AS dest_sample_weight, CAST(y.touch AS BIGINT) AS dest_barrier_touch_bars
FROM z LEFT JOIN kn x ON x.tok = z.src_token_id AND x.ts = z.bar_close_timestamp LEFT JOIN kn y ON y.tok = z.dest_token_id AND y.ts = z.bar_close_timestamp)"""


def _ticked_bars(t) -> DataFrame:  # noqa: ANN001
    e = F.col("event_id")
    prices = t("fx_prices").withColumns({"tick": F.when(e % 3 > 0, (e % 201 - 100).cast("double")), "liquidity": F.when(e % 5 == 0, F.col("usdc_volume") * 1000)})
    pools = prices.select("pool").distinct().select("pool", F.lit("click").alias("token_a"), F.lit("purchase").alias("token_b"))
    return rounded(bars.dollar_bars(prices, bars.adaptive_thresholds(prices, pools, low=500.0)))


def _chain(t) -> DataFrame:  # noqa: ANN001
    return chain.labelled_bars(_ticked_bars(t), 0.4, 20, 0.5, 0.5).withColumn("pool_id", F.col("pool"))


@query(_TICKED, "fx_prices")
def t11_bars_with_pool_state(t):  # noqa: ANN001, ANN201
    return _ticked_bars(t)


@query(_CHAIN + "SELECT pool, bar_no, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("src_fracdiff", "dest_fracdiff", "rolling_volatility", "sample_weight", "dest_sample_weight", "src_liquidity_close", "src_tick_delta")) + ", label, dest_label, barrier_touch_bars, dest_barrier_touch_bars FROM fx_chain", "fx_prices")
def c1_labelled_bars(t):  # noqa: ANN001, ANN201
    return rounded(_chain(t).select("pool", "bar_no", "src_fracdiff", "dest_fracdiff", "rolling_volatility", "sample_weight", "dest_sample_weight", "src_liquidity_close", "src_tick_delta", "label", "dest_label", "barrier_touch_bars", "dest_barrier_touch_bars"))


@query()
def c2_swaps_to_training_table(t):  # noqa: ANN001, ANN201
    """The whole chain on swaps: inferred prices, bars with the numeraire, the least order and
    the vertical barrier of each token."""
    return rounded(chain.training_table(decode.decoded(t("fx_swaps")), "tok0", 6 * 3600.0))


@query(_CHAIN + """SELECT pool, bar_no, CAST(bar_close_timestamp AS DATE) AS trade_date, CAST(label AS INT) + 1 AS label_encoded, round(sample_weight, 6) AS sample_weight, round(coalesce(src_fracdiff, 0), 6) AS src_fracdiff, round(coalesce(dest_fracdiff, 0), 6) AS dest_fracdiff,
round(rolling_volatility, 6) AS rolling_volatility, round(ln(1 + abs(src_flow_usdc)), 6) AS log_src_flow, round(ln(1 + abs(dest_flow_usdc)), 6) AS log_dest_flow, round(abs(src_flow_usdc) / (abs(src_flow_usdc) + abs(dest_flow_usdc) + 1e-8), 6) AS buying_pressure,
round(bar_time_delta_sec, 6) AS bar_time_delta_sec, round(ln(1 + tick_count), 6) AS log_tick_count, round(coalesce(src_tick_delta, 0), 6) AS src_tick_delta, round(coalesce(dest_tick_delta, 0), 6) AS dest_tick_delta,
round(ln(1 + coalesce(src_liquidity_close, 0)), 6) AS log_src_liquidity, round(ln(1 + coalesce(dest_liquidity_close, 0)), 6) AS log_dest_liquidity FROM fx_chain WHERE label IS NOT NULL""", "fx_prices", dates="trade_date")
def m1_chain_features(t):  # noqa: ANN001, ANN201
    return rounded(features.feature_table(_chain(t), "pool", "bar_no"))


@query(_CHAIN + """SELECT token, coalesce(sum(abs(src_flow_usdc)), 0)::DECIMAL(38, 4)::DOUBLE AS total_flow, round(coalesce(avg(abs(src_flow_usdc)), 0), 4) AS mean_flow, round(coalesce(stddev_pop(src_flow_usdc), 0), 4) AS flow_volatility, round(coalesce(avg(src_fracdiff), 0), 6) AS mean_fracdiff,
round(coalesce(stddev_pop(src_fracdiff), 0), 6) AS fracdiff_volatility, count(src_token_id) AS num_swaps, round(coalesce(avg(CASE WHEN src_token_id IS NULL THEN NULL WHEN label = 1 THEN 1.0 ELSE 0 END), 0), 6) AS up_ratio, round(coalesce(avg(CASE WHEN src_token_id IS NULL THEN NULL WHEN label = -1 THEN 1.0 ELSE 0 END), 0), 6) AS down_ratio
FROM (SELECT DISTINCT event_type AS token FROM events) LEFT JOIN fx_chain ON src_token_id = token GROUP BY 1""", "fx_prices")
def a18_token_behaviour(t):  # noqa: ANN001, ANN201
    tokens = t("events").select(F.col("event_type").alias("token")).distinct()
    m = features.token_metrics(_chain(t), tokens)
    return rounded(m.withColumns({c: F.round(c, 4) for c in ("total_flow", "mean_flow", "flow_volatility")}))


_B = "fx_labelled"
_DIFFS = ("src_fracdiff", "dest_fracdiff")


@query(report_sql([
    *(("double", c, f"max(CASE WHEN typeof({c}) = 'DOUBLE' THEN 1 ELSE 0 END)", _B, 1, 1) for c in _DIFFS), *(("missing", c, f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", _B, None, 0.5) for c in _DIFFS),
    *nulls_sql(_B, "bar_close_timestamp", "src_token_id", "dest_token_id"), *spread_sql(_DIFFS[0], _DIFFS[0], _B), *spread_sql(_DIFFS[1], _DIFFS[1], _B), ("rows", "n", "count(*)", _B, 1, None),
    ("tokens", "src", "count(DISTINCT src_token_id)", _B, 1, None), ("tokens", "dest", "count(DISTINCT dest_token_id)", _B, 1, None),
    ("days", "first", "min(date_diff('day', DATE '1970-01-01', CAST(bar_close_timestamp AS DATE)))", _B, None, None), ("days", "last", "max(date_diff('day', DATE '1970-01-01', CAST(bar_close_timestamp AS DATE)))", _B, None, None),
]), "fx_labelled")
def q4_stationary_report(t):  # noqa: ANN001, ANN201
    return rounded(quality.stationary_report(t("fx_labelled")))


_WEIGHTS = BARRIER.replace("{N}", "30") + """, w AS (SELECT a.event_id, 1.0 / count(b.r) AS weight FROM l a JOIN l b ON a.tok = b.tok AND b.r <= a.r AND b.r >= a.r - 30 AND b.r + b.touch >= a.r WHERE a.touch IS NOT NULL AND b.touch IS NOT NULL GROUP BY 1)"""


_L = "(SELECT l.*, w.weight FROM l LEFT JOIN w USING (event_id))"
_OF = "count(*) FILTER (WHERE {})".format


@query(_WEIGHTS.replace("v.event_id, v.r,", "v.event_id, v.r, v.vol, v.block_timestamp AS ts,").replace("SELECT pool AS tok, event_id,", "SELECT pool AS tok, event_id, block_timestamp,") + report_sql([
    ("label", "unlabelled", _OF("label IS NULL"), _L, None, None), ("label", "up", _OF("label = 1"), _L, 1, None), ("label", "down", _OF("label = -1"), _L, 1, None), ("label", "none", _OF("label = 0"), _L, None, None),
    ("label", "others", _OF("label NOT IN (-1, 0, 1)"), _L, 0, 0), ("label", "coverage", "count(label) / count(*)", _L, None, None),
    ("label", "largest_share", "greatest(" + ", ".join(_OF(f"label = {v}") for v in (-1, 0, 1)) + ") / count(label)", _L, None, 0.8),
    ("weight", "missing", _OF("label IS NOT NULL AND weight IS NULL"), _L, 0, 0), ("weight", "least", "min(weight)", _L, 0, 1), ("weight", "most", "max(weight)", _L, 0, 1), ("weight", "mean", "avg(weight)", _L, None, None),
    ("volatility", "missing", _OF("label IS NOT NULL AND vol IS NULL"), _L, 0, 0), ("touch", "least", "min(touch)", _L, 1, None), ("touch", "most", "max(touch)", _L, None, None), ("touch", "mean", "avg(touch)", _L, None, None),
    ("rows", "n", "count(*)", _L, 1, None), ("tokens", "n", "count(DISTINCT tok)", _L, 1, None), *(("days", m, f"{f}(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)))", _L, None, None) for m, f in (("first", "min"), ("last", "max"))),
    median_sql("weight", "weight", _L), median_sql("touch", "touch", _L),
]), "fx_prices")
def q5_label_report(t):  # noqa: ANN001, ANN201
    return rounded(quality.label_report(series.concurrency_weights(_labelled(t))))


# the bounds that hold for each column: ten times the expected range, a tenth of a lower bound above 0
_BOUNDS = {c: (low * (10 if low < 0 else 0.1), high * 10) for c, (low, high) in quality.EXPECTED.items()}
_TICKS = ("src_tick_delta", "dest_tick_delta")


def _training_sql(source: str, *keys: str) -> str:
    whole = " AND ".join(f"isfinite(CAST({c} AS DOUBLE))" for c in quality.CORRELATED)
    pairs = [(a, b) for i, a in enumerate(quality.CORRELATED) for b in quality.CORRELATED[i + 1 :]]
    quiet = f"(SELECT n, median(n) OVER () AS m FROM (SELECT CAST(bar_close_timestamp AS DATE) AS d, count(*) AS n FROM {source} GROUP BY 1))"
    return report_sql([
        *(("finite", c, f"count(*) FILTER (WHERE NOT isfinite(CAST({c} AS DOUBLE)))", source, 0, 0) for c in _BOUNDS), *(("missing", c, f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", source, None, None) for c in _BOUNDS),
        *(("least", c, f"min({c})", source, low, None) for c, (low, _) in _BOUNDS.items()), *(("most", c, f"max({c})", source, None, high) for c, (_, high) in _BOUNDS.items()),
        *(("zero_share", c, f"avg(CASE WHEN {c} = 0 THEN 1.0 WHEN {c} <> 0 THEN 0.0 END)", source, None, 0.5) for c in ("src_flow_usdc", "dest_flow_usdc", *_TICKS)), ("zero_share", "rolling_volatility", "avg(CASE WHEN rolling_volatility < 1e-10 THEN 1.0 WHEN rolling_volatility >= 1e-10 THEN 0.0 END)", source, None, 0.1),
        *(("stationary", c, f"abs(avg({c}))", source, None, 2) for c in _DIFFS), *(("negatives", c, f"count(*) FILTER (WHERE {c} < 0)", source, 0, 0) for c in ("tick_count", "bar_time_delta_sec", "src_liquidity_close", "dest_liquidity_close")),
        *(("z_mean", c, f"abs(avg({c}))", source, None, 0.1) for c in _TICKS), *(("z_std", c, f"stddev_samp({c})", source, 0.8, 1.2) for c in _TICKS), ("correlation", "src_dest_fracdiff", "abs(corr(src_fracdiff, dest_fracdiff))", source, None, 0.5),
        *(("correlation", f"{a}/{b}", f"CASE WHEN count(*) FILTER (WHERE {whole}) > 1000 THEN corr({a}, {b}) FILTER (WHERE {whole}) END", source, None, None) for a, b in pairs),
        ("labels", "coverage", "count(label) / count(*)", source, 0.1, None), ("labels", "balance", "min(n) / max(n)", f"(SELECT count(*) AS n FROM {source} WHERE label IS NOT NULL GROUP BY label)", 0.1, None), ("rows", "n", "count(*)", source, 1, None),
        duplicates_sql(source, *keys), gap_sql("time", "bar_close_timestamp", source), ("time", "quiet_days", "count(*) FILTER (WHERE n < 0.1 * m)", quiet, 0, 0),
        *(("median", c, f"median({c})", source, None, None) for c in _BOUNDS if c != "label"),
    ], 4)


@query(_CHAIN + _training_sql("fx_chain", "pool", "bar_no"), "fx_prices")
def q6_chain_report(t):  # noqa: ANN001, ANN201
    """The report over the library's own labelled bars."""
    return quality.training_report(_chain(t), ("pool", "bar_no")).withColumn("value", F.round("value", 4))


@query(_training_sql(_B, "l_orderkey", "l_linenumber"), "fx_labelled")
def q6_training_report(t):  # noqa: ANN001, ANN201
    return quality.training_report(t("fx_labelled"), ("l_orderkey", "l_linenumber")).withColumn("value", F.round("value", 4))


@query("""SELECT metric, round(least, 4) AS least, round(most, 4) AS most, round(zeros, 6) AS zero_share, most <= expected * 10 AND least >= 0 AS in_range FROM (
SELECT 'src_flow_usdc' AS metric, min(src_flow_usdc) AS least, max(src_flow_usdc) AS most, avg(CASE WHEN src_flow_usdc = 0 THEN 1.0 ELSE 0 END) AS zeros, 1e5 AS expected FROM fx_bars UNION ALL
SELECT 'dest_price_usdc', min(dest_price_usdc), max(dest_price_usdc), avg(CASE WHEN dest_price_usdc = 0 THEN 1.0 ELSE 0 END), 1e3 FROM fx_bars)""", "fx_bars")
def q6_training_ranges(t):  # noqa: ANN001, ANN201
    expected = {"src_flow_usdc": 1e5, "dest_price_usdc": 1e3}
    one = t("fx_bars").agg(*(f(c).alias(f"{n}_{c}") for c in expected for n, f in (("least", F.min), ("most", F.max), ("zeros", lambda c: F.avg((F.col(c) == 0).cast("double"))))))
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"least_{c}").alias("least"), F.col(f"most_{c}").alias("most"), F.col(f"zeros_{c}").alias("zeros"), F.lit(e).alias("expected")) for c, e in expected.items()))
    long = one.select(F.explode(rows).alias("r")).select("r.*")
    return long.select("metric", F.round("least", 4).alias("least"), F.round("most", 4).alias("most"), r6("zeros").alias("zero_share"), ((F.col("most") <= F.col("expected") * 10) & (F.col("least") >= 0)).alias("in_range"))


@query("""WITH m AS (SELECT token_address, date_trunc('day', block_timestamp) AS h, avg(price_in_usdc) AS price FROM fx_prices WHERE flow_sign = 1 GROUP BY 1, 2), q AS (SELECT token_address, date_trunc('day', block_timestamp) AS h, avg(price_in_usdc) AS ref FROM fx_prices WHERE flow_sign = -1 GROUP BY 1, 2)
SELECT token_address, count(*) AS n, round(corr(price, ref), 6) AS corr, round(avg(abs(price - ref) / (ref + 1e-9)) * 100, 4) AS mape, corr(price, ref) > 0.95 AND avg(abs(price - ref) / (ref + 1e-9)) * 100 < 5 AS pass FROM m JOIN q USING (token_address, h) GROUP BY 1""", "fx_prices")
def q7_daily_reference(t):  # noqa: ANN001, ANN201
    p = t("fx_prices")
    ref = p.where("flow_sign = -1").select("token_address", F.col("block_timestamp").alias("timestamp"), F.col("price_in_usdc").alias("price_usd"))
    out = pricing.against_reference(p.where("flow_sign = 1"), ref, "day")
    return out.select("token_address", "n", r6("corr").alias("corr"), F.round("mape", 4).alias("mape"), ((F.col("corr") > 0.95) & (F.col("mape") < 5)).alias("pass"))


@query()
def q8_stationarity_summary(t):  # noqa: ANN001, ANN201
    s = _pool_series(t).select("token", "ts", "price")
    found = series.minimum_d(s)
    n = s.agg(F.countDistinct("token").alias("tokens"))
    return rounded(found.agg(F.count("*").alias("stationary"), F.avg("d").alias("mean_d"), F.median("d").alias("median_d")).crossJoin(F.broadcast(n)))


@query(_WEIGHTS + """ SELECT tok AS token, count(*) AS n, count(label) AS labelled, count(*) FILTER (WHERE label = 1) AS up, count(*) FILTER (WHERE label = -1) AS down, count(*) FILTER (WHERE label = 0) AS none, round(avg(CASE WHEN label IS NOT NULL THEN touch END), 6) AS touch, round(avg(weight), 6) AS weight FROM l LEFT JOIN w USING (event_id) GROUP BY 1""", "fx_prices")
def q9_label_summary(t):  # noqa: ANN001, ANN201
    return rounded(quality.label_summary(series.concurrency_weights(_labelled(t))))


@query("""WITH d AS (SELECT token_address, CAST(block_timestamp AS DATE) AS day, avg(price_in_usdc) AS price FROM fx_prices GROUP BY 1, 2), r AS (SELECT *, price / lag(price) OVER (PARTITION BY token_address ORDER BY day) - 1 AS ret FROM d), v AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY token_address ORDER BY day ROWS 29 PRECEDING) AS vol, regr_slope(price, CAST(day - DATE '2024-01-01' AS DOUBLE)) OVER (PARTITION BY token_address ORDER BY day ROWS 9 PRECEDING) AS slope FROM r),
k AS (SELECT *, CASE WHEN vol IS NOT NULL THEN percent_rank() OVER (PARTITION BY token_address, vol IS NULL ORDER BY vol) END AS rank FROM v)
SELECT token_address, day, CASE WHEN rank >= 0.75 THEN 'volatile' WHEN slope > 0.0 AND NOT isnan(slope) THEN 'up' WHEN slope < 0.0 THEN 'down' ELSE 'flat' END AS regime FROM k""", "fx_prices", dates="day")
def z3_regimes(t):  # noqa: ANN001, ANN201
    from tidepool.operators.regimes import daily_volatility, regime

    v = daily_volatility(t("fx_prices"), "token_address", "block_timestamp", "price_in_usdc")
    w = Window.partitionBy("token_address").orderBy("day").rowsBetween(-9, 0)
    slope = F.regr_slope("price", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("double")).over(w)
    return v.withColumn("slope", slope).select("token_address", "day", regime(F.col("rank"), F.col("slope")).alias("regime"))


@query("""SELECT count(*) AS edges, round(sum(x), 4) AS total FROM (SELECT src_token_id, dest_token_id, avg(src_price_usdc) AS x FROM fx_bars GROUP BY 1, 2)""", "fx_bars")
def g12_pair_prices(t):  # noqa: ANN001, ANN201
    e = graph.exploded(t("fx_bars"), [], F.struct(F.col("src_token_id").alias("a"), F.col("dest_token_id").alias("b"), F.col("src_price_usdc").alias("x")))
    return e.groupBy("a", "b").agg(F.avg("x").alias("x")).agg(F.count("*").alias("edges"), F.round(F.sum("x"), 4).alias("total"))
