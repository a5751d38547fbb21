"""Token and pool graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.functions.numbers import clip
from tidepool.operators.ranges import numbered
from tidepool.operators.tables import settled, written

# Pool defaults.
DEFAULT_FEE, DEFAULT_TICK_SPACING = 0.003, 60


def exploded(df: DataFrame, keep: list[str], *rows: Column) -> DataFrame:
    """One output row for each struct of rows, in one pass."""
    return df.select(*keep, F.explode(F.array(*rows)).alias("_e")).select(*keep, "_e.*")


def token_edges(bars: DataFrame, *keep: str) -> DataFrame:
    """G1: an edge in either direction for each bar, weighted with the flow out."""
    edge = lambda a, b: F.struct(F.col(f"{a}_token_id").alias("src"), F.col(f"{b}_token_id").alias("dst"), F.abs(f"{a}_flow_usdc").alias("weight"))
    return exploded(bars, list(keep), edge("src", "dest"), edge("dest", "src"))


def node_updates(bars: DataFrame, features: dict[str, tuple[str, str]], *keep: str) -> DataFrame:
    """Two node updates a bar; features: name to the columns of the source and the
    destination. NaN and null become 0."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    node = lambda side, i: F.struct(F.col(f"{side}_token_id").alias("node"), *(zero(c[i]).alias(n) for n, c in features.items()))
    return exploded(bars, list(keep), node("src", 0), node("dest", 1))


def _zero(c: Column) -> Column:
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def _scaled_flow(side: str) -> Column:
    """A flow in millions, clipped."""
    return clip(_zero(F.col(f"{side}_flow_usdc")) / 1e6, -10.0, 10.0)


def _pool_edge(side: str, *more: Column) -> Column:
    """An edge of a bar between a token and its pool with its clipped features, after `more`."""
    return F.struct(
        *more, F.abs(_scaled_flow(side)).alias("amount"),
        clip(_zero(F.col("tick_count")) / 100, 0.0, 10.0).alias("ticks"), clip(_zero(F.col("bar_time_delta_sec")) / 3600, 0.0, 24.0).alias("delta"),
    )


def bipartite_edges(bars: DataFrame, *keep: str) -> DataFrame:
    """Four edges a bar between its pool and its two tokens: src, dst, direction (0 into
    the pool, 1 out of it), amount (millions), ticks (hundreds) and delta (hours), clipped;
    null and NaN are 0."""
    def edge(side: str, out: bool) -> Column:
        ends = [F.col(f"{side}_token_id"), F.col("pool_id")]
        src, dst = reversed(ends) if out else ends
        return _pool_edge(side, src.alias("src"), dst.alias("dst"), F.lit(int(out)).alias("direction"))

    return exploded(bars, list(keep), edge("src", False), edge("dest", True), edge("src", True), edge("dest", False))


def bipartite_totals(bars: DataFrame) -> DataFrame:
    """Number and sums of the edges of bipartite_edges by direction, src and dst. Both
    directions of a token and pool have the same sums, which are made once. Edges are dealt by
    token and pool first: sums that are begun before would hold most edges of a task."""
    ends = lambda side: (F.col(f"{side}_token_id").alias("token"), F.col("pool_id").alias("pool"))
    edges = exploded(bars, [], *(_pool_edge(side, *ends(side)) for side in ("src", "dest"))).repartition("token", "pool")
    sums = edges.groupBy("token", "pool").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("amount", "ticks", "delta")))
    to = lambda out, src, dst: F.struct(F.lit(out).alias("direction"), F.col(src).alias("src"), F.col(dst).alias("dst"))
    return exploded(sums, ["n", "amount", "ticks", "delta"], to(0, "token", "pool"), to(1, "pool", "token")).select("direction", "src", "dst", "n", "amount", "ticks", "delta")


def pool_updates(bars: DataFrame, pools: DataFrame, *keep: str) -> DataFrame:
    """Three node updates a bar: kind, node and five features. Tokens: fractional
    difference, volatility, flow, liquidity, tick movement; pools: fee, tick spacing (both
    with a default), mean liquidity, mean flow, mean tick movement. pools: address, fee,
    tick_spacing; null and NaN are 0."""
    joined = bars.join(pools.select(F.col("address").alias("pool_id"), "fee", "tick_spacing"), "pool_id", "left")
    liquidity = lambda side: F.log1p(F.abs(_zero(F.col(f"{side}_liquidity_close")))) / 20
    movement = lambda side: clip(_zero(F.col(f"{side}_tick_delta")) / 1000, -10.0, 10.0)
    mean = lambda f: (f("src") + f("dest")) / 2

    def node(kind: str, c: str, *features: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("node"), *(f.alias(f"f{i}") for i, f in enumerate(features)))

    token = lambda side: node(side, f"{side}_token_id", _zero(F.col(f"{side}_fracdiff")), _zero(F.col("rolling_volatility")), _scaled_flow(side), liquidity(side), movement(side))
    pool = node(
        "pool", "pool_id", F.coalesce("fee", F.lit(DEFAULT_FEE)) * 100, F.coalesce("tick_spacing", F.lit(DEFAULT_TICK_SPACING)) / 200,
        mean(liquidity), mean(lambda side: F.abs(_scaled_flow(side))), mean(movement),
    )
    return exploded(joined, list(keep), token("src"), token("dest"), pool)


def batch_features(bars: DataFrame, batch: str, *order: str) -> DataFrame:
    """Of each token of a batch the means over the bars it is the source of (events):
    fractional difference, volatility, log flow, buying pressure; and label (0 to 2) and
    weight of the last of them that has a label. A token that is never the source has 0, the
    label -1 and the weight 0; a missing or zero weight of a label is 1."""
    has = F.col("label").isNotNull() & ~F.isnan("label")
    src, dest = F.abs(F.coalesce("src_flow_usdc", F.lit(0.0))), F.abs(F.coalesce("dest_flow_usdc", F.lit(0.0)))
    values = {"fracdiff": F.coalesce("src_fracdiff", F.lit(0.0)), "volatility": F.coalesce("rolling_volatility", F.lit(0.0)), "log_flow": F.log1p(src), "pressure": src / (src + dest + 1e-8)}
    weight = F.coalesce(F.when(F.col("sample_weight") != 0, F.col("sample_weight")), F.lit(1.0))
    last = F.struct((F.col("label").cast("int") + 1).alias("label"), weight.alias("weight"))
    as_src = F.struct(F.col("src_token_id").alias("token"), *(v.alias(n) for n, v in values.items()), F.when(has, last).alias("last"), F.when(has, F.struct(*order)).alias("at"), F.lit(1).alias("event"))
    as_dest = F.struct(F.col("dest_token_id").alias("token"), *(F.lit(None).cast("double").alias(n) for n in values), F.when(F.lit(False), last).alias("last"), F.when(F.lit(False), F.struct(*order)).alias("at"), F.lit(0).alias("event"))
    per = exploded(bars, [batch], as_src, as_dest).groupBy(batch, "token").agg(F.sum("event").alias("events"), *(_zero(F.avg(n)).alias(n) for n in values), F.max_by("last", "at").alias("last"))
    return per.select(batch, "token", "events", *values, F.coalesce("last.label", F.lit(-1)).alias("label"), F.coalesce("last.weight", F.lit(0.0)).alias("weight"))


def batch_pool_features(bars: DataFrame, batch: str) -> DataFrame:
    """Of each pool of a batch the means of log ticks, tick movement, log volume and log
    volume over liquidity. Missing or zero ticks are 1, liquidity 1e12."""
    or_default = lambda c, d: F.coalesce(F.when(F.col(c) != 0, F.col(c).cast("double")), F.lit(d))
    volume = F.abs(F.coalesce("src_flow_usdc", F.lit(0.0))) + F.abs(F.coalesce("dest_flow_usdc", F.lit(0.0)))
    values = {
        "log_ticks": F.log1p(or_default("tick_count", 1.0)), "tick_delta": or_default("src_tick_delta", 0.0), "log_volume": F.log1p(volume),
        "utilisation": F.log1p(volume / (or_default("src_liquidity_close", 1e12) + 1e-8)),
    }
    return bars.groupBy(batch, F.col("pool_id").alias("pool")).agg(F.count("*").alias("events"), *(_zero(F.avg(v)).alias(n) for n, v in values.items()))


def batch_edges(bars: DataFrame, batch: str) -> DataFrame:
    """Distinct token to pool edges of each batch. Edges are dealt by what makes them
    distinct first, so that no task holds more than its own."""
    pair = lambda r: F.struct(F.col(f"{r}_token_id").alias("token"), F.col("pool_id").alias("pool"))
    return exploded(bars, [batch], pair("src"), pair("dest")).repartition(batch, "token", "pool").distinct()


def adjacency(bars: DataFrame, *order: str) -> DataFrame:
    """For each pool its first tokens and its bars."""
    at = F.struct(*order)
    return bars.groupBy("pool_id").agg(F.min_by("src_token_id", at).alias("first_src"), F.min_by("dest_token_id", at).alias("first_dest"), F.count("*").alias("bars"))


def tokens_from_pools(pools: DataFrame) -> DataFrame:
    """For each token its pools, by address, once each."""
    return exploded(pools, ["address"], F.struct(F.col("token0").alias("token")), F.struct(F.col("token1").alias("token"))).groupBy("token").agg(F.array_sort(F.collect_set("address")).alias("pools")).select("token", "pools", F.size("pools").cast("long").alias("pool_count"))


def token_view(pools: DataFrame, order: str = "address") -> DataFrame:
    """For each token (lower case) symbol (upper case), decimals and chain of its first
    place that has a symbol (of its last place if none has), and its pools, once each.
    pools: as POOLS_JSON."""
    info = F.struct(F.col("address").alias("pool_address"), F.col("name").alias("pool_name"), "blockchain", "protocol", "type", "fee", F.col("tickSpacing").alias("tick_spacing"))
    places = pools.select(F.col(order).alias("_o"), info.alias("pool"), F.posexplode("tokens").alias("_p", "t"))
    token = F.struct(F.upper(F.coalesce("t.symbol", F.lit(""))).alias("symbol"), F.col("t.decimals").alias("decimals"), F.col("t.blockchain").alias("blockchain"))
    places = places.select(F.lower("t.address").alias("token"), token.alias("meta"), "pool", F.struct("_o", "_p").alias("at")).where("token <> ''")
    named = F.when(F.col("meta.symbol") != "", F.col("at"))
    # one row for each pool of a token before the lists are made
    once = places.groupBy("token", "pool.pool_address").agg(
        F.min_by("pool", "at").alias("pool"), F.min("at").alias("first"), F.min(named).alias("named"), F.min_by("meta", named).alias("meta"), F.max("at").alias("end"), F.max_by("meta", "at").alias("last"),
    )
    per = once.groupBy("token").agg(F.coalesce(F.min_by("meta", "named"), F.max_by("last", "end")).alias("meta"), F.array_sort(F.collect_list(F.struct("first", "pool"))).alias("pools"))
    return per.select("token", "meta.*", F.size("pools").cast("long").alias("pool_count"), F.transform("pools", lambda p: p["pool"]).alias("pools"))


def neighbour_mean(edges: DataFrame, features: DataFrame, value: str, *batch: str) -> DataFrame:
    """For each node the mean of its neighbours' feature, weighted by flow."""
    at = edges.hint("merge").join(features.withColumnRenamed("node", "src").hint("merge"), [*batch, "src"])
    return at.groupBy(*batch, "dst").agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("message"))


def temporal_messages(bars: DataFrame, batch: str, value: str, hops: int = 2, decay: float = 0.7, reach: int = 16) -> DataFrame:
    """(batch, node, hop1, hop2, ...): G10 over time and more than one hop. In each batch a token
    gets the flow-weighted mean of its neighbours' feature, hop by hop (a feature is the mean of
    `value` over the batch's bars from the token); what reaches it in a batch counts for the
    `reach` batches after it, less by `decay` with each, and never for its own."""
    flow = lambda a, b: F.struct(F.col(f"{a}_token_id").alias("src"), F.col(f"{b}_token_id").alias("dst"), F.abs(F.coalesce("src_flow_usdc", F.lit(0.0))).alias("weight"))
    edges = exploded(bars, [batch], flow("src", "dest"), flow("dest", "src")).where("weight > 0").groupBy(batch, "src", "dst").agg(F.sum("weight").alias("weight"))
    edges = settled(edges, "edges")
    at = bars.groupBy(batch, F.col("src_token_id").alias("node")).agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("x"))
    found = None
    for hop in range(1, hops + 1):
        at = settled(neighbour_mean(edges, at, "x", batch).select(batch, F.col("dst").alias("node"), F.col("message").alias("x")), "hop")
        later = at.select("node", F.explode(F.sequence(F.col(batch) + 1, F.col(batch) + reach)).alias("_b"), batch, "x")
        sums = later.groupBy(F.col("_b").alias(batch), "node").agg(F.sum(F.col("x") * F.pow(F.lit(decay), F.col("_b") - F.col(batch) - 1)).alias(f"hop{hop}"))
        found = sums if found is None else found.hint("merge").join(sums.hint("merge"), [batch, "node"], "full")
    return found


def encoded(df: DataFrame, column: str, out: str, offset: int = 0) -> DataFrame:
    """0-based ids in order of the distinct values. The dictionary is numbered by ranges
    over the distinct values alone and joined back."""
    ids = numbered(written(df.select(column).distinct(), "ids"), column, out=out).withColumn(out, F.col(out) + offset)
    return df.join(ids, column)
