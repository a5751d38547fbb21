"""Swap-shaped views over the test tables (see FIXTURES.md), as SQL that Spark and
DuckDB read alike, and readers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {S} is the string type, {hex} the hex function of the engine.
_WORD = "lpad(lower({hex}({c})), 64, CASE WHEN {c} < 0 THEN 'f' ELSE '0' END)"


def _word(c: str) -> str:
    return _WORD.replace("{c}", c)


VIEWS = {
    "fx_swaps": f"""
SELECT event_id, block_timestamp, block_number, transaction_hash, concat(token0, '-', token1) AS pool, token0, token1,
       CASE WHEN token0 = 'tok0' THEN 6 ELSE 8 END AS token0_decimals, CASE WHEN token1 = 'tok0' THEN 6 ELSE 8 END AS token1_decimals,
       amount0, amount1, tick, cents, sender, recipient,
       concat('0x', {_word('amount0')}, {_word('amount1')}, lpad(lower({{hex}}(1000000 + event_id)), 64, '0'),
              lpad(lower({{hex}}(500000 + cents)), 64, '0'), {_word('tick')}) AS data
FROM (SELECT event_id, ts AS block_timestamp, CAST(floor(event_id / 3) AS BIGINT) AS block_number,
             concat('0x', lpad(lower({{hex}}(event_id)), 8, '0')) AS transaction_hash,
             CASE event_id % 4 WHEN 0 THEN 'tok0' WHEN 1 THEN concat('tok', CAST(1 + user_id % 4 AS {{S}})) ELSE concat('tok', CAST(1 + user_id % 2 AS {{S}})) END AS token0,
             CASE event_id % 4 WHEN 0 THEN concat('tok', CAST(1 + user_id % 4 AS {{S}})) WHEN 1 THEN 'tok0' ELSE concat('tok', CAST(3 + user_id % 2 AS {{S}})) END AS token1,
             cents, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * cents * 10000 AS amount0,
             CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * cents * 10000 * (1 + user_id % 7) AS amount1,
             CAST(cents - 5000 AS BIGINT) AS tick, concat('a', CAST(user_id % 150 AS {{S}})) AS sender, concat('a', CAST(CASE WHEN event_id % 5 = 0 THEN user_id ELSE event_id END % 150 AS {{S}})) AS recipient
      FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) e) x""",
    "fx_prices": """
SELECT event_id, ts AS block_timestamp, concat('pool', CAST(user_id % 20 AS {S})) AS pool, event_type AS token_address,
       value AS price_in_usdc, value AS usdc_volume, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS flow_sign FROM events""",
    "fx_bars": """
SELECT l_shipdate AS bar_close_timestamp, l_suppkey AS pool_id, l_partkey % 50 AS src_token_id, l_orderkey % 50 AS dest_token_id,
       l_extendedprice AS src_flow_usdc, -l_extendedprice * l_discount AS dest_flow_usdc, l_extendedprice / l_quantity AS src_price_usdc,
       o_totalprice AS dest_price_usdc, CAST(l_linenumber AS BIGINT) AS tick_count, l_orderkey, l_partkey, l_tax
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_labelled": """
SELECT l_shipdate AS bar_close_timestamp, l_suppkey AS pool_id, l_partkey % 50 AS src_token_id, l_orderkey % 50 AS dest_token_id, l_orderkey, l_partkey, l_linenumber,
       l_extendedprice AS src_flow_usdc, -l_extendedprice * l_discount AS dest_flow_usdc, l_extendedprice / l_quantity AS src_price_usdc, o_totalprice AS dest_price_usdc,
       CAST(l_linenumber AS BIGINT) AS tick_count, CAST(l_linenumber * 20000 AS DOUBLE) AS bar_time_delta_sec,
       CASE WHEN l_orderkey % 10 <> 0 THEN ln(1 + l_extendedprice) END AS src_liquidity_close, ln(1 + o_totalprice) AS dest_liquidity_close,
       (l_quantity - 25) / 10 AS src_tick_delta, CASE WHEN l_orderkey % 7 <> 0 THEN (l_discount - 0.05) * 20 END AS dest_tick_delta,
       CASE WHEN l_orderkey % 11 <> 0 THEN l_discount - 0.05 END AS src_fracdiff, l_tax - 0.04 AS dest_fracdiff, l_tax AS rolling_volatility,
       CAST(CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_discount < 0.025 THEN -1 WHEN l_discount < 0.075 THEN 0 ELSE 1 END AS DOUBLE) AS label,
       CAST(CASE WHEN l_linenumber < 7 THEN 1.0 / (1 + l_linenumber) ELSE 0 END AS DOUBLE) AS sample_weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_pools": """
SELECT s_suppkey AS address, s_nationkey AS token0, (s_nationkey + 1 + s_suppkey % 5) % 25 AS token1,
       CAST(CASE s_suppkey % 3 WHEN 0 THEN 0.0005 WHEN 1 THEN 0.003 ELSE 0.01 END AS DOUBLE) AS fee FROM supplier""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "labels", "documents", "benchmark", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or one of VIEWS over them."""
    if name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # the operators work on instants
        return df.withColumns({c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})
    sql = VIEWS[name].replace("{S}", "STRING").replace("{hex}", "hex")
    used = [t for t in TABLES if f" {t}" in sql]
    for t in used:
        sql = sql.replace(f" {t}", f" {{{t}}}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def oracle(body: str, *views: str) -> str:
    """DuckDB SQL of body with views as common table expressions."""
    ctes = [f"{v} AS ({VIEWS[v].replace('{S}', 'VARCHAR').replace('{hex}', 'to_hex')})" for v in views]
    body = body.strip()
    if body.upper().startswith("WITH "):
        rest = body[5:]
        recursive = rest.upper().startswith("RECURSIVE ")
        rest = rest[10:] if recursive else rest
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*ctes, rest])}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
