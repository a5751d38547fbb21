"""Declared schemas of the stage tables."""

RAW_LOGS = "block_timestamp timestamp, block_number bigint, transaction_hash string, pool_or_manager_address string, topics array<string>, data string"
POOLS_JSON = "data array<struct<address:string,name:string,protocol:string,blockchain:string,type:string,fee:string,tickSpacing:int,tokens:array<struct<address:string,symbol:string,decimals:string,blockchain:string>>>>"
WATCH_TOKEN = "map<string,struct<symbol:string,coingecko_id:string,volatility:double,liquidity:bigint>>"
SWAPS = "block_timestamp timestamp, block_number bigint, transaction_hash string, pool string, token0 string, token1 string, token0_decimals int, token1_decimals int, sender string, recipient string, data string"
PRICES = "block_timestamp timestamp, block_number bigint, transaction_hash string, pool string, token_address string, price_in_usdc double, usdc_volume double"
BARS = (
    "bar_close_timestamp timestamp, pool_id string, src_token_id string, dest_token_id string, src_flow_usdc double, dest_flow_usdc double, src_price_usdc double, dest_price_usdc double, "
    "bar_time_delta_sec double, tick_count bigint, src_liquidity_close double, dest_liquidity_close double, src_tick_delta double, dest_tick_delta double"
)
