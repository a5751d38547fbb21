"""Sources and sinks of the stage tables (S rows of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import POOLS_JSON, RAW_LOGS, WATCH_TOKEN

# First topic of swap events of protocol versions 2, 3 and 4.
SWAP_TOPICS = (
    "0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822",
    "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67",
    "0x40e9cecb9f5f1f1c5b9c97dec2917b7ee92e57ba5563708daca94dd84ad7112f",
)


def read_swap_logs(spark: SparkSession, path: str, chain: str | None = None, start: str | None = None, end: str | None = None, signatures: tuple[str, ...] = SWAP_TOPICS) -> DataFrame:
    """Swap events of a Parquet folder; chain and date are partition
    columns where the folder has them, so both filters prune files."""
    found = spark.read.option("mergeSchema", False).parquet(path)
    if chain is not None and "chain" in found.columns:
        found = found.where(F.col("chain") == chain)
    return in_dates(found.where(F.get("topics", F.lit(0)).isin(*signatures)), "block_timestamp", start, end)


def in_dates(df: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    """Start 00:00 up to the end of day `end`; either may be missing."""
    if start is not None:
        df = df.where(F.col(ts) >= F.to_timestamp(F.lit(start)))
    return df if end is None else df.where(F.col(ts) < F.to_timestamp(F.lit(end)) + F.expr("INTERVAL 1 DAY"))


def read_pools(spark: SparkSession, path: str, protocol: str = "usp3", blockchain: str = "ethereum") -> DataFrame:
    """Pools of exactly two tokens from a JSON object with a list `data`; other
    structures fail the read."""
    whole = spark.read.schema(POOLS_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return two_token_pools(whole.select(F.explode("data").alias("p")).select("p.*"), protocol, blockchain)


def two_token_pools(pools: DataFrame, protocol: str, blockchain: str) -> DataFrame:
    kept = pools.where((F.col("protocol") == protocol) & (F.col("blockchain") == blockchain) & (F.size("tokens") == 2))
    side = lambda i, f: F.col("tokens")[i][f]
    return kept.select(
        F.lower("address").alias("address"), "name", F.col("fee").cast("double").alias("fee"), F.col("tickSpacing").alias("tick_spacing"),
        F.lower(side(0, "address")).alias("token0"), F.lower(side(1, "address")).alias("token1"), side(0, "decimals").cast("int").alias("token0_decimals"), side(1, "decimals").cast("int").alias("token1_decimals"),
    )


def tokens_from_json(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """(address, ...) of a JSON map from address to an object."""
    return texts.select(F.explode(F.from_json(F.col(column), schema)).alias("address", "v")).select("address", "v.*")


def watch_list(texts: DataFrame, column: str) -> DataFrame:
    """Entries that have an id in the price service."""
    return tokens_from_json(texts, column, WATCH_TOKEN).where("coingecko_id is not null")


def write_swaps(df: DataFrame, path: str) -> None:
    """The ingest sink, one folder for each chain and date."""
    df.withColumn("date", F.to_date("block_timestamp")).write.mode("overwrite").partitionBy("chain", "date").parquet(path)


def write_stage(df: DataFrame, path: str) -> None:
    """A stage table."""
    df.write.mode("overwrite").parquet(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    """Embeddings (id, embedding, label, trade_date), one folder a date; a new date
    replaces its own folder only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(path)


def read_embeddings(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The embeddings of all dates, or of those from start to end; the date is a
    partition column, so other folders are not read."""
    found = spark.read.schema("id string, embedding array<float>, label int, trade_date date").parquet(path)
    found = found if start is None else found.where(F.col("trade_date") >= F.lit(start).cast("date"))
    return found if end is None else found.where(F.col("trade_date") <= F.lit(end).cast("date"))


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """Df by partition columns (chain, date); only the partitions of df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def of_chains(logs: DataFrame, chains: DataFrame) -> DataFrame:
    """The rows of logs (partitioned by chain) whose chain is in chains (chain, ...), with
    the columns of chains. The list is one row a chain, so Spark broadcasts it, and what is in
    it decides at run time which folders are read."""
    return logs.join(F.broadcast(chains), "chain")


def read_reference_prices(spark: SparkSession, path: str, token: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Reference prices (token_address, timestamp, price_usd) of a token and a range
    of days; addresses compare in lower case."""
    found = spark.read.schema("token_address string, timestamp timestamp, price_usd double").parquet(path)
    found = found if token is None else found.where(F.lower("token_address") == token.lower())
    return in_dates(found, "timestamp", start, end)


def write_tokens_json(df: DataFrame, path: str) -> None:
    """One JSON object for each token."""
    df.write.mode("overwrite").json(path)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Df, or an error that lists the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def preview(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first and the last n rows in order."""
    first = df.orderBy(*order).limit(n)
    last = df.orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in order)).limit(n)
    return first.withColumn("part", F.lit("first")).unionByName(last.withColumn("part", F.lit("last")))
