"""Indirect prices (T1): swaps without the numeraire, priced from recent prices.

A cache holds the last price of each token and its origin, the time when the price was seen
in a swap with the numeraire. A swap of two cached tokens gives each a new price from the
other's, of the older of both origins; prices older than the time to live are not used. So
a row depends on all rows before it, of its component (tokens that swap with each other).

Components never meet, and inside one the work is speculative: chunks of time run side by
side, each after a warm-up of one time to live, as nothing older can be used in it. That the
warm-up found the true cache is not certain (a swap in it may have used a price that is older
still), so at each seam the cache that a chunk started with is compared with the one that the
chunk before ended with; only chunks where these differ run again, from the true cache, in
rounds until no seam differs. The first chunk is right from the start and a round sets at
least one more right, so the result is that of one pass over all rows; a busy component
without a silence is dealt over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.operators.pricing import LEAST_PRICE, MOST_PRICE, MOST_VOLUME, ORDER, components, direct_prices
from tidepool.operators.tables import dropped, written

#: A chunk's length in times to live: its warm-up repeats one part in so many.
CHUNK_TTLS = 8

Cache = dict[str, tuple[float, int]]


def infer(cache: Cache, at: int, t0: str, t1: str, a0: float, a1: float, ttl: int) -> list[tuple[str, float, float]]:
    """(token, price, volume) of both sides of an indirect swap at a time in microseconds, or
    nothing; the cache takes the new prices."""
    if t0 not in cache or t1 not in cache or not a0 or not a1:
        return []
    (p0, o0), (p1, o1) = cache[t0], cache[t1]
    if at - o0 > ttl or at - o1 > ttl:
        return []
    new1, new0 = a0 / a1 * p0, a1 / a0 * p1
    if not (LEAST_PRICE <= new0 <= MOST_PRICE and LEAST_PRICE <= new1 <= MOST_PRICE) or a0 * new0 > MOST_VOLUME:
        return []
    origin = min(o0, o1)
    cache[t0], cache[t1] = (new0, origin), (new1, origin)
    return [(t0, new0, a0 * new0 / 2), (t1, new1, a0 * new0 / 2)]


def usable(cache: Cache, at: int, ttl: int) -> list[tuple[str, float, int]]:
    """The entries that a row at this time or later can use, in order."""
    return sorted((t, p, o) for t, (p, o) in cache.items() if at - o <= ttl)


_STATE = "array<struct<token:string,price:double,origin:long>>"
_OUT = f"component string, chunk long, event_id long, micros long, token_address string, price_in_usdc double, usdc_volume double, direct boolean, before {_STATE}, after {_STATE}"
_OWN = ("component", "chunk", "event_id", "micros", "token_address", "price_in_usdc", "usdc_volume", "direct")


def _run(ttl: int, length: int):  # noqa: ANN202
    """Chunks sorted by (component, chunk, time). kind: 0 a cache to start with, 1 warm-up, 2 a
    row of the chunk. A chunk ends with a row of its caches: before and after."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, cache, before = None, {}, None

        def seam() -> tuple:
            return (*unit, None, None, None, None, None, None, before, usable(cache, (unit[1] + 1) * length, ttl))

        for pdf in frames:
            out = []
            for key, kind, state, at, direct, t0, t1, a0, a1, price, volume, event in zip(
                zip(pdf["component"], pdf["chunk"]), pdf["kind"], pdf["state"], pdf["micros"], pdf["direct"], pdf["token0"], pdf["token1"], pdf["amount0"], pdf["amount1"], pdf["price"], pdf["volume"], pdf["event_id"]
            ):
                if key != unit:
                    if before is not None:
                        out.append(seam())
                    unit, cache, before = key, {}, None
                if kind == 0:
                    cache = {x["token"]: (x["price"], x["origin"]) for x in state}
                    continue
                if kind == 2 and before is None:
                    before = usable(cache, key[1] * length, ttl)
                if direct:
                    cache[t0] = (price, at)
                    found = [(t0, price, volume)]
                else:
                    found = infer(cache, at, t0, t1, a0, a1, ttl)
                if kind == 2:
                    out += [(*key, event, at, t, p, v, bool(direct), None, None) for t, p, v in found]
            yield _frame(out)
        if before is not None:
            yield _frame([seam()])

    return scan


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=[*_OWN, "before", "after"], dtype=object)
    for side in ("before", "after"):
        # a batch of warm-up rows has no output: without its type an empty column would be of floats
        pdf[side] = pd.Series([None if s is None else [{"token": t, "price": p, "origin": o} for t, p, o in s] for s in pdf[side]], dtype=object)
    return pdf.astype({"chunk": "int64", "event_id": "Int64", "micros": "Int64", "price_in_usdc": "Float64", "usdc_volume": "Float64", "direct": "boolean"})


def _seams(states: DataFrame) -> DataFrame:
    """(component, chunk, state): the chunks that did not start with what the chunk before
    ended with, and what that is. One row a chunk is sorted."""
    w = Window.partitionBy("component").orderBy("chunk")
    true = F.when(F.lag("chunk").over(w) == F.col("chunk") - 1, F.lag("after").over(w))
    # after a chunk without rows nothing is fresh
    seen = states.select("component", "chunk", "before", F.coalesce(true, F.array().cast(_STATE)).alias("state"))
    return seen.where("before <> state").select("component", "chunk", "state")


def in_chunks(rows: DataFrame, ttl_s: float, chunk_s: float | None = None, report: list[int] | None = None) -> DataFrame:
    """The inference over rows (component, micros, block_number, event_id, direct, token0,
    token1, amount0, amount1, price, volume). report, if given, gets the number of chunks of
    each round."""
    ttl = int(ttl_s * 1e6)
    length = max(int((chunk_s or CHUNK_TTLS * ttl_s) * 1e6), ttl, 1)
    chunk = F.floor(F.col("micros") / length).cast("long")
    order = ("component", "chunk", "kind", "micros", "block_number", "event_id")
    columns = ("component", "chunk", "kind", "state", "micros", "direct", "token0", "token1", "amount0", "amount1", "price", "volume", "event_id")

    def passed(chunks: DataFrame) -> DataFrame:
        dealt = chunks.repartition("component", "chunk").sortWithinPartitions(*order)
        return written(dealt.select(*columns).mapInPandas(_run(ttl, length), _OUT), "chunks")

    # the copy of a row that warms up the next chunk; rows of a time are whole microseconds
    also = F.when(F.col("micros") >= (chunk + 1) * length - ttl, F.struct((chunk + 1).alias("chunk"), F.lit(1).alias("kind")))
    placed = rows.withColumn("_at", F.explode(F.array_compact(F.array(F.struct(chunk.alias("chunk"), F.lit(2).alias("kind")), also))))
    placed = written(placed.select(*rows.columns, "_at.chunk", "_at.kind").withColumn("state", F.lit(None).cast(_STATE)), "placed")
    done = [passed(placed)]
    states = done[0].where("event_id is null").select("component", "chunk", "before", "after", F.lit(0).alias("version"))
    states = written(states, "states")
    counts = [states.count()]
    while True:
        wrong = written(_seams(states), "wrong")
        if not (n := wrong.count()):
            dropped(wrong)
            break
        counts.append(n)
        own = placed.where("kind = 2").join(wrong.select("component", "chunk").hint("merge"), ["component", "chunk"], "left_semi")
        seeds = wrong.select(*(F.col(c) if c in wrong.columns else F.lit(0).alias(c) if c == "kind" else F.lit(None).cast(kind).alias(c) for c, kind in own.dtypes))
        done.append(passed(own.unionByName(seeds)))
        new = done[-1].where("event_id is null").select("component", "chunk", "before", "after", F.lit(len(done) - 1).alias("version"))
        kept = states.join(wrong.select("component", "chunk").hint("merge"), ["component", "chunk"], "left_anti")
        old, states = states, written(kept.unionByName(new), "states")
        dropped(old)
        dropped(wrong)
    if report is not None:
        report[:] = counts
    if len(done) == 1:
        out = done[0].where("event_id is not null")
    else:
        last = states.select("component", "chunk", "version").hint("merge")
        every = [d.where("event_id is not null").withColumn("version", F.lit(v)) for v, d in enumerate(done)]
        union = every[0]
        for d in every[1:]:
            union = union.unionByName(d)
        out = union.join(last, ["component", "chunk", "version"])
    return out.select("event_id", "token_address", "price_in_usdc", "usdc_volume", "direct", F.timestamp_micros("micros").alias("block_timestamp"))


def graph_rows(swaps: DataFrame, numeraire: str, label: DataFrame | None = None, keep: str | None = None) -> DataFrame:
    """The rows of the inference: direct prices of tokens that occur in an indirect swap, and
    the indirect swaps, each with its component. label: (token, component) if it is known; keep:
    a column that stays."""
    direct = direct_prices(swaps, numeraire)
    # only the token columns are read for the graph
    cross = swaps.where((F.col("token0") != numeraire) & (F.col("token1") != numeraire))
    if label is None:
        label = components(cross.select(F.col("token0").alias("a"), F.col("token1").alias("b")))
    own = lambda amount, dec: F.abs(F.col(amount)) / F.pow(F.lit(10.0), F.col(dec))
    # label is one row a token, written: Spark broadcasts it by its true size
    d = direct.join(label, direct.token_address == label.token).select(
        "component", "block_timestamp", "block_number", "event_id", F.lit(True).alias("direct"), F.col("token_address").alias("token0"), F.lit("").alias("token1"),
        F.lit(0.0).alias("amount0"), F.lit(0.0).alias("amount1"), F.col("price_in_usdc").alias("price"), F.col("usdc_volume").alias("volume"),
    )
    x = cross.join(label, cross.token0 == label.token).select(
        "component", "block_timestamp", "block_number", "event_id", F.lit(False).alias("direct"), "token0", "token1",
        own("amount0", "token0_decimals").alias("amount0"), own("amount1", "token1_decimals").alias("amount1"), F.lit(0.0).alias("price"), F.lit(0.0).alias("volume"),
    )
    return d.unionByName(x).withColumn("micros", F.unix_micros("block_timestamp")).drop(*({"block_timestamp"} - {keep}))


def indirect_prices(swaps: DataFrame, numeraire: str, ttl_s: float = 3600.0, chunk_s: float | None = None, report: list[int] | None = None) -> DataFrame:
    """(event_id, token_address, price_in_usdc, usdc_volume, direct, block_timestamp). Only
    tokens that occur in an indirect swap enter; the others have their direct prices already.
    Swaps with an amount of 0 or tokens without a fresh price give nothing."""
    if not hasattr(swaps, "_written_path"):
        # words are decoded once, not for the graph and the rows each
        swaps = written(swaps.select(*ORDER, "pool", "token0", "token1", "amount0", "amount1", "token0_decimals", "token1_decimals"), "swaps")
    return in_chunks(graph_rows(swaps, numeraire), ttl_s, chunk_s, report)
