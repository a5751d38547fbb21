"""Sharding by sampled splitters (operator 9), in DataFrame operations only.

Law `bytes`: shard sizes are near equal. Records are ordered by (hash of text, hash
of doc_id, record number): equal texts are neighbours, and a group of equal texts of
any size can still be cut. Steps:

1. A size-weighted sample of keys, of about RANGES * PER_RANGE rows at any input
   size, gives quantile boundaries of RANGES ranges, many more than shards.
2. Records are range-partitioned by them; the true size of each range is summed.
3. The ideal cuts between shards (equal steps of bytes) fall inside some ranges.
   Those ranges are overfull and are subdivided where the cut falls, by running
   sums inside the range.

A record's shard is floor(bytes before its middle * shards / all bytes) in key order,
so a shard is off the ideal by at most about one record at either end. Nothing but
the keys (hashes, sizes) moves; a range is about 1 / RANGES of the bytes.

Defined cases: null text counts 8 bytes, crc 0; repeated rows are records of their
own; null doc_id is kept; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import written

SHARDS = 24
RANGES = 384
#: A range should not be larger than this: more bytes take more ranges, up to MOST_RANGES
#: (a row of the table of splitters, which each task holds).
RANGE_BYTES, MOST_RANGES = 256 << 20, 24 * 2048
#: Sampled keys a range: their total bounds the one sort that is not distributed.
PER_RANGE = 24


def ranges_for(total: int) -> int:
    return min(MOST_RANGES, max(RANGES, -(-total // RANGE_BYTES)))


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _key(value: Column) -> Column:
    """The first 60 bits of the MD5 of a string; null is the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(value, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def range_number(key: tuple[Column, ...], splitters: list[tuple[int, ...]]) -> Column:
    """How many splitters (sorted) are <= key, by binary search in an array constant."""
    if not splitters:
        return F.lit(0)
    own = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)))
    table = F.array(*(F.struct(*(F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(at))) for at in splitters))
    steps = [1 << i for i in reversed(range(len(splitters).bit_length()))]
    higher = lambda at, step: F.when(F.coalesce(own >= F.get(table, at + step - 1), F.lit(False)), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), higher)


def sampled_splitters(records: DataFrame, ranges: int | None = None) -> list[tuple[int, ...]]:
    """Quantile boundaries of a size-weighted sample of the keys (h, g, n)."""
    total = records.agg(F.sum("size")).first()[0] or 0
    ranges = ranges_for(total) if ranges is None else ranges
    wanted = ranges * PER_RANGE
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(total, 1)))
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "g", "n"), 11).cast("double") / float(1 << 53)
    # a record above the mean step stands for as many steps as it spans
    weight = F.greatest(F.lit(1.0), F.col("size") * F.lit(wanted / max(total, 1)))
    sample = records.where(drawn < chance).select("h", "g", "n", weight.alias("w"))
    run = F.sum("w").over(Window.orderBy("h", "g", "n"))
    whole = F.sum("w").over(Window.orderBy("h", "g", "n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = sample.select("h", "g", "n", F.floor(run * ranges / whole).cast("int").alias("q"))
    cuts = ranked.where((F.col("q") > 0) & (F.col("q") < ranges)).groupBy("q").agg(F.min(F.struct("h", "g", "n")).alias("k"))
    return sorted({tuple(r.k) for r in cuts.collect()})


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of docs."""
    return placed_rows(docs, F.monotonically_increasing_id(), shards, id_col, text_col).drop("n")


def placed_rows(docs: DataFrame, number: Column, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As assign(), with n, the number that `number` gives each row."""
    text = F.col(text_col)
    records = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), record_size(text).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"), _key(text).alias("h"), _key(F.col(id_col).cast("string")).alias("g"),
            number.alias("n"),
        ),
        "records",
    )
    ranged = records.withColumn("range", range_number((F.col("h"), F.col("g"), F.col("n")), sampled_splitters(records)))
    ranged = written(ranged, "ranged")
    # at most RANGES rows
    sums = written(ranged.groupBy("range").agg(F.sum("size").alias("bytes")), "ranges")
    order = Window.orderBy("range")
    total = F.sum("bytes").over(Window.partitionBy())
    sums = sums.select("range", (F.sum("bytes").over(order) - F.col("bytes")).alias("base"), total.alias("total"))
    inside = Window.partitionBy("range").orderBy("h", "g", "n")
    middle = F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    placed = ranged.join(F.broadcast(sums), "range").select(
        "doc_id", "size", "text_crc32", "range", "h", "g", "n",
        F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("total"))).cast("int").alias("shard"),
    )
    placed = written(placed, "placed")
    # slots: rows of the shard in earlier ranges, then the place in the own range
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("rows"))
    counts = counts.select("shard", "range", (F.sum("rows").over(Window.partitionBy("shard").orderBy("range")) - F.col("rows")).alias("slot_base"))
    own = F.row_number().over(Window.partitionBy("shard", "range").orderBy("h", "g", "n")) - 1
    slotted = placed.withColumn("own", own)
    return slotted.join(F.broadcast(counts), ["shard", "range"]).select("n", "doc_id", "size", "text_crc32", "shard", (F.col("slot_base") + F.col("own")).cast("long").alias("slot"))


def report(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
