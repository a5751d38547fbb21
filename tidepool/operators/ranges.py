"""Global and per-key order without one task for a whole key: deterministic ranges from
a bounded sample, row numbers from range offsets, and row blocks with margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.operators.tables import written

RANGES = 64
#: Sampled keys a range: with RANGES it bounds what the driver sorts.
PER_RANGE = 32
#: Rows of a block of a key, at most.
BLOCK_ROWS = 100_000


def reached(kinds: dict[str, str], order: tuple[str, ...], cut: tuple) -> Column:
    """Whether a row is not before cut in the order, of columns of these kinds; a null is before
    all values, and null here is no."""
    out = None
    for c, v in reversed(list(zip(order, cut))):
        value = F.lit(v).cast(kinds[c])
        out = F.col(c) >= value if out is None else (F.col(c) > value) | ((F.col(c) == value) & out)
    return out


def with_range(df: DataFrame, *order: str, ranges: int = RANGES) -> DataFrame:
    """df with _range: which of about `ranges` ranges of the order a row is in. The splitters
    are constants from a sample by hash, so every use of the result sees the same ranges
    (two range exchanges would sample anew). df is written first, if it is not read from what
    was written: its count, its sample and its use must be of the same rows."""
    if not hasattr(df, "_written_path"):
        df = written(df, "ranged")
    n = df.count()
    drawn = F.shiftrightunsigned(F.xxhash64(*order, F.lit(17)), 11).cast("double") / float(1 << 53)
    sample = sorted({tuple(r) for r in df.select(*order).dropna().where(drawn < ranges * PER_RANGE / max(n, 1)).collect()})
    cuts = sample[:: max(1, -(-len(sample) // ranges))][1:]
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    kinds = dict(df.dtypes)

    def search(low: int, high: int) -> Column:
        """How many cuts a row has reached, known to be from low to high: halved by comparisons that
        are compiled, not by a lambda over an array, which is interpreted row by row."""
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(reached(kinds, order, cuts[middle - 1]), search(middle, high)).otherwise(search(low, middle - 1))

    place = search(0, len(cuts))
    return df.withColumn("_range", place)


def numbered(df: DataFrame, *order: str, out: str = "row", ranges: int = RANGES) -> DataFrame:
    """0-based row numbers in a global order: the rows of earlier ranges plus the place
    in the own one. The offsets are one row a range."""
    parts = with_range(df, *order, ranges=ranges)
    counts = parts.groupBy("_range").agg(F.count("*").alias("_c"))
    offsets = counts.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return parts.withColumn("_i", own).join(F.broadcast(offsets), "_range").withColumn(out, (F.col("_o") + F.col("_i")).cast("long")).drop("_range", "_i", "_o")


def numbered_in_key(df: DataFrame, key: str, *order: str, out: str = "r", ranges: int = RANGES) -> DataFrame:
    """0-based row numbers by key, and n, the rows of the key; a key may span ranges. Offsets
    are one row for each key and range it is in."""
    parts = with_range(df, key, *order, ranges=ranges)
    counts = parts.groupBy(key, "_range").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(key)
    offsets = counts.select(key, "_range", (F.sum("_c").over(w.orderBy("_range")) - F.col("_c")).alias("_o"), F.sum("_c").over(w).alias("n"))
    own = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1
    return parts.withColumn("_i", own).join(offsets, [key, "_range"]).withColumn(out, (F.col("_o") + F.col("_i")).cast("long")).drop("_range", "_i", "_o")


def row_blocks(df: DataFrame, key: str, *order: str, before: int = 0, after: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """df in blocks of `size` rows of a key, for window functions that look at most `before`
    rows back and `after` ahead: columns r, n, block and own. Rows near a block's end are
    there twice, as margins of the next block, where own is false. Window by (key, block),
    then keep the own rows: the result is that of a window by key, but a key with very many
    rows is dealt over tasks."""
    size = max(size, before, after, 1)
    rows = numbered_in_key(df, key, *order)
    block = F.floor(F.col("r") / size)
    place = F.col("r") - block * size
    also = F.array_compact(F.array(block, F.when(place >= size - before, block + 1), F.when((place < after) & (block > 0), block - 1)))
    out = rows.withColumn("_home", block).withColumn("block", F.explode(also))
    return out.withColumn("own", F.col("block") == F.col("_home")).drop("_home")
