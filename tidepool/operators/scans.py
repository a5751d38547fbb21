"""Running values over unbounded windows of keys of any size: a segmented scan.

Rows are in deterministic ranges of (key, order). A range is windowed on its own, its total
is one row a key and range, an exclusive scan of these totals gives what each range starts
with, and both are put together. So a key with a large share of all rows is dealt over as many
tasks as it has ranges, and the result is that of one window by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.operators.ranges import RANGES, with_range
from tidepool.operators.tables import written

#: Rows of a range, about, beyond RANGES of them.
RANGE_ROWS = 1_000_000


@dataclass
class Running:
    """What runs along the order: the sum, count, max, min, or the first or last value that is
    not null. own: the row itself counts too."""

    kind: str
    value: Column
    own: bool = True


def total(value: Column | str, own: bool = True) -> Running:
    return Running("sum", F.col(value) if isinstance(value, str) else value, own)


def latest(value: Column | str, own: bool = True) -> Running:
    return Running("last", F.col(value) if isinstance(value, str) else value, own)


def first(value: Column | str) -> Running:
    return Running("first", F.col(value) if isinstance(value, str) else value)


def most(value: Column | str, own: bool = True) -> Running:
    return Running("max", F.col(value) if isinstance(value, str) else value, own)


def least(value: Column | str, own: bool = True) -> Running:
    return Running("min", F.col(value) if isinstance(value, str) else value, own)


def _over(kind: str, x: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True)}[kind](x)


def _whole(kind: str, x: Column, order: Column) -> Column:
    seen = F.when(x.isNotNull(), order)
    return {"sum": F.sum(x), "max": F.max(x), "min": F.min(x), "last": F.max_by(x, seen), "first": F.min_by(x, seen)}[kind]


def _joined(kind: str, before: Column, inside: Column) -> Column:
    return {
        "sum": F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(before + inside), "max": F.greatest(before, inside), "min": F.least(before, inside),
        "last": F.coalesce(inside, before), "first": F.coalesce(before, inside),
    }[kind]


def carried(df: DataFrame, keys: list[str], order: list[str], **columns: Running) -> DataFrame:
    """df with the running columns. Keys may be none: then all rows are one. The input is
    written once, so that every use of it sees the same rows and ranges."""
    named = {f"_x{i}": r.value for i, r in enumerate(columns.values())}
    rows = written(df.withColumns(named), "scan")
    parts = with_range(rows, *keys, *order, ranges=max(RANGES, rows.count() // RANGE_ROWS))
    inner = Window.partitionBy(*keys, "_range").orderBy(*order)
    frames = {own: inner.rowsBetween(Window.unboundedPreceding, 0 if own else -1) for own in (True, False)}
    local = parts.withColumns({f"_l{i}": _over(r.kind, F.col(f"_x{i}")).over(frames[r.own]) for i, r in enumerate(columns.values())})
    at = F.struct(*order)
    totals = parts.groupBy(*keys, "_range").agg(*(_whole(r.kind, F.col(f"_x{i}"), at).alias(f"_t{i}") for i, r in enumerate(columns.values())))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_r"), *(_over(r.kind, F.col(f"_t{i}")).over(before).alias(f"_b{i}") for i, r in enumerate(columns.values())))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = local.join(starts, same).withColumns({name: _joined(r.kind, F.col(f"_b{i}"), F.col(f"_l{i}")) for i, (name, r) in enumerate(columns.items())})
    return out.select(*(c for c in df.columns if c not in columns), *columns)
