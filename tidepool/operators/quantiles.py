"""Exact quantiles of many columns at once, in a few passes and without a sort.

A pass counts the values of each column around two bounds and sketches those between; the
counts are exact, so they tell which values a rank lies between, and the sketch gives closer
bounds, about a hundredth of the values apart. When few values are left between the bounds of
every column, they are gathered and the rank is read off. So a column of ten million values
takes three passes, one of a billion four, for all columns, quantiles and keys together; no
task holds more than FEW values of a column of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.tables import written

#: Values that are gathered, at most.
FEW = 20_000
#: Bounds of a sketch, and its accuracy: an error is a small part of the space between two.
CUTS, ACCURACY = 256, 4096


def _cuts(x: Column) -> Column:
    return F.percentile_approx(x, [i / CUTS for i in range(CUTS + 1)], ACCURACY)


def _bounds(cuts: Column, rank: Column, n: Column) -> tuple[Column, Column]:
    """Two cuts that hold the value of a rank between n sketched values."""
    at = F.floor(rank * CUTS / F.greatest(n, F.lit(1))).cast("int")
    return F.get(cuts, F.greatest(at - 1, F.lit(0))), F.get(cuts, F.least(at + 2, F.lit(CUTS)))


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, column, q, n, value): the quantile of the values that are not null, between
    neighbours by linear interpolation; null if there are none. df is read again in each pass:
    write what is costly first."""
    keys = keys or []
    targets = [(c, q) for c in columns for q in qs]
    data = df.select(*keys, *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    x = lambda i: F.col(f"x{columns.index(targets[i][0])}")
    one = data.groupBy(*keys).agg(*(F.count(f"x{i}").alias(f"n{i}") for i in range(len(columns))), *(_cuts(F.col(f"x{i}")).alias(f"c{i}") for i in range(len(columns))))
    state = []
    for i, (c, q) in enumerate(targets):
        n, cuts = F.col(f"n{columns.index(c)}"), F.col(f"c{columns.index(c)}")
        rank = F.floor((n - 1) * F.lit(q))
        low, high = _bounds(cuts, rank, n)
        state += [n.alias(f"size{i}"), rank.alias(f"k{i}"), low.alias(f"lo{i}"), high.alias(f"hi{i}")]
    known = written(one.select(*keys, *state), "bounds")

    def beside() -> DataFrame:
        if not keys:
            return data.crossJoin(F.broadcast(known))  # one row
        names = known.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in known.columns if c not in keys))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return data.join(names, same).drop(*(f"_{k}" for k in keys))

    every = range(len(targets))
    carry = lambda: [F.first(c).alias(c) for c in known.columns if c not in keys]
    while True:
        inside = lambda i: F.when((x(i) > F.col(f"lo{i}")) & (x(i) < F.col(f"hi{i}")), x(i))
        counts = beside().groupBy(*keys).agg(
            *carry(),
            *(e.alias(f"{name}{i}") for i in every for name, e in (
                ("below", F.count_if(x(i) < F.col(f"lo{i}"))), ("upto", F.count_if(x(i) <= F.col(f"lo{i}"))), ("before", F.count_if(x(i) < F.col(f"hi{i}"))),
                ("through", F.count_if(x(i) <= F.col(f"hi{i}"))), ("after", F.min(F.when(x(i) > F.col(f"hi{i}"), x(i)))),
            )),
        )
        counts = written(counts, "counts")
        between = lambda i: F.col(f"before{i}") - F.col(f"upto{i}")
        # a rank that falls on a bound itself needs no look between
        open_ = lambda i: (F.col(f"k{i}") >= F.col(f"upto{i}")) & (F.col(f"k{i}") < F.col(f"before{i}")) & (between(i) > FEW)
        if not counts.agg(*(F.coalesce(F.max(open_(i)), F.lit(False)).alias(f"o{i}") for i in every)).select(F.exists(F.array(*(f"o{i}" for i in every)), lambda o: o)).first()[0]:
            break
        # only where many values are left between the bounds are they sketched again
        known, closer = counts, []
        counts = beside().groupBy(*keys).agg(*carry(), *(_cuts(F.when(open_(i), inside(i))).alias(f"cuts{i}") for i in every))
        for i in every:
            low, high = _bounds(F.col(f"cuts{i}"), F.col(f"k{i}") - F.col(f"upto{i}"), between(i))
            closer += [f"size{i}", f"k{i}", F.when(open_(i), low).otherwise(F.col(f"lo{i}")).alias(f"lo{i}"), F.when(open_(i), high).otherwise(F.col(f"hi{i}")).alias(f"hi{i}")]
        known = written(counts.select(*keys, *closer), "bounds")
    known = counts
    few = lambda i: F.when((x(i) > F.col(f"lo{i}")) & (x(i) < F.col(f"hi{i}")) & (between(i) <= FEW), x(i))
    lists = beside().groupBy(*keys).agg(*carry(), *(F.sort_array(F.collect_list(few(i))).alias(f"l{i}") for i in every))
    out = []
    for i, (c, q) in enumerate(targets):
        k, low, high, own = F.col(f"k{i}"), F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"l{i}")

        def at(rank: Column) -> Column:
            """The value of a rank: a bound, one of those between, or the next one behind."""
            return (
                F.when(rank < F.col(f"upto{i}"), low).when(rank < F.col(f"before{i}"), F.get(own, (rank - F.col(f"upto{i}")).cast("int")))
                .when(rank < F.col(f"through{i}"), high).otherwise(F.col(f"after{i}"))
            )

        part = (F.col(f"size{i}") - 1) * F.lit(q) - k
        value = F.when(F.col(f"size{i}") > 0, F.when(part > 0, at(k) + part * (at(k + 1) - at(k))).otherwise(at(k)))
        out.append(F.struct(F.lit(c).alias("column"), F.lit(q).alias("q"), F.coalesce(f"size{i}", F.lit(0)).alias("n"), value.alias("value")))
    return lists.select(*keys, F.explode(F.array(*out)).alias("_o")).select(*keys, "_o.*")
