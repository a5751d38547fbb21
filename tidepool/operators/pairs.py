"""The k most or least similar pairs of vectors, exactly, without looking at all pairs (K5, M11,
J10).

Angles obey the triangle inequality. Vectors are put into blocks of near ones (by their nearest
pivot and the angle to it), and a block keeps the least and greatest angle to every pivot.
The pairs inside blocks come first; their k-th best is a threshold. Two blocks whose bounds
exclude a pair as good as that are never compared. Blocks are dealt in a bounded number of groups;
a task has two of them, compares the pairs of blocks that are still open, best first, and only its k
best pairs go on. Clustered vectors leave few pairs of blocks; for
vectors without any structure the bounds exclude little and the work is that of all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.numbers import norm
from tidepool.operators.ranges import numbered_in_key
from tidepool.operators.tables import written

PIVOTS = 16
#: Rows of a block, at least; and blocks in all, about: their bounds are a broadcast.
BLOCK_ROWS, MOST_BLOCKS = 1024, 20_000
#: Groups of blocks, unless a group would have more rows than a task may hold: a row goes once
#: to each group, so up to GROUPS * GROUP_ROWS rows what is shuffled grows with the rows.
GROUPS, GROUP_ROWS = 24, 65_536
#: Room for rounding in the comparison of bounds.
SLACK = 1e-9


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def _located(pivots: np.ndarray):  # noqa: ANN202
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                a = angles(np.stack(pdf["u"].to_numpy()), pivots)
                near = a.argmin(1)
                yield pd.DataFrame({"id": pdf["id"], "u": pdf["u"], "pivot": near, "near": a[np.arange(len(a)), near], "angle": list(a)})

    return scan


def _best(a_id: np.ndarray, a: np.ndarray, b_id: np.ndarray | None, b: np.ndarray | None, k: int, most: bool) -> pd.DataFrame:
    """The k best pairs between two blocks, or inside one; ties to the smaller ids."""
    if b is None:
        cos, (i, j) = a @ a.T, np.triu_indices(len(a), 1)
        x, y, cos = a_id[i], a_id[j], cos[i, j]
    else:
        x, y, cos = np.repeat(a_id, len(b)), np.tile(b_id, len(a)), (a @ b.T).ravel()
    order = -cos if most else cos
    if len(order) > k:
        keep = order <= np.partition(order, k - 1)[k - 1]
        x, y, cos, order = x[keep], y[keep], cos[keep], order[keep]
    low, high = np.minimum(x, y), np.maximum(x, y)
    top = np.lexsort((high, low, order))[:k]
    return pd.DataFrame({"a": low[top], "b": high[top], "cos": cos[top]})


def _inside(k: int, most: bool):  # noqa: ANN202
    return lambda pdf: _best(pdf["id"].to_numpy(), np.stack(pdf["u"].to_numpy()), None, None, k, most)


def _topped(found: pd.DataFrame, k: int, most: bool) -> pd.DataFrame:
    return found.sort_values(["cos", "a", "b"], ascending=[not most, True, True], kind="stable").head(k)


def _between(low: np.ndarray, high: np.ndarray, bar: float, k: int, most: bool):  # noqa: ANN202
    """Of two groups of blocks, or one with itself, the k best pairs between different blocks;
    the bar rises with what is found, and blocks that can't reach it are skipped."""

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = key
        u, ids = np.stack(pdf["u"].to_numpy()), pdf["id"].to_numpy()
        places = pdf.groupby("at").indices
        sides = [[at for at in places if pdf["group"].iat[places[at][0]] == side] for side in (p, q)]
        edge, found = bar, pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "cos": pd.Series([], dtype="float64")})
        for at in sides[0]:
            to = np.array([o for o in sides[1] if o > at or p != q], "int64")
            if not len(to):
                continue
            can = reachable(low, high, at, most)[to]
            near, x = np.argsort(-can if most else can, kind="stable"), u[places[at]]
            for o, reach in zip(to[near], can[near]):
                if (reach < edge - SLACK) if most else (reach > edge + SLACK):
                    break
                cos = x @ u[places[o]].T
                i, j = np.nonzero(cos >= edge if most else cos <= edge)
                if not len(i):
                    continue
                c = cos[i, j]
                if len(c) > k:
                    order = -c if most else c
                    keep = order <= np.partition(order, k - 1)[k - 1]
                    i, j, c = i[keep], j[keep], c[keep]
                a, b = ids[places[at]][i], ids[places[o]][j]
                found = _topped(pd.concat([found, pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cos": c})]), k, most)
                if len(found) == k:
                    edge = max(edge, found["cos"].iat[-1]) if most else min(edge, found["cos"].iat[-1])
        return found

    return best


def reachable(low: np.ndarray, high: np.ndarray, at: int, most: bool) -> np.ndarray:
    """The best cosine that a vector of block `at` can have with one of each block, by the
    angles to the pivots (blocks x pivots)."""
    if most:
        gap = np.maximum(0.0, np.maximum(low[at] - high, low - high[at])).max(1)
        return np.cos(gap)
    far = np.minimum(np.pi, np.minimum(high[at] + high, 2 * np.pi - (low[at] + low))).min(1)
    return np.cos(far)


@dataclass
class Blocks:
    """Unit vectors in blocks: placed (id, u, at), the least and greatest angle of each block to
    each pivot, and how many blocks a group has."""

    placed: DataFrame
    low: np.ndarray
    high: np.ndarray
    size: int


def in_vector_blocks(df: DataFrame, id_col: str = "vec_id", column: str = "embedding", block: int = BLOCK_ROWS) -> Blocks | None:
    """The vectors that are not null or of norm 0 in blocks of near ones, neighbouring blocks in
    groups; None for fewer than two. Serves any number of similar_pairs."""
    n_ = norm(F.col(column))
    rows = written(df.where(n_ > 0).select(F.col(id_col).cast("long").alias("id"), F.transform(column, lambda x: x / n_).alias("u")), "units")
    n = rows.count()
    pivots = np.array([r.u for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()])
    if n < 2:
        return None
    located = written(rows.mapInPandas(_located(pivots), "id long, u array<double>, pivot long, near double, angle array<double>"), "located")
    size = max(block, -(-n // MOST_BLOCKS))
    placed = numbered_in_key(located, "pivot", "near", "id").withColumn("block", F.floor(F.col("r") / size))
    placed = written(placed.select("id", "u", "pivot", "block", "angle"), "placed")
    ends = [f(F.col("angle")[i]).alias(f"{m}{i}") for i in range(len(pivots)) for m, f in (("lo", F.min), ("hi", F.max))]
    bounds = placed.groupBy("pivot", "block").agg(*ends).toPandas().sort_values(["pivot", "block"])  # MOST_BLOCKS rows, about
    low, high = (bounds[[f"{m}{i}" for i in range(len(pivots))]].to_numpy() for m in ("lo", "hi"))
    names = df.sparkSession.createDataFrame([(int(p), int(b), at) for at, (p, b) in enumerate(zip(bounds["pivot"], bounds["block"]))], "pivot long, block long, at int")
    at = written(placed.select("id", "u", "pivot", "block").hint("merge").join(names.hint("merge"), ["pivot", "block"]).select("id", "u", "at"), "at")
    groups = max(min(len(low), GROUPS), -(-n // GROUP_ROWS))
    return Blocks(at, low, high, -(-len(low) // groups))


def similar_pairs(df: DataFrame, k: int, most: bool = True, id_col: str = "vec_id", column: str = "embedding", block: int = BLOCK_ROWS, report: dict | None = None, blocks: Blocks | None = None) -> DataFrame:
    """(a, b, cos): the k most (or least) similar pairs a < b; ties to the smaller ids. Vectors
    that are null or of norm 0 take no part. report gets the numbers of pairs of blocks, in
    all and of those that the first bar leaves open. blocks: of in_vector_blocks, if they are
    made."""
    blocks = blocks or in_vector_blocks(df, id_col, column, block)
    kind = "a long, b long, cos double"
    if blocks is None:
        return df.sparkSession.createDataFrame([], kind)
    low, high, per = blocks.low, blocks.high, blocks.size
    own = written(blocks.placed.groupBy("at").applyInPandas(_inside(k, most), kind), "inside")
    better = F.desc("cos") if most else F.asc("cos")
    first = [r.cos for r in own.orderBy(better, "a", "b").limit(k).collect()]
    bar = first[-1] if len(first) == k else (-2.0 if most else 2.0)

    def open_(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in pdf["id"]:
                can = reachable(low, high, at, most)
                keep = np.flatnonzero((can >= bar - SLACK if most else can <= bar + SLACK) & (np.arange(len(low)) > at))
                q, n = np.unique(keep // per, return_counts=True)
                yield pd.DataFrame({"p": np.full(len(q), at // per), "q": q, "n": n})

    pairs = df.sparkSession.range(len(low)).repartition(min(len(low), 64)).mapInPandas(open_, "p long, q long, n long")
    pairs = written(pairs.groupBy("p", "q").agg(F.sum("n").alias("n")), "pairs")
    if report is not None:
        report.update(all=len(low) * (len(low) - 1) // 2, compared=pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    sides = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("group"))
    rows = blocks.placed.withColumn("group", F.floor(F.col("at") / per))
    met = sides.hint("broadcast").join(rows, "group").groupBy("p", "q").applyInPandas(_between(low, high, bar, k, most), kind)  # GROUPS^2 rows, about
    return own.unionByName(met).orderBy(better, "a", "b").limit(k)
