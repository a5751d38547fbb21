"""Exact top-k search with MaxScore (operator 2).

Terms are the dimensions. A shard keeps one posting list per term for each run of at most
BLOCK_ROWS rows, and the least and greatest value in it. For a query q the contribution
of term d is q_d * x_d minus its least possible value in the run, so contributions are 0
or more and bounded. Terms are split by these bounds: as many terms of small bound as
stay, together, below the threshold are non-essential. Essential postings are traversed,
and the other terms, of largest bound first, are probed only for rows that are still
competitive.

The threshold is the k-th best score known so far. It is seeded: first, all queries meet
one bounded run of rows (SEED_ROWS by hash of vec_id; any rows will do), so that every
later run starts with a threshold. Shards' results are merged by rank.

Work is dealt as (block of queries) x (shard of rows), both by hash of vec_id, of
bounded expected size: each pair is one key of a shuffle and is streamed in order,
queries first. Nothing passes the driver or a broadcast, and any number of queries runs
in one job.

Components are floor(256 * x), x as double. Scores are integer inner products; they
are worked out in doubles where these are exact (all sums below 2^53), else in 64-bit
integers.

Defined cases: vectors that are null, or hold null, NaN or infinite components, and
rows with null vec_id take no part; vectors of unequal length are as if padded with
0; a row is no candidate for a query of the same vec_id; rows of equal vec_id and
score count once; ties go to the smaller vec_id; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import written

K = 5
QUERY_STEP = 50
#: Queries of a block, rows of a shard, and rows that seed the thresholds, on average.
QUERY_BLOCK, SHARD_ROWS, SEED_ROWS = 2048, 8192, 2048
#: Rows of one run of posting lists, at most.
BLOCK_ROWS = 2048
#: Non-essential terms are probed in this many steps.
PROBES = 3


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part, identical rows once."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * 256)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width` numbers, padded with 0."""
    lengths = pyarrow.compute.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy()
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    for i, (start, n) in enumerate(zip(np.cumsum(lengths) - lengths, lengths)):
        out[i, : min(n, width)] = flat[start : start + min(n, width)]
    return out


class Shard:
    """Posting lists of a run of distinct rows: terms x rows, with the bounds of each term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.postings = np.ascontiguousarray(rows[order].T)
        self.low, self.high = self.postings.min(1), self.postings.max(1)
        #: (searches, terms of all of them, terms that were essential)
        self.told = np.zeros(3, np.int64)

    def search(self, query: np.ndarray, own: int, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of rows that can be among the k best; all scores that are
        at least `threshold` and among this run's k best are there."""
        ends = np.stack([query * self.low, query * self.high])
        least, bound = ends.min(0), np.abs(ends[0] - ends[1])
        order = np.argsort(-bound, kind="stable")
        # what the terms from here on add at most, beyond the least of all terms
        left = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        base = least.sum()
        # essential: until the rest alone can't reach the threshold
        essential = int(np.searchsorted(-left, base - threshold, "right")) if threshold > -np.inf else len(order)
        essential = min(max(essential, 1), len(order))
        self.told += (1, len(order), essential)
        score = query[order[:essential]] @ self.postings[order[:essential]]
        alive = np.arange(len(self.ids))
        at = essential
        while True:
            if threshold > -np.inf:
                stay = score + (least[order[at:]].sum() + left[at]) >= threshold
                alive, score = alive[stay], score[stay]
            if at >= len(order) or not len(alive):
                break
            to = min(len(order), at + max(1, -(-(len(order) - essential) // PROBES)))
            terms = order[at:to]
            score = score + query[terms] @ self.postings[np.ix_(terms, alive)]
            at = to
        ids = self.ids[alive]
        other = ids != own
        ids, score = ids[other], score[other]
        if len(ids) > k:
            best = np.partition(score, len(score) - k)[len(score) - k]
            # rows are in order of id: all above the k-th best, then the smallest ids at it
            above, equal = np.flatnonzero(score > best), np.flatnonzero(score == best)
            pick = np.concatenate([above, equal[: k - len(above)]])
            ids, score = ids[pick], score[pick]
        return ids, score


class Block:
    """A block of queries with what they have found so far; floor: of each query a score
    that k rows are known to reach."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array, floor: np.ndarray, k: int) -> None:
        lengths = pyarrow.compute.list_value_length(vectors).to_numpy()
        self.ids, self.k = ids, k
        # a row's dimensions beyond the widest query meet only zeros
        self.q = matrix(vectors, max(1, int(lengths.max(initial=0))))
        self.floor = floor.astype(np.float64)
        self.best_ids = [np.empty(0, np.int64)] * len(ids)
        self.best = [np.empty(0, np.int64)] * len(ids)
        self.told = np.zeros(3, np.int64)

    def take(self, ids: np.ndarray, vectors: pa.Array) -> None:
        rows = matrix(vectors, self.q.shape[1])
        exact = rows.shape[1] * max(1, float(np.abs(self.q).max(initial=0))) * float(np.abs(rows).max(initial=0)) < 2**53
        kind = np.float64 if exact else np.int64
        shard = Shard(ids, rows.astype(kind))
        for i, query in enumerate(self.q.astype(kind)):
            threshold = max(self.floor[i], float(self.best[i][-1]) if len(self.best[i]) >= self.k else -np.inf)
            if not exact and threshold > -np.inf:
                threshold = int(np.nextafter(threshold, -np.inf))  # a double may be above the sum it stands for
            found, score = shard.search(query, int(self.ids[i]), self.k, threshold)
            if len(found):
                ids_i, score_i = np.concatenate([self.best_ids[i], found]), np.concatenate([self.best[i], score.astype(np.int64)])
                order = np.lexsort((ids_i, -score_i))
                ids_i, score_i = ids_i[order], score_i[order]
                # rows of equal vec_id and score count once
                new = np.ones(len(ids_i), bool)
                new[1:] = (ids_i[1:] != ids_i[:-1]) | (score_i[1:] != score_i[:-1])
                self.best_ids[i], self.best[i] = ids_i[new][: self.k], score_i[new][: self.k]
        self.told += shard.told

    def found(self) -> pa.RecordBatch:
        sizes = [len(x) for x in self.best]
        ids, best = (np.concatenate([np.empty(0, np.int64), *x]) for x in (self.best_ids, self.best))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, sizes)), pa.array(ids), pa.array(best)], ["query_id", "vec_id", "score"])


def _search(k: int):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cell, row, vec_id, v, floor) sorted by cell, the queries of a cell (row
        false) first."""
        cell, block, held = None, None, []

        def cut(part: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
            """Runs of equal cell and kind."""
            cells, kinds = part.column("cell").to_numpy(), part.column("row").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((np.diff(cells) != 0) | (kinds[1:] != kinds[:-1])) + 1
            for start, end in zip([0, *edge.tolist()], [*edge.tolist(), len(cells)]):
                if end > start:
                    yield int(cells[start]), bool(kinds[start]), part.slice(start, end - start)

        for batch in batches:
            for at, is_row, part in cut(batch):
                if at != cell:
                    if block is not None:
                        yield block.found()
                    cell, block, held = at, None, []
                if not is_row:
                    held.append(part)
                    continue
                if block is None:
                    if not held:
                        continue
                    queries = pa.Table.from_batches(held).combine_chunks()
                    flat = queries.column("v").combine_chunks()
                    floor = queries.column("floor").to_numpy()
                    block = Block(queries.column("vec_id").to_numpy(), flat, np.where(np.isnan(floor), -np.inf, floor), k)
                for start in range(0, part.num_rows, BLOCK_ROWS):
                    run = part.slice(start, BLOCK_ROWS)
                    block.take(run.column("vec_id").to_numpy(), run.column("v"))
        if block is not None:
            yield block.found()

    return scan


def _met(rows: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of each shard. queries has floor."""
    hashed = lambda n: F.pmod(F.xxhash64(F.lit("deal"), "vec_id"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # cell: block of queries * shards + shard of rows
    q = queries.select("vec_id", "v", "floor", hashed(blocks).alias("b"), each(shards).alias("s")).withColumn("row", F.lit(False))
    r = rows.select("vec_id", "v", F.lit(None).cast("double").alias("floor"), each(blocks).alias("b"), hashed(shards).alias("s")).withColumn("row", F.lit(True))
    dealt = q.unionByName(r).select((F.col("b") * shards + F.col("s")).cast("long").alias("cell"), "row", "vec_id", "v", "floor")
    return dealt.repartition("cell").sortWithinPartitions("cell", "row").mapInArrow(_search(k), "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of each query. rows and
    queries have vec_id and v, as quantised() gives them."""
    rows, queries = written(rows.distinct(), "vectors"), written(queries.distinct(), "queries")
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // QUERY_BLOCK))
    # a bounded run of rows, by hash: their k-th best score is a threshold for all
    share = min(1.0, SEED_ROWS / max(n, 1))
    some = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit("seed"), "vec_id"), 11).cast("double") / float(1 << 53) < share)
    queries = queries.withColumn("floor", F.lit(None).cast("double"))
    seeded = _ranked(_met(some, queries, 1, blocks, k), k).where(F.col("rank") == k)
    seeded = written(seeded.groupBy("query_id").agg(F.max("score").cast("double").alias("known")), "seeded")
    queries = queries.hint("merge").join(seeded.hint("merge"), queries.vec_id == seeded.query_id, "left").select("vec_id", "v", F.col("known").alias("floor"))
    found = written(_met(rows, written(queries, "queries"), shards, blocks, k), "topk")
    return _ranked(found, k)


def report(vectors: DataFrame) -> DataFrame:
    """The K best rows for each query, the rows whose vec_id is divisible by QUERY_STEP."""
    rows = quantised(vectors)
    return search(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0))
