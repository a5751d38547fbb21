"""Embedding diagnostics (M5, M10 to M21, M24). Vectors are arrays; the work on pairs
runs over blocks, linear algebra over the d x d Gramian."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepool.functions.numbers import correlation, cosine, norm
from tidepool.operators.pairs import in_vector_blocks, similar_pairs


def doubles(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, F.transform(column, lambda x: x.cast("double")))


def norm_stats(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Statistics of the norms."""
    n = df.select(norm(F.col(column)).alias("n"))
    return n.agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("least"), F.max("n").alias("most"))


def units(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors over their norms; those of norm 0 stay."""
    n = norm(F.col(column))
    return df.withColumn("_n", n).withColumn(column, F.when(F.col("_n") > 0, F.transform(column, lambda x: x / F.col("_n"))).otherwise(F.col(column))).drop("_n")


def cosine_stats(df: DataFrame, column: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Number, mean, population deviation, least and most of the cosines of all pairs. The
    first three need no pairs:
    with U of unit rows, the cosines of all ordered pairs sum up to the square of the summed
    rows, and their squares to the squared entries of U'U. Vectors of norm 0 take no part."""
    found = gramians(units(df, column).where(norm(F.col(column)) > 0), column).get(None)
    row = (0, None, None)
    if found is not None and found[2] > 1:
        g, total, n = found
        pairs = n * (n - 1)
        mean = float(total @ total - n) / pairs
        row = (pairs // 2, mean, float(np.sqrt(max(0.0, (float((g * g).sum()) - n) / pairs - mean**2))))
    one = df.sparkSession.createDataFrame([row], "pairs long, mean double, std double")
    blocks = in_vector_blocks(df, id_col, column)
    for name, most in (("least", False), ("most", True)):
        # one row each
        one = one.join(F.broadcast(similar_pairs(df, 1, most, id_col, column, blocks=blocks).agg(F.max("cos").alias(name))))
    return one


def blocked_pairs(df: DataFrame, id_col: str = "vec_id", blocks: int = 8) -> DataFrame:
    """Pairs a < b by blocks: every row meets each pair of blocks it is in by
    equality, so work is dealt over blocks^2 / 2 keys. For pairwise statistics that are
    asked for all pairs."""
    b = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    rows = df.select(F.struct("*").alias("row"), b.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    key = F.struct(F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))
    left = rows.where("b <= o").select(key.alias("k"), F.col("row").alias("p"))
    right = rows.where("b >= o").select(key.alias("k"), F.col("row").alias("q"))
    pairs = left.hint("merge").join(right.hint("merge"), "k").where((F.col("k.x") != F.col("k.y")) | (F.col(f"p.{id_col}") < F.col(f"q.{id_col}")))
    swap = F.col(f"p.{id_col}") > F.col(f"q.{id_col}")
    return pairs.select(F.when(swap, F.col("q")).otherwise(F.col("p")).alias("a"), F.when(swap, F.col("p")).otherwise(F.col("q")).alias("b"))


def centroids(df: DataFrame, label: str = "label", column: str = "embedding") -> DataFrame:
    """M5: the mean vector of each class, by dimension."""
    per = df.where(F.col(label).isNotNull()).select(label, F.posexplode(column).alias("d", "x")).groupBy(label, "d").agg(F.avg("x").alias("x"))
    return per.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("centroid"))


def nearest_centroid(df: DataFrame, id_col: str = "vec_id", label: str = "label", column: str = "embedding") -> DataFrame:
    """M5: each vector's most similar class centroid. There is one centroid a class, so
    the classes are a broadcast of one array each."""
    c = centroids(df, label, column).select(F.col(label).alias("predicted"), "centroid")
    scored = df.crossJoin(F.broadcast(c)).select(id_col, F.col(label), "predicted", cosine(F.col(column), F.col("centroid")).alias("cos"))
    return scored.groupBy(id_col, label).agg(F.max_by("predicted", F.struct(F.round("cos", 9), -F.col("predicted"))).alias("predicted"), F.max("cos").alias("cos"))


def centroid_signal(df: DataFrame, up: int, down: int, id_col: str = "vec_id", label: str = "label", column: str = "embedding") -> DataFrame:
    """M5: of each vector the cosine to the normalised centroid of class up minus that to class
    down, and the class of the most similar centroid (ties to the smaller label)."""
    u = units(df, column)
    c = centroids(u, label, column).select(F.col(label).alias("predicted"), "centroid")
    scored = u.crossJoin(F.broadcast(c)).select(id_col, "predicted", cosine(F.col(column), F.col("centroid")).alias("cos"))  # one row a class
    side = lambda v: F.max(F.when(F.col("predicted") == v, F.col("cos")))
    return scored.groupBy(id_col).agg((side(up) - side(down)).alias("signal"), F.max_by("predicted", F.struct(F.round("cos", 9), -F.col("predicted"))).alias("predicted"))


def class_geometry(df: DataFrame, label: str = "label", column: str = "embedding") -> DataFrame:
    """Cosine of the centroids of each pair of classes; give unit vectors for the
    directions of classes. There is one row a class."""
    c = centroids(df, label, column)
    pair = c.select(F.col(label).alias("a"), F.col("centroid").alias("x")).join(c.select(F.col(label).alias("b"), F.col("centroid").alias("y")), F.col("a") < F.col("b"))
    return pair.select("a", "b", cosine(F.col("x"), F.col("y")).alias("cos"))


def class_alignment(df: DataFrame, label: str = "label", column: str = "embedding") -> DataFrame:
    """The mean cosine of the vectors of a class to the direction of the class, which is
    the norm of the mean unit vector; null for a class of one."""
    u = units(df, column)
    n = u.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return centroids(u, label, column).hint("merge").join(n.hint("merge"), label).select(label, "n", F.when(F.col("n") > 1, norm(F.col("centroid"))).alias("alignment"))


#: Rows of a block, at least and at most, and blocks in all unless they would be larger: a row
#: goes once to each block, so up to GRID * MOST_ROWS rows what is shuffled grows with the rows.
BLOCK_ROWS, MOST_ROWS, GRID = 512, 65_536, 24
#: Distances that are held at once.
TILE = (128, 1024)
#: Squares below this share of the norms are summed from differences.
NEAR = 1e-4


def grid(n: int) -> int:
    """How many blocks n rows are dealt in."""
    return max(1, min(GRID, -(-n // BLOCK_ROWS)), -(-n // MOST_ROWS))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to those of b: one matrix product; where the expanded
    square would cancel, or is not finite, the differences themselves."""
    x, y = (a * a).sum(1), (b * b).sum(1)
    d = np.matmul(np.c_[a * -2, x, np.ones(len(a))], np.c_[b, np.ones(len(b)), y].T)
    if not d.min() >= NEAR * (x.max() + y.max()):
        i, j = np.nonzero(~(d >= NEAR * (x[:, None] + y[None, :])))
        for at in range(0, len(i), 65_536):
            p, q = i[at : at + 65_536], j[at : at + 65_536]
            d[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    return np.sqrt(d, out=d)


def _by_class(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and class numbers of a block in order of class, and the classes; rows without a
    class come last, with a number of their own."""
    frame = frame.sort_values("l", kind="stable", na_position="last")
    names = np.unique(frame["l"].dropna().to_numpy())
    known = frame["l"].notna().to_numpy()
    number = np.full(len(frame), len(names))
    number[known] = np.searchsorted(names, frame["l"].to_numpy()[known])
    return frame["id"].to_numpy(), np.stack(frame["v"].to_numpy()), number, names


def _runs(number: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers start."""
    return np.flatnonzero(np.r_[True, number[1:] != number[:-1]])


def _distance_sums(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Of two blocks: for each vector of either the sum and number of distances to the
    vectors of each class of the other block; a block with itself counts once. Equal ids
    are in the same block."""
    empty = pd.DataFrame({"id": pd.Series([], dtype="int64"), "l": pd.Series([], dtype="int32"), "o": pd.Series([], dtype="int32"), "s": pd.Series([], dtype="float64"), "n": pd.Series([], dtype="int64")})
    if not len(left) or not len(right):
        return empty
    (a_id, a, a_no, a_names), (b_id, b, b_no, b_names) = _by_class(left), _by_class(right.rename(columns={"rid": "id", "rl": "l", "rv": "v"}))
    itself = key[-2] == key[-1]
    a_sum, b_sum = np.zeros((len(a), len(b_names) + 1)), np.zeros((len(b), len(a_names) + 1))
    a_n = np.repeat(np.bincount(b_no, minlength=len(b_names) + 1)[None, :], len(a), 0)
    b_n = np.repeat(np.bincount(a_no, minlength=len(a_names) + 1)[None, :], len(b), 0)
    for i in range(0, len(a), TILE[0]):
        p = slice(i, i + TILE[0])
        rows = [(a_no[i + r[0]], slice(r[0], r[1])) for r in itertools.pairwise([*_runs(a_no[p]), len(a_no[p])])]
        for j in range(0, len(b), TILE[1]):
            q = slice(j, j + TILE[1])
            d, runs = distances(a[p], b[q]), _runs(b_no[q])
            if itself:
                same = a_id[p, None] == b_id[None, q]
                d[same] = 0
                a_n[p, b_no[q][runs]] -= np.add.reduceat(same, runs, axis=1, dtype="int64")
            else:
                for c, r in rows:
                    b_sum[q, c] += d[r].sum(0)
            a_sum[p, b_no[q][runs]] += np.add.reduceat(d, runs, axis=1)
    out = [empty]
    for ids, number, names, far, sums, n in ((a_id, a_no, a_names, b_names, a_sum, a_n), (b_id, b_no, b_names, a_names, b_sum, b_n))[: 1 if itself else 2]:
        own = pd.array(np.append(names, 0)[number].astype("int64"), dtype="Int32")
        own[number == len(names)] = pd.NA
        for c, o in enumerate(far):
            out.append(pd.DataFrame({"id": ids, "l": own, "o": np.full(len(ids), o, "int32"), "s": sums[:, c], "n": n[:, c]}))
    return pd.concat(out[1:] or out)


def class_distances(df: DataFrame, id_col: str = "vec_id", label: str = "label", column: str = "embedding", inside: bool = False) -> DataFrame:
    """(id, l, o, s, n): of each vector of class l the sum and number of distances to the
    vectors of class o, in parts; inside: only of its own class, and only vectors of one
    class meet. Vectors are dealt in blocks; each pair of blocks is a task that sends sums,
    not pairs."""
    most = df.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.max("count").alias("n")).first().n if inside else df.count()
    blocks, by = grid(most or 0), ["l"] if inside else []
    own = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("l"), F.col(column).alias("v"), own.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k"))
    if inside:
        rows = rows.where("l is not null")
    left = rows.where("b <= k").select(F.col("b").alias("x"), F.col("k").alias("y"), "id", "l", "v").groupBy(*by, "x", "y")
    # names of its own: with shared ones Spark prunes columns of one side under a filter
    right = rows.where("b >= k").select(F.col("k").alias("rx"), F.col("b").alias("ry"), F.col("id").alias("rid"), F.col("l").alias("rl"), F.col("v").alias("rv")).groupBy(*(f"r{c}" for c in by), "rx", "ry")
    return left.cogroup(right).applyInPandas(_distance_sums, "id long, l int, o int, s double, n long")


def silhouette(df: DataFrame, id_col: str = "vec_id", label: str = "label", column: str = "embedding") -> DataFrame:
    """Exact silhouette of given labels, by vector: mean distances to the own and the
    nearest other class."""
    means = class_distances(df, id_col, label, column).groupBy("id", "l", "o").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("d"))
    per = means.where("d is not null").groupBy("id", "l").agg(F.max(F.when(F.col("l") == F.col("o"), F.col("d"))).alias("own"), F.min(F.when(F.col("l") != F.col("o"), F.col("d"))).alias("other"))
    return per.select(F.col("id").alias(id_col), F.col("l").alias(label), F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")), F.lit(0.0)).alias("silhouette"))


def class_cohesion(df: DataFrame, id_col: str = "vec_id", label: str = "label", column: str = "embedding") -> DataFrame:
    """The mean distance of the pairs inside each class (null for a class of one) and of
    its centroid to those of the other classes."""
    inside = class_distances(df, id_col, label, column, inside=True).groupBy("l").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("cohesion"))
    c = centroids(df, label, column).select(F.col(label).cast("int").alias("l"), "centroid")
    far = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, e: t + e))
    pair = c.select("l", F.col("centroid").alias("x")).join(c.select(F.col("l").alias("m"), F.col("centroid").alias("y")), F.col("l") != F.col("m"))
    apart = pair.groupBy("l").agg(F.avg(far).alias("separation"))
    return inside.hint("merge").join(apart.hint("merge"), "l", "left").select(F.col("l").alias(label), "cohesion", "separation")


def _partial_gramians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows (k, v) of a partition and each k: Z'Z row by row, the sum and the number."""
    parts: dict[int | None, list] = {}
    for batch in batches:
        frame = batch.to_pandas()
        for k, rows in frame.groupby("k", dropna=False):
            z = np.stack(rows["v"].to_numpy())
            new = [z.T @ z, z.sum(0), len(z)]
            key = None if pd.isna(k) else int(k)
            parts[key] = [x + y for x, y in zip(parts[key], new)] if key in parts else new
    for key, (g, total, n) in parts.items():
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.concatenate([g.reshape(-1), total, [n]])], pa.list_(pa.float64()))], ["k", "cells"])


def gramians(df: DataFrame, column: str = "embedding", key: str | None = None) -> dict[int | None, tuple[np.ndarray, np.ndarray, int]]:
    """Z'Z, sum and number of the vectors of each value of `key` (all under None without a
    key): one product matrix a partition and key, summed on the executors by place. Only
    d x d + d + 1 numbers a key reach the driver. Null vectors take no part."""
    k = F.lit(None).cast("long") if key is None else F.col(key).cast("long")
    parts = df.where(F.col(column).isNotNull()).select(k.alias("k"), F.col(column).alias("v")).mapInArrow(_partial_gramians, "k long, cells array<double>")
    cells = parts.select("k", F.posexplode("cells").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x"))
    out = {}
    for row in cells.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("x")).collect():
        flat = np.array(row.x)
        d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2 + 0.5)
        out[row.k] = (flat[: d * d].reshape(d, d), flat[d * d : -1], int(flat[-1]))
    return out


def gramian(df: DataFrame, column: str = "embedding", centre: bool = True) -> tuple[np.ndarray, int]:
    """Z'Z of the (centred) vectors, and their number."""
    g, total, n = gramians(df, column)[None]
    return (g - np.outer(total, total) / n if centre else g), n


def effective_dimension(df: DataFrame, column: str = "embedding") -> float:
    """1 / sum of squared shares of the singular values."""
    g, _ = gramian(df, column)
    s = np.sqrt(np.clip(np.linalg.eigvalsh(g), 0, None))
    return float(1 / np.sum((s / s.sum()) ** 2))


def _rate(g: np.ndarray, n: int, eps: float) -> float:
    return float(0.5 * np.linalg.slogdet(np.eye(len(g)) + len(g) / (n * eps**2) * g)[1])


def coding_rate(df: DataFrame, column: str = "embedding", eps: float = 0.5) -> float:
    """Half the log determinant of I + d / (n eps^2) Z'Z."""
    g, n = gramian(df, column, centre=False)
    return _rate(g, n, eps)


def rate_reduction(df: DataFrame, key: str = "label", column: str = "embedding", eps: float = 0.5) -> DataFrame:
    """The coding rate of all vectors, the mean of the rates of the clusters weighted by
    their sizes, and the difference; one pass. Rows without a cluster take no part."""
    parts = gramians(df.where(F.col(key).isNotNull()), column, key).values()
    n = sum(p[2] for p in parts)
    row = (n, None, None, None)
    if n:
        whole, within = _rate(sum(p[0] for p in parts), n, eps), sum(p[2] / n * _rate(p[0], p[2], eps) for p in parts)
        row = (n, whole, within, whole - within)
    return df.sparkSession.createDataFrame([row], "n long, whole double, within double, reduction double")


def scaled(df: DataFrame, column: str = "embedding") -> DataFrame:
    v = df.withColumn("features", array_to_vector(column))
    return StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(v).transform(v)


#: Values of k that are fitted at once: a fit is many short jobs in a row, which leave cores idle.
FITS = 3


def cluster_sweep(df: DataFrame, ks: range = range(2, 11), column: str = "embedding", seed: int = 42) -> DataFrame:
    """K-means of standardised vectors for each k, with its silhouette; best marks the
    k of the largest, of equal ones the smallest. The vectors are scaled and cached once. A fit
    keeps its points decoded over its passes only if its input is not what is cached, so it gets
    a filter over that; else each pass decodes all vectors anew."""
    z = scaled(df, column).select("z").cache()
    points = z.where(F.col("z").isNotNull())

    def swept(k: int) -> tuple[int, float]:
        found = KMeans(k=k, seed=seed, featuresCol="z", solver="row").fit(points).transform(points)
        return k, float(ClusteringEvaluator(featuresCol="z", predictionCol="prediction").evaluate(found))

    try:
        with ThreadPool(FITS) as pool:
            rows = pool.map(inheritable_thread_target(df.sparkSession)(swept), ks, chunksize=1)
    finally:
        z.unpersist()
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "k int, silhouette double, best boolean")


def pca_report(df: DataFrame, k: int = 10, column: str = "embedding", shares: tuple[float, ...] = (0.9, 0.95)) -> DataFrame:
    """Explained share of each of the first k components of the standardised vectors, the
    running share, and how many components explain each of `shares` (n_90, n_95). The
    shares are the eigenvalues of the d x d product matrix."""
    g, _ = gramian(scaled(df, column).select(vector_to_array("z").alias("z")), "z")
    values = np.clip(np.linalg.eigvalsh(g)[::-1], 0, None)
    explained = values / values.sum()
    running = np.cumsum(explained)
    needed = [int(np.searchsorted(running, s - 1e-12)) + 1 for s in shares]
    names = ", ".join(f"n_{round(100 * s)} int" for s in shares)
    rows = [(i + 1, float(x), float(y), *needed) for i, (x, y) in enumerate(zip(explained[:k], running[:k]))]
    return df.sparkSession.createDataFrame(rows, f"component int, share double, running double, {names}")


def pca_projection(df: DataFrame, k: int = 2, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    z = scaled(df, column)
    return PCA(k=k, inputCol="z", outputCol="pc").fit(z).transform(z).select(id_col, vector_to_array("pc").alias("pc"))


def component_correlations(df: DataFrame, metrics: DataFrame, k: int = 3, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(component, metric, corr): of each of the first k principal components the metric
    it follows most, by absolute correlation (ties to the first name). metrics: id_col and
    columns of numbers; one without variance is skipped."""
    names = [c for c in metrics.columns if c != id_col]
    rows = pca_projection(df, k, id_col, column).join(metrics, id_col)
    one = rows.agg(*(correlation(F.col("pc")[i], F.col(m)).alias(f"c{i}_{j}") for i in range(k) for j, m in enumerate(names)))
    cells = F.array(*(F.struct(F.lit(i).alias("component"), F.lit(m).alias("metric"), F.col(f"c{i}_{j}").alias("corr")) for i in range(k) for j, m in enumerate(names)))
    long = one.select(F.explode(cells).alias("r")).select("r.*").where("corr is not null and not isnan(corr)")
    first = F.struct(F.abs("corr").alias("x"), -F.array_position(F.array(*map(F.lit, names)), F.col("metric")))
    return long.groupBy("component").agg(F.max_by("metric", first).alias("metric"), F.max_by("corr", first).alias("corr"))


def quality_score(df: DataFrame, metrics: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row: mean cosine, components for 90 %, best silhouette, strongest correlation
    with a metric, and score, a point for each of: mean cosine under 0.8, at most 20
    components, a silhouette over 0.1, a correlation over 0.2."""
    row = cosine_stats(df, column, id_col).select(F.col("mean").alias("cosine"))
    ks = range(2, min(11, df.count()))
    for one in (
        pca_report(df, 1, column).select("n_90"), cluster_sweep(df, ks, column).where("best").select("silhouette"),
        component_correlations(df, metrics, 3, id_col, column).agg(F.max(F.abs("corr")).alias("corr")),
    ):
        row = row.crossJoin(F.broadcast(one))  # one row each
    points = (F.col("cosine") < 0.8, F.col("n_90") <= 20, F.col("silhouette") > 0.1, F.col("corr") > 0.2)
    return row.select("*", sum(F.coalesce(p.cast("int"), F.lit(0)) for p in points).alias("score"))


def cluster_balance(df: DataFrame, assignment: str) -> DataFrame:
    """KL divergence from the uniform to the mean assignment (array of shares)."""
    per = df.select(F.posexplode(assignment).alias("i", "p")).groupBy("i").agg(F.avg("p").alias("p"))
    k = F.count("*").over(Window.partitionBy())
    return per.select("p", k.alias("k")).agg(F.sum((1 / F.col("k")) * F.log((1 / F.col("k")) / F.col("p"))).alias("kl"))


def positive_pairs(df: DataFrame, batch: str, label: str) -> DataFrame:
    """Anchors, and the share of them that have a positive, by batch."""
    per = df.groupBy(batch, label).agg(F.count("*").alias("n"))
    return per.groupBy(batch).agg(F.sum("n").alias("anchors"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("with_positive"))
