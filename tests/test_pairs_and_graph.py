"""Pruned pairs, messages over time, and reads that a list of chains decides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import graph, pairs
from tidepool.operators.tables import stored, written
from tidepool.sources import readers


def brute(ids, x, k, most):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = [(float(x[i] @ x[j]), min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(x)) for j in range(i + 1, len(x))]
    found.sort(key=lambda f: (-f[0] if most else f[0], f[1], f[2]))
    return found[:k]


@pytest.mark.parametrize("most", [True, False])
def test_same_pairs_and_most_blocks_skipped(spark, most):
    """Narrow groups of vectors: the pairs are those of all pairs, and few pairs of blocks are
    compared."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 16))
    x = np.concatenate([m + rng.normal(size=(60, 16)) * 0.05 for m in middles])
    ids = rng.permutation(len(x)).tolist()
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x)] + [(9000, None), (9001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    report = {}
    got = [(r.cos, r.a, r.b) for r in pairs.similar_pairs(df, 15, most, block=20, report=report).collect()]
    want = brute(ids, x, 15, most)
    assert [g[1:] for g in got] == [w[1:] for w in want] and np.allclose([g[0] for g in got], [w[0] for w in want])
    assert report["all"] > 200 and report["compared"] < 0.25 * report["all"], report


def test_no_structure_and_few_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for most in (True, False):
        got = [(r.a, r.b) for r in pairs.similar_pairs(df, 30, most, block=7).collect()]
        assert got == [w[1:] for w in brute(list(range(90)), x, 30, most)]
    assert pairs.similar_pairs(df.limit(1), 5).collect() == [] and pairs.similar_pairs(df.limit(2), 5).count() == 1


def test_messages_over_time(spark):
    """Two hops, decay and reach, by hand: a gets b's feature at once, c's in two hops, and all of
    it only in later batches."""
    rows = [(0, "a", "b", 10.0, 1.0), (0, "b", "c", 30.0, 2.0), (0, "c", "b", 10.0, 4.0), (1, "a", "c", 5.0, 3.0)]
    bars = spark.createDataFrame(rows, "batch long, src_token_id string, dest_token_id string, src_flow_usdc double, x double")
    got = {(r.batch, r.node): (r.hop1, r.hop2) for r in graph.temporal_messages(bars, "batch", "x", decay=0.5, reach=2).collect()}
    hop1 = {"a": 2.0, "b": (10 * 1 + 40 * 4) / 50, "c": 2.0}
    hop2 = {"a": hop1["b"], "b": (10 * hop1["a"] + 40 * hop1["c"]) / 50, "c": hop1["b"]}
    assert got[1, "a"] == pytest.approx((hop1["a"], hop2["a"])) and got[1, "b"] == pytest.approx((hop1["b"], hop2["b"]))
    # in batch 1 only a sends, to c
    assert got[2, "c"] == pytest.approx((3.0 + 0.5 * hop1["c"], 0.5 * hop2["c"])) and got[2, "b"] == pytest.approx((0.5 * hop1["b"], 0.5 * hop2["b"]))
    assert got[3, "c"] == (pytest.approx(1.5), None) and (0, "a") not in got and (3, "b") not in got


def test_chain_list_prunes_at_run_time(spark):
    rows = [(c, d, v) for c in ("eth", "base", "op") for d in ("2024-01-01", "2024-01-02") for v in range(3)]
    df = spark.createDataFrame(rows, "chain string, day string, v int").withColumn("trade_date", F.to_date("day")).drop("day")
    logs = stored(df, "test_logs", "chain", "trade_date")
    chains = written(spark.createDataFrame([("eth", 1), ("base", 2), ("op", 3)], "chain string, size int"), "test_chains").where("size = 2")
    out = readers.of_chains(logs, chains).where("trade_date = date '2024-01-02'")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "trade_date" in plan.split("PartitionFilters")[1].split("]")[0]
    assert sorted(tuple(r) for r in out.select("chain", "v").collect()) == [("base", v) for v in range(3)]


def test_partitions_are_replaced_alone(spark, tmp_path):
    df = spark.createDataFrame([("eth", 1, 10), ("op", 1, 20)], "chain string, day int, v int")
    readers.write_partitioned(df, str(tmp_path / "t"), "chain", "day")
    readers.write_partitioned(spark.createDataFrame([("op", 1, 30), ("op", 2, 40)], "chain string, day int, v int"), str(tmp_path / "t"), "chain", "day")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("chain", "day", "v").collect()) == [("eth", 1, 10), ("op", 1, 30), ("op", 2, 40)]


def test_components_against_numpy(spark):
    """The correlations are those of NumPy's components; a flat metric is skipped."""
    from tidepool.operators import embeddings

    rng = np.random.default_rng(9)
    n = 80
    hidden = rng.normal(size=(n, 2))
    x = hidden @ rng.normal(size=(2, 6)) + rng.normal(size=(n, 6)) * 0.1
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    metrics = np.column_stack([hidden[:, 0] + rng.normal(size=n) * 0.2, hidden[:, 1] * -3, np.ones(n)])
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    m = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(metrics)], "vec_id long, a double, b double, flat double")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1]
    for r in embeddings.component_correlations(e, m, 2).collect():
        want = {c: abs(np.corrcoef(z @ axes[:, r.component], metrics[:, j])[0, 1]) for j, c in enumerate("ab")}
        assert r.metric == max(want, key=want.get) and abs(r.corr) == pytest.approx(want[r.metric], rel=1e-6)
    score = embeddings.quality_score(e, m).first()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert score.cosine == pytest.approx((u @ u.T)[np.triu_indices(n, 1)].mean(), rel=1e-6) and score.n_90 == 2
    assert score.score == (score.cosine < 0.8) + (score.n_90 <= 20) + (score.silhouette > 0.1) + (score["corr"] > 0.2)


def test_distances_by_class_in_blocks(spark, monkeypatch):
    """blocks, tiles and runs of classes cut anywhere; far from the origin, so that the expanded
    square cancels; copies under other ids, a row without a class and a class of one."""
    from tidepool.operators import embeddings

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(70, 6)), 1e6 + 1e-3 * rng.normal(size=(70, 6)), np.zeros((3, 6))])
    label = [int(v) for v in rng.integers(0, 3, len(x))]
    label[4], label[9] = None, 7
    df = spark.createDataFrame([(i, [float(v) for v in r], o) for i, (r, o) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int").repartition(3)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    of = lambda i, o: [far[i, j] for j in range(len(x)) if j != i and label[j] == o]
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 20)
    assert embeddings.grid(len(x)) == 8 and embeddings.grid(10**6) == embeddings.grid(10**5) == embeddings.GRID and embeddings.grid(10**7) == -(-(10**7) // embeddings.MOST_ROWS)
    means = {i: {o: np.mean(of(i, o)) for o in (0, 1, 2, 7) if of(i, o)} for i in range(len(x))}
    got = {r.vec_id: r.silhouette for r in embeddings.silhouette(df).collect()}
    assert len(got) == len(x) and got[4] == 0 and got[9] == 0
    for i, m in means.items():
        if i not in (4, 9):
            own, other = m[label[i]], min(v for o, v in m.items() if o != label[i])
            assert got[i] == pytest.approx((other - own) / max(own, other), rel=1e-9), i
    cohesion = {r.label: r.cohesion for r in embeddings.class_cohesion(df).collect()}
    assert set(cohesion) == {0, 1, 2, 7} and cohesion[7] is None
    for o in (0, 1, 2):
        assert cohesion[o] == pytest.approx(np.mean([d for i in range(len(x)) if label[i] == o for d in of(i, o)]), rel=1e-9)


@pytest.mark.parametrize("most", [True, False])
def test_groups_of_blocks_bound_the_copies_of_a_row(spark, most, monkeypatch):
    """Without structure no pair of blocks is skipped, and a row still goes to no more
    tasks than there are groups; copies tie to the smaller ids."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(150, 5)), np.eye(5), np.eye(5), -np.eye(5)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(pairs, "GROUPS", 4)
    blocks = pairs.in_vector_blocks(df, block=6)
    assert len(blocks.low) > 25 and -(-len(blocks.low) // blocks.size) <= 4
    monkeypatch.setattr(pairs, "GROUP_ROWS", 20)
    assert pairs.in_vector_blocks(df, block=6).size * 4 < len(blocks.low)
    got = [(r.a, r.b) for r in pairs.similar_pairs(df, 12, most, blocks=blocks).collect()]
    assert got == [w[1:] for w in brute(list(range(len(x))), x, 12, most)]


def test_edges_are_dealt_before_they_are_summed(spark):
    """Totals are those of the edges, and no aggregate stands below the exchange by key."""
    rows = [(1, 2, 7, 3e6, -1e6, 5, 60.0), (1, 2, 7, None, 2e9, 10**6, None), (2, 2, 9, 1e6, float("nan"), None, 1e9), (7, 1, 1, 1e6, 1e6, 1, 3600.0), (None, 1, 7, 1.0, 1.0, 1, 1.0)]
    bars = spark.createDataFrame(rows, "src_token_id long, dest_token_id long, pool_id long, src_flow_usdc double, dest_flow_usdc double, tick_count long, bar_time_delta_sec double")
    names = ("amount", "ticks", "delta")
    key = lambda r: (r.direction, r.src or -1, r.dst or -1)
    want = {key(r): (r.n, *(r[c] for c in names)) for r in graph.bipartite_edges(bars).groupBy("direction", "src", "dst").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names)).collect()}
    got = {key(r): (r.n, *(r[c] for c in names)) for r in graph.bipartite_totals(bars).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(got) == 12
    for df in (graph.bipartite_totals(bars), graph.batch_edges(bars.withColumnRenamed("tick_count", "batch"), "batch")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan.split("Exchange hashpartitioning")[1], plan
