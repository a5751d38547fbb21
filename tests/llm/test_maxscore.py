import math

import numpy as np

from tidepool.llm import maxscore


def slow(rows, k=5, step=50):
    own = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, tuple(math.floor(256 * float(x)) for x in v)))
    out = []
    for q, qv in sorted(set(r for r in own if r[0] % step == 0)):
        scores = {(-sum(a * b for a, b in zip(qv, v)), i) for i, v in own if i != q}
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.2, (700, 16)).astype(np.float32)
    v[100:140] = v[0]
    v[::90] *= 3
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)]
    rows += [(701, None), (750, [None, 1.0]), (800, [math.nan] * 16), (850, [math.inf] + [0.0] * 15), (None, [1.0] * 16), (900, [0.5] * 3), (901, []), (902, [1.0] * 20), rows[50], rows[7], rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", __import__("pyspark").sql.functions.lit("clash")).repartition(4)
    for name, n in (("QUERY_BLOCK", 5), ("SHARD_ROWS", 130), ("SEED_ROWS", 60), ("BLOCK_ROWS", 40)):
        monkeypatch.setattr(maxscore, name, n)
    assert sorted(map(tuple, maxscore.report(df).collect())) == slow(rows)


def test_shards_prune_without_loss():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(0, 30, (5000, 32)))
    shard = maxscore.Shard(np.arange(5000), x)
    for q in x[:20]:
        scores = x @ q
        best = np.sort(scores)[-6]
        ids, score = shard.search(q, -1, 5, best)
        order = np.lexsort((np.arange(5000), -scores))[:5]
        assert sorted(ids) == sorted(order) and sorted(score) == sorted(scores[order])


def test_huge_values_and_few_rows(spark):
    df = spark.createDataFrame([(0, [3e6, 1e5]), (1, [2e6, -1e5]), (50, [1e-3, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, maxscore.report(df).collect()))
    assert got == slow([(0, [3e6, 1e5]), (1, [2e6, -1e5]), (50, [1e-3, 0.0])])


def test_empty(spark):
    assert maxscore.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_given_vectors_skip_terms_and_lose_nothing(spark, sf_dir):
    rows = maxscore.quantised(spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/embeddings.parquet")).toPandas().drop_duplicates("vec_id")
    x = np.stack(rows["v"]).astype(np.int64)
    ids = rows["vec_id"].to_numpy()
    own = np.flatnonzero(ids % maxscore.QUERY_STEP == 0)
    seeds = np.arange(0, len(ids), 2)
    floor = []
    for i in own:
        scores = x[seeds[seeds != i]] @ x[i]
        floor.append(np.sort(scores)[-5])
    block = maxscore.Block(ids[own], maxscore.pa.array([v.tolist() for v in x[own]], maxscore.pa.list_(maxscore.pa.int64())), np.array(floor, float), 5)
    for at in range(0, len(ids), 100):
        part = x[at : at + 100]
        block.take(ids[at : at + 100], maxscore.pa.array(part.tolist(), maxscore.pa.list_(maxscore.pa.int64())))
    searches, terms, essential = block.told.tolist()
    assert searches == len(own) * -(-len(ids) // 100) and essential < 0.7 * terms
    for i, got_ids, got in zip(own, block.best_ids, block.best):
        scores = x @ x[i]
        want = sorted((-int(s), int(v)) for s, v in zip(scores, ids) if v != ids[i])[:5]
        assert [(-int(s), int(v)) for s, v in zip(got, got_ids)] == want


def test_every_run_starts_with_a_threshold(spark, sf_dir, monkeypatch):
    floors = []
    met = maxscore._met
    monkeypatch.setattr(maxscore, "_met", lambda rows, queries, *a: floors.append(queries.where("floor is null").count()) or met(rows, queries, *a))
    out = maxscore.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assert out.count() and floors[0] > 0 and floors[1] == 0
