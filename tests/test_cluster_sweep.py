import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator

from tidepool.operators import embeddings


def vectors(spark):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(3, 6)) * 8
    return spark.createDataFrame([(i, (middle[i % 3] + rng.normal(size=6)).tolist()) for i in range(240)], "vec_id long, embedding array<double>").repartition(4, "vec_id").localCheckpoint()


def test_fits_keep_their_points_and_give_the_same_scores(spark, monkeypatch):
    df, seen = vectors(spark), {}

    class Watched(KMeans):
        def fit(self, dataset, params=None):
            seen[self.getK()] = (dataset.storageLevel, dataset._jdf.queryExecution().optimizedPlan().toString())
            return super().fit(dataset, params)

    monkeypatch.setattr(embeddings, "KMeans", Watched)
    got = {r.k: (r.silhouette, r.best) for r in embeddings.cluster_sweep(df).collect()}
    assert sorted(seen) == list(range(2, 11))
    for level, plan in seen.values():
        # Spark ML keeps the decoded points of a fit only if its input has no storage level
        assert not level.useMemory and not level.useDisk
        assert "InMemoryRelation" in plan
    z = embeddings.scaled(df).cache()
    score = ClusteringEvaluator(featuresCol="z")
    for k, (silhouette, best) in got.items():
        assert abs(silhouette - score.evaluate(KMeans(k=k, seed=42, featuresCol="z").fit(z).transform(z))) < 1e-9
        assert best == (k == 3)
    z.unpersist()


def test_nothing_stays_cached(spark):
    df = vectors(spark)
    spark.catalog.clearCache()
    embeddings.cluster_sweep(df, range(2, 4)).collect()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
