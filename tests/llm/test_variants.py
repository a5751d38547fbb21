"""Deletion variants in the near-dedup of the pipeline."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidepool.llm import simhash


def test_variants_of_representatives_find_near_copies(spark, monkeypatch):
    """Without the buckets of bands, pairs within MAX_BITS are still met and verified."""
    rng = random.Random(8)
    docs, near = [], []
    for i in range(40):
        words = [rng.choice("abcdefgh") + str(rng.randint(0, 5000)) for _ in range(300)]
        pair = [" ".join(words), " ".join([*words[:-1], "changed"])]
        a, b = (int(simhash.majority(simhash.shingle_hashes(t.encode(), simhash.SET_WORDS), np.array([0]))[0]) for t in pair)
        docs += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
        near += [2 * i + 1] if (a ^ b).bit_count() <= simhash.MAX_BITS else []
    assert len(near) > 20
    real = simhash._met
    monkeypatch.setattr(simhash, "_met", lambda keyed, most: real(keyed, most).limit(0) if most is None else real(keyed, most))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", simhash.row_key(F.col("doc_id"), F.col("text")))
    kept = {r.doc_id for r in df.join(simhash.representatives(df.drop("key")), "key").collect()}
    assert not kept & set(near) and kept >= {2 * i for i in range(40)}
