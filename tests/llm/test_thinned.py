"""Near-dedup of the pipeline where buckets send spanning edges instead of all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidepool.llm import simhash


def _hashes(text: str) -> set:
    return set(simhash.shingle_hashes(text.encode(), simhash.SET_WORDS).tolist())


def _alike(x: set, y: set) -> bool:
    return len(x & y) * 5 >= 4 * len(x | y)


def _templates(pairs: int) -> list[tuple]:
    """Texts of one line many times, which makes equal fingerprints, and an own end: pairs of near copies."""
    rng = random.Random(3)
    out = []
    for i in range(pairs):
        end = [f"w{rng.randint(0, 10**6)}" for _ in range(40)]
        for k, words in enumerate((end, [*end[:-1], "changed"])):
            out.append((2 * i + k, " ".join([*["all rights are reserved here"] * 200, *words])))
    return out


def _kept(spark, docs: list[tuple]) -> set:
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", simhash.row_key(F.col("doc_id"), F.col("text")))
    return {r.doc_id for r in df.join(simhash.representatives(df.drop("key")), "key").collect()}


def test_links_beside_a_spanning_tree_are_verified(spark, monkeypatch):
    """One bucket of 600 equal fingerprints, where only pairs of near copies are links; without the bands."""
    docs = _templates(300)
    fps = {int(simhash.majority(simhash.shingle_hashes(t.encode(), simhash.SET_WORDS), np.array([0]))[0]) for _, t in docs}
    sets = [_hashes(t) for _, t in docs]
    assert len(fps) == 1 and all(_alike(sets[i], sets[i + 1]) for i in range(0, 600, 2)) and not _alike(sets[0], sets[2])
    real = simhash._met
    monkeypatch.setattr(simhash, "_met", lambda keyed, most: real(keyed, most).limit(0) if most is None else real(keyed, most))
    assert _kept(spark, docs) == set(range(0, 600, 2))


def test_far_fingerprints_in_a_crowded_band_are_verified(spark, monkeypatch):
    """Pairs of a bucket of bands beyond the bits that its spanning edges go by; without the variants."""
    rng = random.Random(5)
    docs, far = [], 0
    for i in range(30):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        # some words many times move the fingerprint and hardly the set
        pair = [" ".join(words), " ".join([*words, *words[:6] * 40])]
        x, y = (int(simhash.majority(simhash.shingle_hashes(t.encode(), simhash.SET_WORDS), np.array([0]))[0]) for t in pair)
        far += (x ^ y).bit_count() > simhash.SET_BITS[-1]
        docs += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
    sets = [_hashes(t) for _, t in docs]
    assert far > 10 and all(_alike(sets[i], sets[i + 1]) for i in range(0, 60, 2))
    real = simhash._scanned
    # every text in one bucket, as of a band that all share
    monkeypatch.setattr(simhash, "_scanned", lambda keyed, most, thinned: real(keyed, most, thinned).limit(0) if most is not None else real(keyed.withColumn("key", F.lit(7).cast("long")).distinct(), most, thinned))
    assert _kept(spark, docs) == set(range(0, 60, 2))


def test_open_pairs_leave_out_no_similar_pair(spark, monkeypatch):
    """Blocks of 7 members; sets from one shingle to more than a sketch has bits; members of one
    component are not asked for."""
    rng = random.Random(6)
    texts = []
    for size in (1, 5, 6, 20, 60, 300, 300, 4000):
        words = [f"v{rng.randint(0, 10**6)}" for _ in range(size)]
        for cut in (0.0, 0.01, 0.05, 0.1, 0.2, 0.3):
            texts.append(" ".join(words[: max(1, round(size * (1 - cut)))]))
    texts = sorted(set(texts))
    sets = [_hashes(t) for t in texts]
    src = spark.createDataFrame(list(enumerate(texts)), "key long, text string").withColumn("text", F.col("text").cast("binary"))
    nodes = spark.createDataFrame([(i, i, len(x), 0) for i, x in enumerate(sets)], "node long, any long, n long, fp long")
    left = spark.createDataFrame([(64, 1, i, i // 2 * 2) for i in range(len(texts))], "bits int, key long, node long, root long")
    monkeypatch.setattr(simhash, "BLOCK", 7)
    got = {(r.a, r.b) for r in simhash.open_pairs(left, nodes, src).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if i // 2 != j // 2 and _alike(sets[i], sets[j])}
    assert want and want <= got and len(got) < 0.5 * len(texts) ** 2 / 2
    assert {(r.a, r.b) for r in simhash.verified(simhash.open_pairs(left, nodes, src), nodes, src).collect()} == want


def test_settled_buckets_are_not_asked_again(spark):
    thin = spark.createDataFrame([(4, k, n) for k in (1, 2) for n in (10, 11, 12)] + [(4, 3, 10), (4, 3, 11)], "bits int, key long, node long")
    roots = spark.createDataFrame([(10, 10), (11, 10), (12, 12)], "node long, root long")
    # buckets 1 and 2 have equal members, 3 is one component
    assert sorted(tuple(r) for r in simhash.unsettled(thin, roots).collect()) == [(4, 1, 10, 10), (4, 1, 11, 10), (4, 1, 12, 12)]
