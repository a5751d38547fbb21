"""The near-dedup stage against all pairs."""

import numpy as np

import corpus_pipeline as p
from tidepool.llm import simhash

from .conftest import SCHEMA, sentence


def slow_groups(texts):
    """For each text, the group of texts reached over five-word Jaccard >= 0.8."""
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() for t in texts]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in low]
    group = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y))):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def slow_kept(rows):
    least = {}
    for g, (d, _) in zip(slow_groups([t for _, t in rows]), rows):
        least[g] = min(least.get(g, d), d)
    return sorted(least.values())


def changed(text, every):
    """text with each `every`-th word replaced."""
    w = text.split()
    return " ".join(f"new{i}" if i % every == every - 1 else x for i, x in enumerate(w))


def test_jaccard_at_a_small_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(r.doc_id for r in p.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert got == slow_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_near_copies_around_the_bound(spark, sf_dir):
    """Copies with a changed word in 30 to 60: five-word Jaccard about 0.7 to 0.85."""
    texts = [t for i in range(30) for t in (sentence(i + 100, 300), changed(sentence(i + 100, 300), 30 + i))]
    rows = [(i + 1, t, *[None] * 3, *["clash"] * 11) for i, t in enumerate(texts)]
    want = slow_kept([r[:2] for r in rows])
    assert 30 < len(want) < 60
    got = p.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_group_larger_than_the_lags(spark, sf_dir):
    """Two hundred near copies of two texts: what the first pairs leave apart is compared too."""
    rng = np.random.default_rng(4)
    texts = []
    for base in (sentence(500, 200), sentence(501, 200)):
        for k in range(100):
            w = base.split()
            for at in rng.choice(200, 5, replace=False):
                w[at] = f"new{k}x{at}"
            texts.append(" ".join(w))
    rows = [(i + 1, t, *[None] * 3, *["clash"] * 11) for i, t in enumerate(texts)]
    got = p.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == slow_kept([r[:2] for r in rows])


def test_dense_buckets_send_few_pairs_and_span():
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    f = np.array([centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 5, replace=False).astype(np.uint64)) for _ in range(9000)])
    i, j = simhash.candidates(f)
    assert len(i) <= 2 * (len(f) + len(f) // simhash.CUT + 1)
    root = np.arange(len(f))
    for a, b in zip(i.tolist(), j.tolist()):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for x in range(len(f)):
        while root[x] != root[root[x]]:
            root[x] = root[root[x]]
    assert (root == 0).all()
