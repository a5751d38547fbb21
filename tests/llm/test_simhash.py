import re

import numpy as np
import xxhash

from tidepool.llm import simhash

from .conftest import edge_rows


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if root(k) == root(i) and rows[k][0] is not None]
        out.append((d, fps[i], min(ids) if ids else None))
    return sorted(out, key=str)


def test_edge_rows(edge_docs):
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(edge_docs).collect()), key=str)
    assert got == slow_components([r[:2] for r in edge_rows()])


def test_empty(empty_docs):
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_bucket_edges_connect_like_all_pairs():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    f = np.unique(np.concatenate([centre, *(c ^ (np.uint64(1) << rng.integers(0, 64, (80, 3), dtype=np.uint64)).sum(1) for c in centre)]))
    for i, j in (simhash.bucket_edges(f), simhash._tree(f, 4, 3), simhash.bucket_edges(np.repeat(f, 30))):
        whole = f if max(i.max(), j.max()) < len(f) else np.repeat(f, 30)
        least = [(int(a), int(b)) for a, b in zip(whole[i], whole[j])]
        assert all((a ^ b).bit_count() <= 4 for a, b in least)
        label = {int(x): int(x) for x in f}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in least:
            label[max(root(a), root(b))] = min(root(a), root(b))
        want = {int(x): int(x) for x in f}

        def root2(x):
            while want[x] != x:
                x = want[x]
            return x

        for i, a in enumerate(f):
            for b in f[:i]:
                if int(a ^ b).bit_count() <= 4:
                    x, y = root2(int(a)), root2(int(b))
                    want[max(x, y)] = min(x, y)
        assert {x: root(x) for x in label} == {x: root2(x) for x in want}


def test_large_bucket_is_cut_without_loss():
    rng = np.random.default_rng(2)
    f = np.unique(rng.integers(0, 1 << 40, 6000, dtype=np.uint64))
    f = np.unique(np.concatenate([f, f[:50] ^ np.uint64(0b1011)]))
    i, j = simhash.bucket_edges(f)
    pairs = {frozenset((int(a), int(b))) for a, b in zip(f[i], f[j])}
    have = {int(x) for p in pairs for x in p}
    for x in f[np.isin(f ^ np.uint64(0b1011), f)]:
        assert int(x) in have


def test_variants_meet_within_four_bits(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        rows.append((i, a, b - (1 << 64) if b >= 1 << 63 else b))
    df = spark.createDataFrame(rows, "i long, a long, b long")
    from pyspark.sql import functions as F

    met = df.select(F.arrays_overlap(F.array(*simhash.variants(F.col("a"))), F.array(*simhash.variants(F.col("b")))).alias("m")).where("m").count()
    assert met == 300
