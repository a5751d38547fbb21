import math

import numpy as np
import pytest

from tests.compare import oracle, same
from tidepool.llm import quantise
from tidepool.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, c string, code string, t string, component_id string"


def brute(rows):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    def usable(i, x):
        return i is not None and x is not None and not any(c is None or not math.isfinite(c) for c in x) and any(x)

    ok = [k for k, (i, x) in enumerate(rows) if usable(i, x)]
    width = max((len(rows[k][1]) for k in ok), default=0)
    x = np.array([[*rows[k][1]] + [0.0] * (width - len(rows[k][1])) for k in ok], np.float64).reshape(len(ok), width)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    least = np.array([rows[k][0] for k in ok], dtype=np.int64)
    while True:
        new = np.array([min([least[a], *least[near[a]]]) for a in range(len(ok))], dtype=np.int64)
        if (new == least).all():
            break
        least = new
    out = [(i, 0, i, True) for k, (i, _) in enumerate(rows) if k not in set(ok)]
    return sorted(out + [(rows[k][0], int(near[a].sum()), int(least[a]), bool(rows[k][0] == least[a])) for a, k in enumerate(ok)], key=str)


def made(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], 1, "c", "c", "t", "x") for i, x in rows], SCHEMA)


def run(spark, rows):
    out = quantise.near_duplicates(made(spark, rows))
    return sorted((tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def moved(x, cosine, rng):
    x = x / np.linalg.norm(x)
    away = rng.standard_normal(len(x))
    away -= (away @ x) * x
    return cosine * x + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away)


def test_sql(spark, sf_dir):
    same(QUERIES["op11_quantise"](spark, sf_dir).toPandas(), oracle(ORACLE_SQL["op11_quantise"], sf_dir))


def test_groups_equal_brute_force(spark):
    """Copies, tight and loose groups, scaled vectors and chains, apart by margins."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(64)) for i in range(300)]
    middle = rng.standard_normal(64)
    rows += [(1000 + i, moved(middle, 0.99, rng)) for i in range(120)]
    rows += [(2000 + i, middle * (i % 3 + 1)) for i in range(40)]
    chain = rows[0][1]
    for i in range(6):
        chain = moved(chain, 0.95, rng)
        rows.append((3000 + i, chain))
    assert run(spark, rows) == brute([(i, np.asarray(x, np.float32)) for i, x in rows])


@pytest.mark.parametrize("dimensions", [24, 64, 200])
def test_recall_at_the_bound(spark, dimensions):
    """Of pairs just above the least cosine at least 0.9 are found, and nothing below it."""
    rng = np.random.default_rng(dimensions)
    rows = []
    for i in range(400):
        x = rng.standard_normal(dimensions)
        rows += [(2 * i, x), (2 * i + 1, moved(x, 0.905, rng))]
        if i < 50:
            rows.append((10_000 + i, moved(x, 0.85, rng)))
    got = {r[0]: r for r in run(spark, rows)}
    found = sum(got[2 * i + 1][2] == 2 * i for i in range(400))
    want = {r[0]: r for r in brute([(i, np.asarray(x, np.float32)) for i, x in rows])}
    assert found >= 0.93 * 400
    assert all(got[i][1] <= want[i][1] for i in got)


def test_one_group_holds_most(spark):
    """Planes through the middle of a dominant group must not hide its links."""
    rng = np.random.default_rng(3)
    middle = rng.standard_normal(32)
    rows = [(i, moved(middle, 0.98, rng)) for i in range(500)] + [(900 + i, rng.standard_normal(32)) for i in range(20)]
    got, want = run(spark, rows), brute([(i, np.asarray(x, np.float32)) for i, x in rows])
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
    assert [r[2] for r in got] == [r[2] for r in want]


def test_large_buckets_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(4)
    middle = rng.standard_normal(64)
    rows = [(i, moved(middle, 0.999, rng)) for i in range(200)] + [(500 + i, rng.standard_normal(64)) for i in range(50)]
    whole = run(spark, rows)
    monkeypatch.setattr(quantise, "PIECE", 16)
    monkeypatch.setattr(quantise, "BROADCAST_BUCKETS", 0)
    assert run(spark, rows) == whole == brute([(i, np.asarray(x, np.float32)) for i, x in rows])


def test_defined_cases(spark):
    a, b = [1.0, 2.0, 3.0, -1.0], [-3.0, 1.0, 0.5, 2.0]
    rows = [(5, a), (3, a), (3, a), (None, a), (7, None), (8, [0.0] * 4), (9, [1.0, None, 0.0, 0.0]), (10, [1.0, math.nan, 0.0, 0.0]), (11, [math.inf, 0.0, 0.0, 0.0]), (12, b), (13, []), (14, [1.0, 2.0, 3.0, -1.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, a)]) == [(1, 0, 1, True)]


def test_each_meeting_has_one_place():
    """Of all tables and keys where two codes meet, meets_first picks exactly one."""
    rng = np.random.default_rng(5)
    bits, tables = 6, 3
    steps = quantise.ball(bits)
    for _ in range(300):
        a = rng.integers(0, 1 << bits, (1, tables))
        b = a ^ rng.choice([0, 1, 2, 3, 5, 9, 33, 48, 63], (1, tables))
        places = [(t, int(k)) for t in range(tables) for k in set((a[0, t] ^ steps).tolist()) & set((b[0, t] ^ steps).tolist())]
        chosen = [p for p in places if quantise.meets_first(a, b, *p)[0]]
        assert len(chosen) == (1 if places else 0)


def test_codes_are_balanced():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 32)) * np.linspace(0.2, 2, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = quantise.rotation(x - x.mean(0), 32, rng)
    ones = ((x - x.mean(0)) @ turn > 0).mean(0)
    assert (abs(ones - 0.5) < 0.1).all()
    # the rotation is one: it keeps lengths
    assert np.allclose(turn.T @ turn, np.eye(32), atol=1e-8)
