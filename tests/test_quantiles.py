"""Exact quantiles against the sorted values."""

import random

import numpy as np
import pytest

from tidepool.operators import quantiles


@pytest.mark.parametrize("few", [20_000, 40])
def test_equal_the_sorted_values(spark, monkeypatch, few):
    """Heavy ties, long tails, few and no values; with few gathered values more passes."""
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(1)
    rows = []
    for i in range(8_000):
        k = rng.choice(["a", "a", "a", "b", None]) if i > 3 else "one"
        rows.append((k, rng.gauss(0, 1), 0.0 if rng.random() < 0.6 else rng.expovariate(1e-9), float(rng.randint(0, 5)) if rng.random() < 0.7 else None, None))
    df = spark.createDataFrame(rows, "k string, u double, tail double, ties double, gone double")
    columns, qs = ["u", "tail", "ties", "gone"], [0.0, 0.25, 0.6, 0.9999]
    for keys in ([], ["k"]) if few > 40 else (["k"],):
        got = {(*(r[k] for k in keys), r.column, r.q): (r.n, r.value) for r in quantiles.exact_quantiles(df, columns, qs, keys).collect()}
        groups = {()} if not keys else {(r[0],) for r in rows}
        for g in groups:
            for j, c in enumerate(columns, 1):
                values = [r[j] for r in rows if r[j] is not None and (not g or r[0] == g[0])]
                for q in qs:
                    n, value = got[(*g, c, q)]
                    assert n == len(values)
                    if values:
                        assert value == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12), (g, c, q)
                    else:
                        assert value is None
        assert len(got) == len(groups) * len(columns) * len(qs)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, u double")
    assert [(r.n, r.value) for r in quantiles.exact_quantiles(df, ["u"], [0.5]).collect()] == [(0, None)]
    assert quantiles.exact_quantiles(df, ["u"], [0.5], ["k"]).collect() == []
