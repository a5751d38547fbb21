"""The chain from swaps to labels against plain loops, and the models of folds against NumPy."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tests.test_operators import slow_prices, slow_tau
from tidepool.operators import chain, features, series

T0 = dt.datetime(2024, 1, 1)
SWAPS = "block_timestamp timestamp, block_number long, event_id long, token0 string, token1 string, amount0 double, amount1 double, token0_decimals int, token1_decimals int, pool string, tick long, liquidity double"


def swaps(n=1600):
    rng, now, out = random.Random(5), 0, []
    for e in range(n):
        now += rng.choice([60, 200, 900, 1500])
        t0, t1 = ("u", rng.choice("abc")) if rng.random() < 0.6 else rng.sample("abc", 2)
        a0, a1 = float(rng.randint(50, 300)), float(rng.randint(90, 110))
        sign = rng.choice([1, -1])
        out.append((e, now, t0, t1, a0 * sign, -a1 * sign, rng.randint(-30, 30), float(rng.randint(1, 10**6))))
    return out


def slow_chain(rows, ttl, low):
    """Bars with labels as dicts by (pool, bar_no)."""
    prices = defaultdict(list)
    for e, t, p in slow_prices([(e, s, t0, t1, abs(a0), abs(a1)) for e, s, t0, t1, a0, a1, *_ in rows], ttl):
        prices[e].append((t, p))
    pools = {}
    for e, s, t0, t1, a0, a1, tick, liq in rows:
        pools.setdefault(f"{t0}-{t1}", (t0, t1, []))
        if t0 == "u":
            pools[f"{t0}-{t1}"][2].append((s, e, t1, abs(a0) / abs(a1), abs(a0), math.copysign(1, a1), tick, liq))
        else:
            got = dict(prices[e])
            if got:
                volume = abs(a0) * got[t0] / 2
                pools[f"{t0}-{t1}"][2].extend([(s, e, t0, got[t0], volume, math.copysign(1, a0), tick, liq), (s, e, t1, got[t1], volume, math.copysign(1, a1), tick, liq)])
    days = defaultdict(lambda: defaultdict(float))
    for *_, own in pools.values():
        for s, _, t, _, v, *_ in own:
            days[t][s // 86400] += v
    mean = {t: sum(d.values()) / len(d) for t, d in days.items()}
    bars = []
    for pool, (a, b, own) in pools.items():
        limit = round(max(low, min(1e6, 0.001 * max(mean.get(a, 0.0), mean.get(b, 0.0)))) * 1e6)
        no, last, liquidity, held = 0, None, None, []
        for row in sorted(own, key=lambda r: (r[0], r[1])):
            held.append(row)
            liquidity = row[7]
            if sum(round(r[4] * 1e6) for r in held) < limit:
                continue
            price = {t: 1.0 if t == "u" else next((r[3] for r in reversed(held) if r[2] == t), None) for t in (a, b)}
            flow = {t: sum(r[5] * r[4] for r in held if r[2] == t) for t in (a, b)}
            if None not in price.values():
                src, dest = (a, b) if abs(flow[a]) > abs(flow[b]) else (b, a)
                bars.append({"pool": pool, "bar_no": no, "ts": row[0], "src": src, "dest": dest, "ps": price[src], "pd": price[dest], "ticks": len({r[:2] for r in held}), "delta": 0.0 if last is None else row[0] - last, "move": held[-1][6] - held[0][6], "liq": math.log1p(liquidity)})
            no, last, held = no + 1, row[0], []
    points = defaultdict(lambda: defaultdict(list))
    for x in bars:
        points[x["src"]][x["ts"]].append(x["ps"])
        points[x["dest"]][x["ts"]].append(x["pd"])
    known = {}
    for token, at in points.items():
        times = sorted(at)
        price = np.array([np.mean(at[s]) for s in times])
        logs, n = np.log(price), len(times)
        diff = np.full(n, np.nan)
        if logs.std() < 1e-6:
            diff = (logs - logs.mean()) / logs.std() if logs.std() > 1e-8 else np.zeros(n)
        else:
            for d in series.D_GRID:
                w = series.frac_weights(d)
                y = np.convolve(logs, w, "valid") if n >= len(w) else np.empty(0)
                if len(y) >= 20 and np.ptp(y) > 0 and slow_tau(y) < series.TAU_5:
                    diff[len(w) - 1 :] = (y - y.mean()) / y.std()
                    break
        span = (times[-1] - times[0]) / 86400
        h = 1 if n < 2 or span <= 0 else int(max(1, min(1000, math.floor(n / span * 0.5))))
        ret = np.append(0, np.diff(logs))
        label, touch, vol = [None] * n, [None] * n, [None] * n
        for i in range(n):
            if i >= 19:
                vol[i] = ret[i - 19 : i + 1].std(ddof=1)
            if n >= 20 + h and vol[i] and i + h < n:
                label[i], touch[i] = 0, h
                for k in range(1, h + 1):
                    if logs[i + k] >= logs[i] + 2 * vol[i] or logs[i + k] <= logs[i] - 2 * vol[i]:
                        label[i], touch[i] = (1 if logs[i + k] >= logs[i] + 2 * vol[i] else -1), k
                        break
        for i, s in enumerate(times):
            weight = None if touch[i] is None else 1 / sum(touch[j] is not None and j + touch[j] >= i for j in range(i + 1))
            known[token, s] = (None if np.isnan(diff[i]) else diff[i], vol[i], label[i], weight, touch[i])
    return {(x["pool"], x["bar_no"]): (x, known[x["src"], x["ts"]], known[x["dest"], x["ts"]]) for x in bars}


def test_chain_equals_the_loops(spark):
    rows = swaps()
    df = spark.createDataFrame([(T0 + dt.timedelta(seconds=s), s, e, t0, t1, a0 * 1e6, a1 * 1e6, 6, 6, f"{t0}-{t1}", tick, liq) for e, s, t0, t1, a0, a1, tick, liq in rows], SWAPS)
    want = slow_chain(rows, 4 * 3600, 500.0)
    got = {(r.pool, r.bar_no): r for r in chain.training_table(df, "u", 4 * 3600.0, 500.0).collect()}
    assert got.keys() == want.keys() and len(got) > 300
    close = lambda x, y: (x is None and y is None) or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6))
    for key, (x, src, dest) in want.items():
        r = got[key]
        assert (r.src_token_id, r.dest_token_id, r.tick_count) == (x["src"], x["dest"], x["ticks"]), key
        for a, b in ((r.src_price_usdc, x["ps"]), (r.dest_price_usdc, x["pd"]), (r.bar_time_delta_sec, x["delta"]), (r.src_tick_delta, x["move"]), (r.dest_liquidity_close, x["liq"])):
            assert close(a, b), key
        for a, b in zip((r.src_fracdiff, r.rolling_volatility, r.label, r.sample_weight, r.barrier_touch_bars), src):
            assert close(a, b), (key, src)
        for a, b in zip((r.dest_fracdiff, r.dest_label, r.dest_sample_weight, r.dest_barrier_touch_bars), (dest[0], *dest[2:])):
            assert close(a, b), (key, dest)
    assert {r.label for r in got.values()} >= {-1, 0, 1} and any(r.src_fracdiff for r in got.values())


def test_constant_tokens_keep_their_logs(spark):
    rows = [("flat", T0 + dt.timedelta(hours=i), 2.0) for i in range(50)] + [("pegged", T0 + dt.timedelta(hours=i), 1.0 + (i % 2) * 1e-7) for i in range(50)]
    out = series.stationary_series(spark.createDataFrame(rows, "token string, ts timestamp, price double")).collect()
    assert {r.d for r in out} == {series.CONSTANT_D} and {r.fracdiff for r in out if r.token == "flat"} == {0.0}
    assert sorted({round(r.fracdiff, 6) for r in out if r.token == "pegged"}) == [-1.0, 1.0]


def test_models_of_folds(spark):
    """Every trade day's model equals a discriminant fitted on the rows of the days before."""
    rng = np.random.default_rng(1)
    rows = []
    for day in range(12):
        for _ in range(0 if day == 4 else 30 if day == 6 else 60):
            label = int(rng.choice([0, 1, 2], p=[0.2, 0.5, 0.3]))
            x = rng.normal(size=12) + 0.8 * label
            x[6], x[3] = 5.0, x[3] * 1000  # one does not vary, one is on another scale
            rows.append((T0.date() + dt.timedelta(days=day), label, float(rng.random()) if rng.random() < 0.9 else None, *(float(v) for v in x)))
    rows[7] = (*rows[7][:4], float("nan"), *rows[7][5:])
    table = spark.createDataFrame(rows, "trade_date date, label_encoded int, sample_weight double, " + ", ".join(f"{c} double" for c in features.FEATURES))
    got = {r.fold: r for r in features.fold_models(table, 3).collect()}
    days = sorted({r[0] for r in rows})
    for k in range(3, len(days)):
        train = [r for r in rows if r[0] in days[k - 3 : k]]
        x = np.nan_to_num(np.array([r[3:] for r in train]))
        y, w = np.array([r[1] for r in train]), np.array([1.0 if r[2] is None else r[2] for r in train])
        w = w * np.array([len(y) / (3 * (y == c).sum()) for c in range(3)])[y]
        mean = [np.average(x[y == c], axis=0, weights=w[y == c]) for c in range(3)]
        spread = sum((w[y == c, None] * (x[y == c] - mean[c])).T @ (x[y == c] - mean[c]) for c in range(3)) / w.sum()
        live = np.diag(spread) > 1e-12
        for c in range(3):
            beta = np.zeros(12)
            s = np.sqrt(np.diag(spread)[live])
            beta[live] = np.linalg.solve(spread[np.ix_(live, live)] / np.outer(s, s) + 1e-6 * np.eye(live.sum()), mean[c][live] / s) / s
            bias = math.log(w[y == c].sum() / w.sum()) - 0.5 * beta @ mean[c]
            assert np.allclose(got[days[k]].coef[c * 12 : c * 12 + 12], beta, rtol=1e-6, atol=1e-9) and math.isclose(got[days[k]].bias[c], bias, rel_tol=1e-6, abs_tol=1e-9)
        assert got[days[k]].train_rows == len(train)
    assert set(features.fold_models(table, 3, 160).select("fold").toPandas()["fold"]) == {d for d in got if got[d].train_rows >= 160} != set(got)
    scored = features.predicted(table, features.fold_models(table, 3)).collect()
    assert len(scored) == sum(r[0] in got for r in rows) and all(math.isclose(r.p_down + r.p_none + r.p_up, 1) for r in scored)
    scores = features.fold_scores(table, 3).collect()
    assert {r.fold for r in scores} == set(got) and sum(r.support for r in scores) == len(scored)
    assert np.mean([r.prediction == r.label_encoded for r in scored]) > 0.6


def test_walk_forward_rules(spark):
    from tidepool.operators import folds

    rows = [(T0 + dt.timedelta(days=d, hours=h), d * 100 + h) for d in range(5) for h in ((10, 11, 12) if d == 3 else (3, 10, 20))]
    df = spark.createDataFrame(rows, "ts timestamp, id long")
    out = folds.walk_forward(df, "ts", 2, fall_back=True)
    by = lambda fold, split: sorted(r.id for r in out.where(f"day(fold) = {fold} and split = '{split}'").collect())
    assert by(3, "morning") == [203] and by(4, "morning") == by(4, "train") == [103, 110, 120, 203, 210, 220]
    assert folds.walk_forward(df, "ts", 2, least_train=7).count() == 0 and folds.walk_forward(df, "ts", 2, least_train=6).count() == folds.walk_forward(df, "ts", 2).count()
    w = {r.label: r.weight for r in folds.class_weights(spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int"), "label", [0, 1, 2]).collect()}
    assert w == {0: pytest.approx(8 / 18), 1: pytest.approx(8 / 6), 2: 1.0}
    floored = {r.label: r.weight for r in folds.class_weights(spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int"), "label", [0, 1, 2], floored=True).collect()}
    assert floored[2] == pytest.approx(8 / 3)
    ends = folds.temporal_split(df.limit(13), "ts", by_size=True).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in ends} == {"train": 9, "val": 1, "test": 3}
