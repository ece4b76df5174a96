"""Recurrences against plain loops, in blocks of any size."""

import math

import numpy as np
import pandas as pd
import pytest

from tidewheel.operators import recurrences as rec


def ema(values, alpha):
    out, last = [], None
    for v in values:
        last = v if last is None else (1 - alpha) * last + alpha * v
        out.append(last)
    return out


def plain_trend(high, low, close):
    """RSI, ATR, bands and trend by one loop."""
    n = len(close)
    reach = [high[0] - low[0]] + [max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(1, n)]
    atr, base = ema(reach, 2 / 14), ema(close, 2 / 56)
    gain = ema([max(close[i] - close[i - 1], 0) for i in range(1, n)], 1 / 13)
    loss = ema([max(close[i - 1] - close[i], 0) for i in range(1, n)], 1 / 13)
    rsi = [math.nan] + [100 - 100 / (1 + g / (x + 1e-9)) for g, x in zip(gain, loss)]
    rel = [a / b for a, b in zip(atr, base)]
    up, dn, trend = [], [], []
    for i in range(n):
        if i >= 49:
            lo, hi = min(rel[i - 49: i + 1]), max(rel[i - 49: i + 1])
            mult = min(max(1 + 4 * (rel[i] - lo) / (hi - lo + 1e-9), 1), 5)
        else:
            mult = math.nan
        u, d = (high[i] + low[i]) / 2 - mult * atr[i], (high[i] + low[i]) / 2 + mult * atr[i]
        if i:
            if close[i - 1] > up[-1]:
                u = max(u, up[-1]) if u == u else u
            if close[i - 1] < dn[-1]:
                d = min(d, dn[-1]) if d == d else d
        t = 1 if i == 0 or close[i] > dn[-1] else -1 if close[i] < up[-1] else trend[-1]
        up.append(u)
        dn.append(d)
        trend.append(t)
    return rsi, atr, up, dn, trend


def in_blocks(fold, cols, size):
    step, parts = fold(), []
    for at in range(0, len(cols["close"]), size):
        parts.append(pd.DataFrame(step({k: v[at: at + size] for k, v in cols.items()})))
    return pd.concat(parts, ignore_index=True)


def series(kind, n=700):
    rng = np.random.default_rng(3)
    close = {
        "walk": 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), "drift": 100 * 1.0001 ** np.arange(n), "rise": 100.0 + np.arange(n),
        "fall": 1000.0 - np.arange(n), "flat": np.full(n, 50.0)}[kind]
    wide = np.abs(rng.normal(0, 0.01, n)) * close
    return {"high": close + wide, "low": close - wide, "close": close}


@pytest.mark.parametrize("kind", ["walk", "drift", "rise", "fall", "flat"])
@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_trend_is_the_same_in_any_blocks(kind, size):
    cols = series(kind)
    got = in_blocks(rec.trend_fold, cols, size)
    rsi, atr, up, dn, trend = plain_trend(*(cols[c].tolist() for c in ("high", "low", "close")))
    for name, want in (("rsi", rsi), ("atr", atr), ("band_up", up), ("band_dn", dn), ("trend", trend)):
        np.testing.assert_allclose(got[name], want, rtol=1e-9, err_msg=name)
    assert got["trend_prev"].tolist() == [0, *trend[:-1]]


@pytest.mark.parametrize("size", [1, 5, 64])
def test_blocks_give_the_very_same_numbers(size):
    cols = series("walk")
    pd.testing.assert_frame_equal(in_blocks(rec.trend_fold, cols, size), in_blocks(rec.trend_fold, cols, 10_000), check_exact=True)
    cols = {"close": cols["close"], "bench_close": series("drift")["close"]}
    pd.testing.assert_frame_equal(in_blocks(rec.rotation_fold, cols, size), in_blocks(rec.rotation_fold, cols, 10_000), check_exact=True)


def test_gaps_weaken_the_last_value_across_blocks():
    values = np.array([1.0, np.nan, np.nan, 4.0, np.nan, 2.0, 8.0])
    whole = rec.Smoother(0.3)(values)
    smooth = rec.Smoother(0.3)
    np.testing.assert_array_equal(np.concatenate([smooth(values[i: i + 2]) for i in range(0, 7, 2)]), whole)


def test_zero_and_missing_prices_do_not_stop_the_fold():
    cols = series("walk", 120)
    cols["close"][5], cols["close"][60] = 0.0, np.nan
    assert len(in_blocks(rec.trend_fold, cols, 16)) == 120


def test_a_long_series_is_linear():
    n = 200_000
    cols = series("drift", n)
    assert len(in_blocks(rec.trend_fold, cols, 10_000)) == n
