"""Backtests in steps: the same states, to the last bit, as from all bars at once."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import increment as inc
from tidewheel.operators.frames import HORIZONS, align, as_bench
from tidewheel.sources import versions
from tidewheel.sources.backtests import BacktestStore
from tidewheel.sources.bars import BAR_COLUMNS, BAR_SCHEMA
from tidewheel.streaming.refresh import refresh_stream

FIRST = datetime(2022, 1, 1)


def walk(symbol, n, seed, begin=0, missing=()):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    wide = np.abs(rng.normal(0, 0.01, n)) * close
    return [(symbol, FIRST + timedelta(days=begin + k), float(c), float(c + w), float(c - w), float(c), 1)
            for k, (c, w) in enumerate(zip(close, wide)) if k not in missing]


def table(spark, rows):
    return spark.createDataFrame(rows, BAR_SCHEMA)


def all_bars():
    return [*walk("A", 420, 1), *walk("B", 310, 2, 60, missing={5, 200}), *walk(None, 230, 3), *walk("one", 1, 4), *walk("S", 420, 5)]


def states(df):
    """Rows as text, so that missing numbers are equal and all others are compared whole."""
    return {r.symbol: repr(r) for r in df.collect()}


def stored(spark, df):
    rows = df.collect()
    return spark.createDataFrame(rows, df.schema)


@pytest.mark.parametrize("test,aligned", [(inc.SIGNALS, False), (inc.TRANSITIONS, True)])
def test_portions_give_the_very_same_states(spark, test, aligned):
    bars = table(spark, all_bars())
    own = align(bars, as_bench(bars, "S")) if aligned else bars
    whole = states(inc.advance(inc.no_states(spark), own, test))
    assert set(whole) == {"A", "B", None, "one", "S"}
    cuts = [FIRST + timedelta(days=d) for d in (0, 1, 49, 200, 399, 418, 419, 420)]
    held = inc.no_states(spark)
    for low, high in zip(cuts, cuts[1:]):
        held = stored(spark, inc.advance(held, own.filter((F.col("dt") >= F.lit(low)) & (F.col("dt") < F.lit(high))), test))
    assert states(held) == whole
    # Bars that come again change nothing, and neither does an empty portion.
    assert states(inc.advance(held, own, test)) == whole
    assert states(inc.advance(held, own.limit(0), test)) == whole
    assert states(inc.follow(held, own, test)) == whole


def test_sums_are_those_of_a_plain_loop(spark):
    bars = all_bars()
    got = {r.symbol: r for r in inc.advance(inc.no_states(spark), table(spark, bars), inc.SIGNALS).collect()}
    for symbol in ("A", "B", None):
        rows = [r for r in bars if r[0] == symbol]
        cols = {c: np.array([r[k] for r in rows]) for c, k in (("high", 3), ("low", 4), ("close", 5))}
        out, close = inc.trend_fold()(cols), cols["close"].tolist()
        entries = [i for i in range(len(rows)) if out["trend"][i] == 1 and out["trend_prev"][i] != 1 and out["rsi"][i] > 45]
        state = got[symbol]
        assert (state.n_bars, state.n_entries, state.last_dt, state.last_close) == (len(rows), len(entries), rows[-1][1], close[-1])
        assert entries and (state.entry_dt, state.entry_close) == (rows[entries[-1]][1], close[entries[-1]])
        for k, h in enumerate(HORIZONS):
            gains = [(close[i + h] / close[i] - 1) * 100 for i in entries if i + h < len(close)]
            total = 0.0
            for g in gains:
                total += g
            assert (state.n_obs[k], state.hits[k], state.sums[k]) == (len(gains), sum(g > 0 for g in gains), total)


def test_only_a_rewritten_past_begins_anew(spark):
    bars = all_bars()
    old = [r for r in bars if r[1] < FIRST + timedelta(days=400)]
    marked = stored(spark, inc.advance(inc.no_states(spark), table(spark, old), inc.SIGNALS)).withColumn(
        "sums", F.transform("sums", lambda x: x + 1000.0))
    changed = [(*r[:5], r[5] * 1.5, r[6]) if r[0] == "B" and r[1] == FIRST + timedelta(days=100) else r for r in bars]
    late = [*changed, *[("one", FIRST - timedelta(days=3), 1.0, 1.0, 1.0, 1.0, 1)]]
    got = {r.symbol: r for r in inc.follow(marked, table(spark, late), inc.SIGNALS).collect()}
    fresh = {r.symbol: r for r in inc.advance(inc.no_states(spark), table(spark, late), inc.SIGNALS).collect()}
    # The mark in the sums tells which series went on from their states.
    assert {s for s, r in got.items() if r.sums[0] >= 900} == {"A", "S", None}
    assert repr(got["B"]) == repr(fresh["B"]) and repr(got["one"]) == repr(fresh["one"]) and got["one"].n_bars == 2
    # A series that has lost a bar of its past begins anew as well.
    short = inc.follow(marked, table(spark, [r for r in bars if r[0] == "A" and r[1] != FIRST]), inc.SIGNALS).collect()
    assert [(r.symbol, r.n_bars, r.sums[0] < 900) for r in short] == [("A", 419, True)]


def test_zero_and_missing_closes_and_empty_tables(spark):
    rows = walk("Z", 60, 9)
    for k in (10, 40):
        rows[k] = (*rows[k][:5], 0.0 if k == 10 else None, 1)
    rows.append(("Z", None, 1.0, 1.0, 1.0, 1.0, 1))
    whole = inc.advance(inc.no_states(spark), table(spark, rows), inc.SIGNALS)
    assert [r.n_bars for r in whole.collect()] == [60]
    held = inc.no_states(spark)
    for part in (rows[:11], rows[11:40], rows[40:]):
        held = stored(spark, inc.advance(held, table(spark, part), inc.SIGNALS))
    assert states(held) == states(whole)
    empty = table(spark, [])
    for test in (inc.SIGNALS, inc.TRANSITIONS):
        own = empty if test is inc.SIGNALS else align(empty, as_bench(empty, "S"))
        assert inc.follow(inc.no_states(spark), own, test).count() == 0
    assert inc.signal_report(inc.no_states(spark)).count() == inc.transition_report(inc.no_states(spark)).count() == 0
    with pytest.raises(Exception, match="two of one time"):
        inc.advance(inc.no_states(spark), table(spark, rows[:3] + rows[:1]), inc.SIGNALS).collect()


@pytest.mark.parametrize("benchmark", [None, "S"])
def test_a_store_takes_new_days(spark, tmp_path, benchmark):
    test = inc.TRANSITIONS if benchmark else inc.SIGNALS
    store = BacktestStore(spark, str(tmp_path / "states"), test, benchmark, parts=3)
    bars = table(spark, all_bars())
    own = align(bars, as_bench(bars, "S")) if benchmark else bars
    cut = F.lit(FIRST + timedelta(days=415))
    store.refresh(bars.filter(F.col("dt") < cut), bars.select("symbol"), "days", 0)
    store.append(bars.filter((F.col("dt") >= cut) & (F.col("dt") < F.date_add(cut, 1))), "days", 1)
    before = states(store.states())
    assert store.append(bars, "days", 1).version == 2 and states(store.states()) == before  # a batch that is in changes nothing
    store.append(bars.filter(F.col("dt") >= F.date_add(cut, 1)), "days", 2)
    assert states(store.states()) == states(inc.advance(inc.no_states(spark), own, test))
    store.append(table(spark, []))
    # A rewritten benchmark sets all series anew.
    other = bars.withColumn("close", F.when(F.col("symbol") == "S", F.col("close") + F.dayofyear("dt")).otherwise(F.col("close")))
    store.refresh(other, spark.createDataFrame([("S",)], "symbol string"))
    own = align(other, as_bench(other, "S")) if benchmark else other
    assert states(store.states()) == states(inc.advance(inc.no_states(spark), own, test))


def test_refresh_stream_carries_the_backtests(spark, tmp_path, monkeypatch):
    inbox, target = str(tmp_path / "in"), versions.bars_by_symbol(spark, str(tmp_path / "bars"))
    store = BacktestStore(spark, str(tmp_path / "states"), inc.SIGNALS, parts=2)
    rows = [*walk("A", 90, 1), *walk("B/x", 80, 2)]
    wanted = spark.createDataFrame([("A",), ("B/x",)], "symbol string")

    def land(days, day):
        table(spark, [r for r in rows if r[1] < FIRST + timedelta(days=days)]).write.mode("append").parquet(inbox)
        refresh_stream(spark, inbox, target, wanted, day, "2010-01-01", str(tmp_path / "checkpoint"), [store])

    land(70, date(2022, 3, 11))
    put, lost = versions.put_text, []

    def ends_once(session, path, text):
        if "/states/" in path and not lost:
            lost.append(path)
            raise RuntimeError("lost")
        put(session, path, text)

    monkeypatch.setattr(versions, "put_text", ends_once)
    with pytest.raises(Exception, match="lost"):  # the bars are in, the states are not
        land(90, date(2022, 3, 31))
    refresh_stream(spark, inbox, target, wanted, date(2022, 3, 31), "2010-01-01", str(tmp_path / "checkpoint"), [store])
    now = target.read().select(*BAR_COLUMNS)
    assert now.count() == 170 and states(store.states()) == states(inc.advance(inc.no_states(spark), now, inc.SIGNALS))
