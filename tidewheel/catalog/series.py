"""Queries over bars: scans, windows, recurrences, backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.catalog.inputs import BENCH, aligned, bar_store, day, own, stamp, stored_bars
from tidewheel.catalog.registry import query
from tidewheel.catalog.sql import _LEAD, rnd
from tidewheel.catalog.sql import day as sql_day
from tidewheel.functions.labels import hit_grade, quadrant, signal_context, volatility_bucket
from tidewheel.functions.numbers import clip, pct_change, round_to
from tidewheel.operators import backtest as bt
from tidewheel.operators import increment as inc
from tidewheel.operators import recurrences as rec
from tidewheel.operators import scan
from tidewheel.operators.frames import MIN_BARS, as_bench, align, rotation_frame, trend_frame
from tidewheel.operators.layout import WHOLE, Layout, arrange, number_rows, rolling, series_window
from tidewheel.plans.rotation import rotation_summary, trend_summary
from tidewheel.session import materialize, new_path
from tidewheel.sources import bars as b
from tidewheel.sources import tables as t
from tidewheel.sources.dimensions import all_symbols

SPLIT = Layout(block_rows=64)
D = sql_day()


@query("symbol_universe", "SELECT 'ALL' AS symbol UNION SELECT r_name FROM region UNION SELECT n_name FROM nation")
def symbol_universe(spark: SparkSession, d: str) -> DataFrame:
    return all_symbols(t.universe_dim(spark, d), t.sector_dim(spark, d), BENCH)


@query("membership_dimension", "SELECT etf, ticker, etf_ord, ord FROM universe")
def membership_dimension(spark: SparkSession, d: str) -> DataFrame:
    return t.universe_dim(spark, d).select("etf", "ticker", "etf_ord", "ord")


@query("daily_bars", f"SELECT symbol, {D} AS dt, open, high, low, close, volume FROM bars")
def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    return t.order_bars(spark, d).select("symbol", day(), "open", "high", "low", "close", "volume")


@query("hourly_event_bars",
       "SELECT symbol, strftime(dt, '%Y-%m-%d %H:%M') AS dt, open, high, low, close, volume FROM ebars")
def hourly_event_bars(spark: SparkSession, d: str) -> DataFrame:
    return t.event_bars(spark, d).select("symbol", stamp(), "open", "high", "low", "close", "volume")


@query("bar_csv_scan", f"SELECT symbol, {D} AS dt, open, high, low, close, volume FROM bars")
def bar_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Bars written as CSV with capitalised headers and zoned times, then scanned back."""
    path = new_path(spark, "bar-csv")
    text = t.order_bars(spark, d).select(
        "symbol", F.concat(F.date_format("dt", "yyyy-MM-dd HH:mm:ss"), F.lit("-05:00")).alias("Date"),
        *[F.col(c).alias(c.capitalize()) for c in [*b.PRICES, "volume"]])
    text.write.partitionBy("symbol").option("header", True).csv(path)
    return b.read_bar_csv(spark, path).select("symbol", day(), *b.PRICES, "volume")


@query("complete_bars", """SELECT symbol, count(*) AS n FROM (
  SELECT event_type AS symbol FROM events WHERE value IS NOT NULL AND ts IS NOT NULL) GROUP BY symbol""")
def complete_bars(spark: SparkSession, d: str) -> DataFrame:
    ticks = t.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").alias("dt"),
        *[F.col("value").alias(c) for c in b.PRICES], F.col("event_id").alias("volume"))
    return b.drop_incomplete(ticks).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("history_gates", """
SELECT symbol, count(*) AS n, count(*) >= 200 AS enough_own, count(*) > 200 AS enough_pair,
       count(*) >= 300 AS enough_transitions, count(*) >= 5 AS enough_prices FROM bars GROUP BY symbol""")
def history_gates(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return t.order_bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).select(
        "symbol", "n", (n >= 200).alias("enough_own"), (n > 200).alias("enough_pair"),
        (n >= 300).alias("enough_transitions"), (n >= 5).alias("enough_prices"))


@query("data_as_of", "SELECT strftime(max(dt), '%Y-%m-%d') AS as_of FROM bars WHERE symbol = 'ALL'")
def data_as_of(spark: SparkSession, d: str) -> DataFrame:
    return b.data_as_of(t.order_bars(spark, d), BENCH).select(day("as_of"))


@query("recent_history", f"""SELECT symbol, {D} AS dt, close FROM bars
WHERE dt >= (SELECT max(dt) FROM bars WHERE symbol = 'ALL') - INTERVAL 3 MONTH""")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    """From the store by month, of which only the last months are read."""
    return bar_store(spark, d).recent(BENCH).select("symbol", day(), "close")


@query("aligned_bars", f"SELECT symbol, {D} AS dt, close, bench_close FROM joined")
def aligned_bars(spark: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(spark, d)
    return align(bars, as_bench(bars, BENCH)).select("symbol", day(), "close", "bench_close")


@query("sector_aligned_bars", """
SELECT string_split(k, '|')[1] AS etf, symbol AS ticker, count(*) AS n, sum(CAST(round(close * 100) AS BIGINT))::BIGINT
  AS close_cents, sum(CAST(round(bench_close * 100) AS BIGINT))::BIGINT AS bench_cents FROM pair_joined GROUP BY ALL""")
def sector_aligned_bars(spark: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(spark, d)
    stock = t.universe_dim(spark, d).select("etf", "ticker").join(bars.withColumnRenamed("symbol", "ticker"), "ticker")
    sector = bars.select(F.col("symbol").alias("etf"), "dt", F.col("close").alias("bench_close"))
    cents = {n: F.sum(F.round(F.col(c) * 100).cast("bigint")) for n, c in
             (("close_cents", "close"), ("bench_cents", "bench_close"))}
    return align(stock, sector, ("etf", "dt")).groupBy("etf", "ticker").agg(
        F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in cents.items()])


@query("membership_bars", """SELECT u.etf, u.ticker, count(*) AS n, max(close) AS top
FROM universe u JOIN bars b ON b.symbol = u.ticker GROUP BY ALL""")
def membership_bars(spark: SparkSession, d: str) -> DataFrame:
    per_symbol = t.order_bars(spark, d).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.max("close").alias("top"))
    return t.universe_dim(spark, d).join(per_symbol.withColumnRenamed("symbol", "ticker"), "ticker").select(
        "etf", "ticker", "n", "top")


# Windows ----------------------------------------------------------------------


@query("bar_changes", f"""SELECT symbol, {D} AS dt, {rnd("close - lag(close) OVER w", 2)} AS diff,
  {rnd("(close / lag(close) OVER w - 1) * 100", 3)} AS ch1, {rnd("(close / lag(close, 10) OVER w - 1) * 100", 3)} AS ch10
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)""")
def bar_changes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("dt")
    close = F.col("close")
    return t.order_bars(spark, d).select(
        "symbol", day(), round_to(close - F.lag(close).over(w), 2).alias("diff"),
        round_to(pct_change(close, F.lag(close).over(w)), 3).alias("ch1"),
        round_to(pct_change(close, F.lag(close, 10).over(w)), 3).alias("ch10"))


@query("rolling_statistics", f"""SELECT symbol, {D} AS dt,
  CASE WHEN pos >= 19 THEN {rnd("avg(volume) OVER (w ROWS 19 PRECEDING)", 2)} END AS vol_mean20,
  CASE WHEN pos >= 49 THEN min(close) OVER (w ROWS 49 PRECEDING) END AS low50,
  CASE WHEN pos >= 49 THEN max(close) OVER (w ROWS 49 PRECEDING) END AS high50
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS pos FROM bars)
WINDOW w AS (PARTITION BY symbol ORDER BY dt)""")
def rolling_statistics(spark: SparkSession, d: str) -> DataFrame:
    w = series_window()
    return t.order_bars(spark, d).select(
        "symbol", day(), round_to(rolling(F.avg("volume"), 20, w, F.col("volume")), 2).alias("vol_mean20"),
        rolling(F.min("close"), 50, w, F.col("close")).alias("low50"),
        rolling(F.max("close"), 50, w, F.col("close")).alias("high50"))


@query("row_numbers_split", f"""SELECT symbol, {D} AS dt, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS pos,
  count(*) OVER (PARTITION BY symbol) AS n_bars FROM bars""")
def row_numbers_split(spark: SparkSession, d: str) -> DataFrame:
    numbered = number_rows(stored_bars(spark, d), ["symbol"], "dt", 90 * 86400)
    return numbered.select("symbol", day(), F.col("pos").cast("bigint").alias("pos"), "n_bars")


@query("ema_series", f"SELECT symbol, {D} AS dt, {rnd('ema50', 3)} AS ema50 FROM rot")
def ema_series(spark: SparkSession, d: str) -> DataFrame:
    frame = arrange(t.order_bars(spark, d))
    return rec.with_smoothing(frame, {"ema50": ("close", rec.span_alpha(50))}).select(
        "symbol", day(), round_to(F.col("ema50"), 3).alias("ema50"))


@query("rsi_series", f"SELECT symbol, {D} AS dt, {rnd('rsi', 4)} AS rsi FROM smoothed")
def rsi_series(spark: SparkSession, d: str) -> DataFrame:
    return own(spark, d, 1).select("symbol", day(), round_to(F.col("rsi"), 4).alias("rsi"))


@query("atr_series", f"SELECT symbol, {D} AS dt, {rnd('atr', 3)} AS atr, {rnd('ema55', 3)} AS ema55 FROM smoothed")
def atr_series(spark: SparkSession, d: str) -> DataFrame:
    return own(spark, d, 1).select("symbol", day(), round_to(F.col("atr"), 3).alias("atr"),
                                round_to(F.col("ema55"), 3).alias("ema55"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars in blocks of few rows, so that a series has many."""
    return scan.blocks(t.order_bars(spark, d), rows=250)


@query("ema_series_scan", f"SELECT symbol, {D} AS dt, {rnd('ema50', 3)} AS ema50 FROM rot")
def ema_series_scan(spark: SparkSession, d: str) -> DataFrame:
    """The smoothing of each series over many tasks."""
    return scan.smoothed(_blocks(spark, d), {"ema50": ("close", rec.span_alpha(50))}).select(
        "symbol", day(), round_to(F.col("ema50"), 3).alias("ema50"))


@query("rsi_series_scan", f"SELECT symbol, {D} AS dt, {rnd('rsi', 4)} AS rsi FROM smoothed")
def rsi_series_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.strength_index(_blocks(spark, d)).select("symbol", day(), round_to(F.col("rsi"), 4).alias("rsi"))


@query("atr_series_scan", f"SELECT symbol, {D} AS dt, {rnd('atr', 3)} AS atr, {rnd('ema55', 3)} AS ema55 FROM smoothed")
def atr_series_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.true_range(_blocks(spark, d)).select(
        "symbol", day(), round_to(F.col("atr"), 3).alias("atr"), round_to(F.col("ema55"), 3).alias("ema55"))


@query("rs_line", f"SELECT symbol, {D} AS dt, {rnd('100 * close / bench_close', 4)} AS rs FROM joined")
def rs_line(spark: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(spark, d)
    rs = F.try_divide(100 * F.col("close"), F.col("bench_close"))
    return align(bars, as_bench(bars, BENCH)).select("symbol", day(), round_to(rs, 4).alias("rs"))


_RRG_SQL = f"SELECT symbol, {D} AS dt, {rnd('ratio', 4)} AS ratio, {rnd('mom', 4)} AS mom, quad FROM rot"


def _rrg_rows(frame: DataFrame) -> DataFrame:
    return frame.select("symbol", day(), round_to(F.col("ratio"), 4).alias("ratio"),
                        round_to(F.col("mom"), 4).alias("mom"), "quad")


@query("rrg_series", _RRG_SQL)
def rrg_series(spark: SparkSession, d: str) -> DataFrame:
    return _rrg_rows(aligned(spark, d, 1))


@query("rrg_series_split", _RRG_SQL)
def rrg_series_split(spark: SparkSession, d: str) -> DataFrame:
    """The same series in many small blocks."""
    bars = stored_bars(spark, d)
    return _rrg_rows(rotation_frame(bars, as_bench(bars, BENCH), SPLIT, min_bars=1))


@query("rrg_series_scan", _RRG_SQL)
def rrg_series_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same over many tasks a series."""
    bars = stored_bars(spark, d)
    frame = scan.blocks(align(bars, as_bench(bars, BENCH)), rows=250)
    return _rrg_rows(scan.rotation(frame).withColumn("quad", quadrant(F.col("ratio"), F.col("mom"))))


@query("sector_rrg_snapshot", f"""SELECT s.etf, s.name, {rnd('ratio', 3)} AS rs_ratio, {rnd('mom', 3)} AS rs_mom, quad,
  {D} AS dt FROM rot r JOIN sectors s ON s.etf = r.symbol WHERE pos = n - 1""")
def sector_rrg_snapshot(spark: SparkSession, d: str) -> DataFrame:
    bars, sectors = stored_bars(spark, d), t.sector_dim(spark, d)
    members = bars.join(sectors.select(F.col("etf").alias("symbol")), "symbol", "left_semi")
    last = rotation_frame(members, as_bench(bars, BENCH), WHOLE).groupBy("symbol").agg(
        F.max_by(F.struct("ratio", "mom", "quad", "dt"), "pos").alias("last"))
    return sectors.join(last, F.col("etf") == F.col("symbol")).select(
        "etf", "name", round_to(F.col("last.ratio"), 3).alias("rs_ratio"),
        round_to(F.col("last.mom"), 3).alias("rs_mom"), F.col("last.quad").alias("quad"),
        F.date_format("last.dt", "yyyy-MM-dd").alias("dt"))


@query("quadrant_history", """SELECT symbol, quad, count(*) AS n FROM rot GROUP BY ALL""")
def quadrant_history(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d, 1).groupBy("symbol", quadrant(F.col("ratio"), F.col("mom")).alias("quad")).agg(
        F.count(F.lit(1)).alias("n"))


@query("band_multiplier", f"SELECT symbol, {D} AS dt, {rnd('mult', 4)} AS mult FROM banded")
def band_multiplier(spark: SparkSession, d: str) -> DataFrame:
    return own(spark, d).select("symbol", day(), round_to(F.col("mult"), 4).alias("mult"))


@query("band_multiplier_windows", f"SELECT symbol, {D} AS dt, {rnd('mult', 4)} AS mult FROM banded")
def band_multiplier_windows(spark: SparkSession, d: str) -> DataFrame:
    """The multiplier from ATR and base line by rolling window frames."""
    frame = own(spark, d).withColumn("rel", F.coalesce(F.try_divide("atr", "ema55"), F.lit(0.0)))
    w = series_window()
    low, high = (rolling(f("rel"), 50, w, F.col("rel")) for f in (F.min, F.max))
    scaled = 1 + 4 * (F.col("rel") - low) / (high - low + rec.EPSILON)
    mult = F.when(low.isNotNull(), clip(scaled, rec.MIN_MULT, rec.MAX_MULT))
    return frame.select("symbol", day(), round_to(mult, 4).alias("mult"))


_TREND_SQL = f"""SELECT symbol, {D} AS dt, {rnd('up', 2)} AS band_up, {rnd('dn', 2)} AS band_dn, trend,
  {rnd('rsi', 4)} AS rsi, entry FROM trend"""


def _trend_rows(frame: DataFrame) -> DataFrame:
    return frame.select("symbol", day(), round_to(F.col("band_up"), 2).alias("band_up"),
                        round_to(F.col("band_dn"), 2).alias("band_dn"), "trend",
                        round_to(F.col("rsi"), 4).alias("rsi"), bt.signal_entry().alias("entry"))


@query("trend_series", _TREND_SQL)
def trend_series(spark: SparkSession, d: str) -> DataFrame:
    return _trend_rows(own(spark, d))


@query("trend_series_split", _TREND_SQL)
def trend_series_split(spark: SparkSession, d: str) -> DataFrame:
    return _trend_rows(trend_frame(stored_bars(spark, d), SPLIT))


@query("trend_signal", "SELECT symbol, coalesce(signal, 'FLAT') AS signal FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN trend_sum USING (symbol)")
def trend_signal(spark: SparkSession, d: str) -> DataFrame:
    """Short series have no trend and are FLAT."""
    buy = bt.is_buy() & (F.col("n_bars") >= MIN_BARS)
    return own(spark, d, 1).groupBy("symbol").agg(bt.at_last(buy).alias("_buy")).select(
        "symbol", F.when(F.col("_buy"), "BUY").otherwise("FLAT").alias("signal"))


@query("volume_surge", "SELECT symbol, coalesce(vol_surge, false) AS vol_surge FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN trend_sum USING (symbol)")
def volume_surge(spark: SparkSession, d: str) -> DataFrame:
    w = series_window()
    frame = arrange(t.order_bars(spark, d)).withColumn(
        "vol_mean20", rolling(F.avg("volume"), 20, w, F.col("volume")))
    surge = bt.volume_over_mean(1.5) & (F.col("n_bars") >= MIN_BARS)
    return frame.groupBy("symbol").agg(bt.at_last(surge).alias("vol_surge"))


@query("four_factors", "SELECT symbol, f_price, f_volume, f_roc, f_mom, n_sigs, level FROM rot_last")
def four_factors(spark: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(spark, d)
    return rotation_summary(bars, as_bench(bars, BENCH)).select(
        "symbol", "f_price", "f_volume", "f_roc", "f_mom", "n_sigs", "level")


@query("leading_entries", f"SELECT symbol, {D} AS dt, pos = 0 AS is_seed FROM rot WHERE n >= 200 AND {_LEAD}")
def leading_entries(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).filter(bt.leading_entry()).select("symbol", day(), (F.col("pos") == 0).alias("is_seed"))


@query("signal_entries", f"SELECT symbol, {D} AS dt, {rnd('rsi', 4)} AS rsi FROM trend WHERE entry")
def signal_entries(spark: SparkSession, d: str) -> DataFrame:
    return own(spark, d).filter(bt.signal_entry()).select("symbol", day(), round_to(F.col("rsi"), 4).alias("rsi"))


@query("entry_gate", """SELECT symbol, count(*) FILTER (WHERE entry) AS n_signals FROM trend GROUP BY symbol
HAVING count(*) FILTER (WHERE entry) >= 3""")
def entry_gate(spark: SparkSession, d: str) -> DataFrame:
    counts = own(spark, d).groupBy("symbol").agg(F.count(F.when(bt.signal_entry(), 1)).alias("n_signals"))
    return counts.filter(F.col("n_signals") >= bt.MIN_ENTRIES)


@query("forward_returns", f"""SELECT symbol, {D} AS dt, {rnd('fwd_5', 3)} AS fwd_5, {rnd('fwd_10', 3)} AS fwd_10,
  {rnd('fwd_20', 3)} AS fwd_20, {rnd('fwd_30', 3)} AS fwd_30 FROM own""")
def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    from tidewheel.operators.frames import forward_returns as fwd

    frame = arrange(t.order_bars(spark, d)).withColumns(fwd(series_window()))
    return frame.select("symbol", day(), *[round_to(F.col(c), 3).alias(c) for c in
                                           ("fwd_5", "fwd_10", "fwd_20", "fwd_30")])


_STATS = ", ".join(f"{k}_{h}d" for h in (5, 10, 20, 30) for k in ("hit", "avg", "n_obs"))


@query("transition_backtest", f"SELECT symbol, n_entries, {_STATS}, days_in_leading FROM transitions")
def transition_backtest(spark: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(spark, d)
    return rotation_summary(bars, as_bench(bars, BENCH)).select(
        "symbol", "n_entries", *bt.stat_names(), "days_in_leading")


@query("days_in_leading", "SELECT symbol, days_in_leading FROM transitions WHERE days_in_leading IS NOT NULL")
def days_in_leading(spark: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(spark, d)
    return rotation_summary(bars, as_bench(bars, BENCH)).select("symbol", "days_in_leading").dropna()


@query("signal_backtest", f"SELECT symbol, n_signals, {_STATS}, days_active, current_ret FROM trend_sum")
def signal_backtest(spark: SparkSession, d: str) -> DataFrame:
    return trend_summary(t.order_bars(spark, d)).select(
        "symbol", "n_signals", *bt.stat_names(), "days_active", "current_ret")


def _in_two_steps(bars: DataFrame, test: inc.Backtest) -> DataFrame:
    """States after the bars but those of the last 60 days, which then go on with whole histories: all known bars are as they were."""
    first_new = F.date_sub(b.data_as_of(bars, BENCH).scalar(), 60).cast("timestamp")
    spark = bars.sparkSession
    states = materialize(inc.advance(inc.no_states(spark), bars.filter(F.col("dt") < first_new), test), "states")
    return inc.follow(states, bars, test)


@query("signal_backtest_steps", f"SELECT symbol, n_signals, {_STATS}, days_active, current_ret FROM trend_sum")
def signal_backtest_steps(spark: SparkSession, d: str) -> DataFrame:
    return inc.signal_report(_in_two_steps(stored_bars(spark, d), inc.SIGNALS))


@query("transition_backtest_steps", f"SELECT symbol, n_entries, {_STATS}, days_in_leading FROM transitions")
def transition_backtest_steps(spark: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(spark, d)
    return inc.transition_report(_in_two_steps(align(bars, as_bench(bars, BENCH)), inc.TRANSITIONS))


@query("signal_age", """SELECT symbol, days_active, current_ret,
  CASE WHEN current_ret / avg_20d * 100 > 120 THEN 'extended'
       WHEN current_ret / avg_20d * 100 < 20 AND days_active <= 20 THEN 'room to run' END AS context,
  CASE WHEN hit_20d >= 60 THEN 'good' WHEN hit_20d >= 45 THEN 'fair' WHEN hit_20d IS NOT NULL THEN 'poor' END AS grade
FROM trend_sum WHERE days_active IS NOT NULL""")
def signal_age(spark: SparkSession, d: str) -> DataFrame:
    """Age and move of the running signal, in the context of its history."""
    return trend_summary(t.order_bars(spark, d)).filter(F.col("days_active").isNotNull()).select(
        "symbol", "days_active", "current_ret",
        signal_context(F.col("current_ret"), F.col("avg_20d"), F.col("days_active")).alias("context"),
        hit_grade(F.col("hit_20d")).alias("grade"))


@query("hit_grades", """SELECT symbol, hit_20d,
  CASE WHEN hit_20d >= 60 THEN 'good' WHEN hit_20d >= 45 THEN 'fair' WHEN hit_20d IS NOT NULL THEN 'poor' END AS grade
FROM transitions""")
def hit_grades(spark: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(spark, d)
    return rotation_summary(bars, as_bench(bars, BENCH)).select(
        "symbol", "hit_20d", hit_grade(F.col("hit_20d")).alias("grade"))


@query("annual_volatility", f"""SELECT symbol, {rnd('v', 1)} AS ann_vol,
  CASE WHEN v < 20 THEN 'Low' WHEN v < 35 THEN 'Medium' ELSE 'High' END AS vol_bucket FROM (
  SELECT symbol, stddev_samp(ret) * sqrt(252e0) * 100 AS v FROM (
    SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret FROM bars) GROUP BY symbol)""")
def annual_volatility(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("dt")
    returns = t.order_bars(spark, d).select(
        "symbol", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("ret"))
    vol = F.col("v")
    return returns.groupBy("symbol").agg(bt.annual_volatility().alias("v")).select(
        "symbol", round_to(vol, 1).alias("ann_vol"), volatility_bucket(vol).alias("vol_bucket"))


@query("year_return", f"""SELECT symbol,
  {rnd("(arg_max(close, pos) / any_value(CASE WHEN pos = n - 1 THEN close_year_ago END) - 1) * 100", 1)} AS ret_1y
FROM own GROUP BY symbol""")
def year_return(spark: SparkSession, d: str) -> DataFrame:
    w = series_window()
    frame = arrange(t.order_bars(spark, d)).withColumn("close_year_ago", F.lag("close", 251).over(w))
    return frame.groupBy("symbol").agg(bt.year_return().alias("ret_1y"))


@query("rrg_trail", "SELECT symbol, back, ratio, mom FROM trails")
def rrg_trail(spark: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(spark, d)
    trail = rotation_summary(bars, as_bench(bars, BENCH)).select("symbol", F.posexplode("trail").alias("i", "p"))
    back = F.when(F.col("i") < 8, 40 - 5 * F.col("i")).otherwise(1).cast("bigint")
    return trail.select("symbol", back.alias("back"), "p.ratio", "p.mom")


@query("last_bars", f"""SELECT symbol, max({D}) AS dt, arg_max(close, dt) AS close, arg_max(volume, dt) AS volume
FROM bars GROUP BY symbol""")
def last_bars(spark: SparkSession, d: str) -> DataFrame:
    last = t.order_bars(spark, d).groupBy("symbol").agg(F.max_by(F.struct("dt", "close", "volume"), "dt").alias("l"))
    return last.select("symbol", F.date_format("l.dt", "yyyy-MM-dd").alias("dt"), "l.close", "l.volume")
