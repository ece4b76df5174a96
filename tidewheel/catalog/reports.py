"""Queries over scored tables: sectors, members, buckets, lookup, boards, refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.catalog.inputs import BENCH, drilldown, lookup_table, sector_table, stored_bars
from tidewheel.catalog.registry import query
from tidewheel.catalog.sql import CTES, json_of, rnd
from tidewheel.functions.labels import ticker_label
from tidewheel.plans import lookup, metals, rotation, signals
from tidewheel.plans.events import filter_by_metal
from tidewheel.plans.metals import COMPANY_HORIZONS, METAL_HORIZONS
from tidewheel.sources import bars as b
from tidewheel.sources import sinks
from tidewheel.sources import tables as t
from tidewheel.sources.versions import bars_by_symbol, spread_by
from tidewheel.streaming.refresh import refresh_stream

_STATS = ", ".join(f"{k}_{h}d" for h in (5, 10, 20, 30) for k in ("hit", "avg", "n_obs"))
_FACTORS = "f_price, f_volume, f_roc, f_mom, n_sigs, level"
_SECTOR = (f"etf, name, quad, rs_ratio, rs_mom, signal, vol_surge, {_FACTORS}, score, alert, ret_1y, vol_bucket, "
           f"ann_vol, reason, n_entries, {_STATS}, days_in_leading")
_STOCK = (f"etf, ticker, name, quad, quad_sec, signal, vol_surge, {_FACTORS}, score, rec, ret_1y, vol_bucket, ann_vol, "
          f"reason, n_signals, {_STATS}, days_active, current_ret")


def _columns(text: str) -> list[str]:
    return [c.strip() for c in text.split(",")]


def _stock_rows(ranked: DataFrame, columns: str = _STOCK) -> DataFrame:
    return ranked.withColumnRenamed("quad_spy", "quad").select(*_columns(columns))


# Sectors ----------------------------------------------------------------------


@query("sector_rotation", f"SELECT {_SECTOR} FROM rotation")
def sector_rotation(spark: SparkSession, d: str) -> DataFrame:
    return rotation.ranked_sectors(sector_table(spark, d)).select(*_columns(_SECTOR))


@query("sector_scores", f"SELECT etf, quad, signal, {_FACTORS}, score, alert FROM rotation")
def sector_scores(spark: SparkSession, d: str) -> DataFrame:
    return sector_table(spark, d).select(*_columns(f"etf, quad, signal, {_FACTORS}, score, alert"))


@query("drill_sectors", "SELECT etf, name, score FROM rotation WHERE score >= 6")
def drill_sectors(spark: SparkSession, d: str) -> DataFrame:
    return rotation.rotating(sector_table(spark, d)).select("etf", "name", "score")


@query("rotating_members", """SELECT u.etf, u.ticker FROM universe u
WHERE u.etf IN (SELECT etf FROM rotation WHERE score >= 6)""")
def rotating_members(spark: SparkSession, d: str) -> DataFrame:
    chosen = rotation.rotating(sector_table(spark, d)).select("etf")
    return t.universe_dim(spark, d).join(chosen, "etf", "left_semi").select("etf", "ticker")


@query("report_counters", """SELECT count(*) FILTER (WHERE alert LIKE '%ROTATING%') AS n_rotating,
  count(*) FILTER (WHERE quad = 'Improving' AND alert NOT LIKE '%ROTATING%') AS n_improving,
  count(*) FILTER (WHERE quad = 'Weakening') AS n_weakening, count(*) FILTER (WHERE quad = 'Lagging') AS n_lagging
FROM rotation""")
def report_counters(spark: SparkSession, d: str) -> DataFrame:
    return signals.report_counters(sector_table(spark, d))


@query("quadrant_groups", """SELECT quad, string_agg(etf || ' ' || printf('%.3f', rs_ratio) || ' ' ||
  printf('%.3f', rs_mom), '; ' ORDER BY score DESC, ord) AS points FROM rotation GROUP BY quad""")
def quadrant_groups(spark: SparkSession, d: str) -> DataFrame:
    point = F.transform("points", lambda p: F.format_string("%s %.3f %.3f", p["label"], p["x"], p["y"]))
    return signals.quadrant_groups(sector_table(spark, d)).select("quad", F.array_join(point, "; ").alias("points"))


_POINT = "{'x': round(rs_ratio, 2), 'y': round(rs_mom, 2), 'label': etf}"


@query("quadrant_payload", f"""SELECT {json_of("quad", "points")} FROM (
  SELECT quad, list({_POINT} ORDER BY score DESC, ord) AS points FROM rotation GROUP BY quad)""")
def quadrant_payload(spark: SparkSession, d: str) -> DataFrame:
    """Each quadrant's points as one JSON object."""
    point = F.transform("points", lambda p: F.struct(F.round(p["x"], 2).alias("x"), F.round(p["y"], 2).alias("y"), p["label"].alias("label")))
    return sinks.json_rows(signals.quadrant_groups(sector_table(spark, d)).select("quad", point.alias("points")))


@query("trail_extents", f"""SELECT {rnd("least(min(ratio) - 0.6e0, 99e0)", 3)} AS x_min,
  {rnd("greatest(max(ratio) + 0.6e0, 101e0)", 3)} AS x_max, {rnd("least(min(mom) - 0.6e0, 99e0)", 3)} AS y_min,
  {rnd("greatest(max(mom) + 0.6e0, 101e0)", 3)} AS y_max FROM trails t JOIN sectors s ON s.etf = t.symbol""")
def trail_extents(spark: SparkSession, d: str) -> DataFrame:
    from tidewheel.functions.numbers import round_to

    out = signals.trail_extents(sector_table(spark, d))
    return out.select(*[round_to(F.col(c), 3).alias(c) for c in out.columns])


# Members ----------------------------------------------------------------------


@query("stock_drilldown", f"SELECT {_STOCK} FROM drill")
def stock_drilldown(spark: SparkSession, d: str) -> DataFrame:
    return _stock_rows(rotation.ranked_stocks(drilldown(spark, d)[1]))


@query("member_scores", f"SELECT {_STOCK} FROM drill_all")
def member_scores(spark: SparkSession, d: str) -> DataFrame:
    """The drill-down with every scored sector let through."""
    return _stock_rows(drilldown(spark, d, 0)[1])


@query("sector_pair_quadrants", "SELECT etf, ticker, quad_sec FROM pair_last")
def sector_pair_quadrants(spark: SparkSession, d: str) -> DataFrame:
    return rotation.sector_pair_quadrant(stored_bars(spark, d), t.universe_dim(spark, d))


@query("reason_sentences", "SELECT etf, ticker, reason FROM drill_all")
def reason_sentences(spark: SparkSession, d: str) -> DataFrame:
    return drilldown(spark, d, 0)[1].select("etf", "ticker", "reason")


@query("top_stocks", """SELECT ticker, etf, score, rec FROM (
  SELECT x.ticker, x.etf, x.score, x.rec,
         row_number() OVER (ORDER BY x.score DESC, s.score DESC, s.ord, x.ord) AS place
  FROM drill_all x JOIN rotation s ON s.etf = x.etf) WHERE place <= 25""")
def top_stocks(spark: SparkSession, d: str) -> DataFrame:
    sectors, ranked = drilldown(spark, d, 0)
    return rotation.top_stocks(ranked, sectors).select("ticker", "etf", "score", "rec")


@query("actionable_stocks", "SELECT etf, ticker, rec FROM drill_all WHERE rec NOT LIKE '%AVOID%'")
def actionable_stocks(spark: SparkSession, d: str) -> DataFrame:
    return signals.actionable(drilldown(spark, d, 0)[1]).select("etf", "ticker", "rec")


CTES["listed"] = """
SELECT x.*, s.score AS sector_score, s.ord AS sector_ord, unnest([
    CASE WHEN days_active <= 10 THEN 'new' END,
    CASE WHEN days_active <= 30 AND x.avg_20d > 0.3e0 AND current_ret < x.avg_20d * 0.4e0 THEN 'room' END,
    CASE WHEN x.avg_20d > 0 AND current_ret / x.avg_20d > 1.2e0 AND current_ret > 5 THEN 'extended' END,
    CASE WHEN x.hit_20d >= 65 AND x.avg_20d >= 2 THEN 'quality' END]) AS bucket
FROM drill_all x JOIN rotation s ON s.etf = x.etf WHERE x.rec NOT LIKE '%AVOID%'"""


@query("signal_buckets", """SELECT bucket, bucket_rank, bucket_size, ticker, name, etf, trim(rec) AS rec, score,
  days_active AS days, current_ret AS cur, avg_20d AS avg, hit_20d AS hit FROM (
  SELECT *, count(*) OVER (PARTITION BY bucket) AS bucket_size, row_number() OVER (PARTITION BY bucket ORDER BY
    CASE bucket WHEN 'new' THEN days_active::DOUBLE WHEN 'room' THEN current_ret - avg_20d WHEN 'extended' THEN -current_ret
         ELSE -hit_20d * 10 - avg_20d END, sector_score DESC, sector_ord, score DESC, ord) AS bucket_rank
  FROM listed WHERE bucket IS NOT NULL) WHERE bucket_rank <= 8""")
def signal_buckets(spark: SparkSession, d: str) -> DataFrame:
    sectors, ranked = drilldown(spark, d, 0)
    return signals.signal_buckets(ranked, sectors).withColumn("bucket_rank", F.col("bucket_rank").cast("bigint"))


@query("sector_cards", f"""SELECT etf, count(*) FILTER (WHERE rec LIKE '%BUY%') AS buys,
  count(*) FILTER (WHERE rec LIKE '%AVOID%') AS avoids,
  array_to_string((list(ticker ORDER BY score DESC, ord) FILTER (WHERE rec LIKE '%BUY%'))[1:4], ', ') AS top,
  {rnd('avg(hit_20d)', 1)} AS avg_hit, {rnd('avg(avg_20d)', 2)} AS avg_ret FROM drill_all GROUP BY etf""")
def sector_cards(spark: SparkSession, d: str) -> DataFrame:
    cards = signals.sector_cards(drilldown(spark, d, 0)[1])
    return cards.withColumn("top", F.array_join("top", ", "))


# Lookup and search ------------------------------------------------------------

CTES["status"] = """
SELECT u.etf, u.etf_ord, u.ord, u.ticker, coalesce(m.name, u.ticker) AS name, coalesce(s.name, u.etf) AS sector_name,
  coalesce(r.score >= 6, false) AS rotating, coalesce(r.quad, 'Unknown') AS quad, coalesce(r.score, 0) AS score,
  coalesce(r.alert, 'N/A') AS alert
FROM universe u LEFT JOIN sectors s ON s.etf = u.etf LEFT JOIN rotation r ON r.etf = u.etf
LEFT JOIN names m ON m.ticker = u.ticker"""
CTES["looked"] = """
SELECT key AS ticker, name, etf AS sector_etf, sector_name, rotating, quad, score, alert, first_etf_ord, first_ord FROM (
  SELECT *, upper(ticker) AS key, row_number() OVER (w ORDER BY etf_ord DESC, ord DESC) AS back,
         first_value(etf_ord) OVER (w ORDER BY etf_ord, ord) AS first_etf_ord,
         first_value(ord) OVER (w ORDER BY etf_ord, ord) AS first_ord
  FROM status WINDOW w AS (PARTITION BY upper(ticker))) WHERE back = 1"""


@query("member_status", "SELECT etf, ticker, name, sector_name, rotating, quad, score, alert FROM status")
def member_status(spark: SparkSession, d: str) -> DataFrame:
    status = lookup.member_status(t.universe_dim(spark, d), t.sector_dim(spark, d), sector_table(spark, d),
                                  t.name_dim(spark, d))
    return status.select("etf", "ticker", "name", "sector_name", "rotating", "quad", "score", "alert")


@query("stock_lookup", "SELECT * FROM looked")
def stock_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup_table(spark, d, sector_table(spark, d))


@query("ticker_labels", """SELECT u.ticker, CASE WHEN m.name IS NULL THEN u.ticker ELSE u.ticker || ' (' || m.name || ')'
END AS label FROM (SELECT DISTINCT ticker FROM universe) u LEFT JOIN names m ON m.ticker = u.ticker""")
def ticker_labels(spark: SparkSession, d: str) -> DataFrame:
    tickers = t.universe_dim(spark, d).select("ticker").distinct()
    return tickers.join(t.name_dim(spark, d), "ticker", "left").select(
        "ticker", ticker_label(F.col("ticker"), F.col("name")).alias("label"))


_HIT = "(starts_with(lower(ticker), 'nation_1') OR contains(lower(name), 'nation_1'))"


@query("stock_search", f"SELECT ticker, name, etf AS sector_etf, score, 'drilldown' AS found_in FROM drill_all WHERE {_HIT}")
def stock_search(spark: SparkSession, d: str) -> DataFrame:
    sectors, ranked = drilldown(spark, d, 0)
    return lookup.search(ranked, lookup_table(spark, d, sectors), " Nation_1 ")


_LATE = "(starts_with(lower(ticker), 'nation_2') OR contains(lower(name), 'nation_2'))"


CTES["hit"] = f"SELECT ticker, name, etf, score FROM drill WHERE {_LATE}"
CTES["other"] = f"SELECT * FROM looked WHERE {_LATE} ORDER BY first_etf_ord, first_ord LIMIT 1"


@query("search_fallback", """SELECT ticker, name, etf AS sector_etf, score, 'drilldown' AS found_in FROM hit
UNION ALL SELECT ticker, name, sector_etf, score, 'lookup' FROM other WHERE (SELECT count(*) FROM hit) = 0""")
def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    sectors, ranked = drilldown(spark, d)
    return lookup.search(ranked, lookup_table(spark, d, sectors), "nation_2")


# Boards -----------------------------------------------------------------------

CTES["recent"] = "SELECT * FROM bars WHERE dt >= (SELECT max(dt) FROM bars WHERE symbol = 'ALL') - INTERVAL 3 MONTH"


def _changes(horizons: dict[str, int], last: str) -> str:
    bases = ", ".join(f"max(close) FILTER (WHERE pos = greatest(0, n - 1 - {k})) AS b_{c}" for c, k in horizons.items())
    out = ", ".join(f"{rnd(f'(last - b_{c}) / nullif(b_{c}, 0) * 100', 1)} AS {c}" for c in horizons)
    return f"""SELECT symbol, {rnd('last', 2)} AS {last}, {out} FROM (
  SELECT symbol, arg_max(close, pos) AS last, {bases} FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n
    FROM @) WHERE n >= 5 GROUP BY symbol)"""


CTES["metal_changes"] = _changes(METAL_HORIZONS, "spot").replace("@", "recent")
CTES["company_changes"] = _changes(COMPANY_HORIZONS, "price").replace("@", "recent")
CTES["event_changes"] = _changes(METAL_HORIZONS, "spot").replace("@", "ebars")


def _recent(spark: SparkSession, d: str) -> DataFrame:
    return t.recent_order_bars(spark, d)


@query("metal_price_changes", "SELECT symbol, spot, ch1d, ch7d, ch1m, ch2m FROM metal_changes")
def metal_price_changes(spark: SparkSession, d: str) -> DataFrame:
    return metals.price_changes(_recent(spark, d), METAL_HORIZONS)


@query("hourly_price_changes", "SELECT symbol, spot, ch1d, ch7d, ch1m, ch2m FROM event_changes")
def hourly_price_changes(spark: SparkSession, d: str) -> DataFrame:
    return metals.price_changes(t.event_bars(spark, d), METAL_HORIZONS)


@query("company_price_changes", "SELECT symbol, price, ch10d, ch20d, ch1m, ch2m FROM company_changes")
def company_price_changes(spark: SparkSession, d: str) -> DataFrame:
    return metals.price_changes(_recent(spark, d), COMPANY_HORIZONS, "price")


CTES["metal_dim"] = """SELECT name, etf AS ticker, '$' AS unit, left(etf, 2) AS symbol, false AS proxy, ord FROM sectors"""
CTES["company_dim"] = """SELECT s.name AS "group", 'Nation ' || string_split(n_name, '_')[2] AS name, n_name AS ticker,
  s.etf AS country, 'X' AS exchange, s.ord AS group_ord, n_nationkey AS ord
FROM nation JOIN sectors s ON s.ord = n_regionkey"""


@query("metal_price_board", """SELECT m.name, m.ticker, m.unit, m.symbol, m.proxy, m.ord, c.spot, c.ch1d, c.ch7d, c.ch1m,
  c.ch2m FROM metal_dim m JOIN metal_changes c ON c.symbol = m.ticker""")
def metal_price_board(spark: SparkSession, d: str) -> DataFrame:
    return metals.price_board(t.metal_dim(spark, d), _recent(spark, d)).select(
        "name", "ticker", "unit", "symbol", "proxy", "ord", "spot", "ch1d", "ch7d", "ch1m", "ch2m")


_BOARD = """SELECT m.*, c.price, c.ch10d, c.ch20d, c.ch1m, c.ch2m FROM company_dim m
JOIN company_changes c ON c.symbol = m.ticker"""
CTES["company_board"] = _BOARD


def _board(spark: SparkSession, d: str) -> DataFrame:
    return metals.company_board(t.company_dim(spark, d), _recent(spark, d))


@query("company_board", _BOARD)
def company_board(spark: SparkSession, d: str) -> DataFrame:
    return _board(spark, d)


@query("group_company_counts", """SELECT "group", count(*) AS n FROM company_board GROUP BY ROLLUP ("group")""")
def group_company_counts(spark: SparkSession, d: str) -> DataFrame:
    return metals.group_counts(_board(spark, d))


@query("company_metal_filter", """SELECT "group", ticker FROM company_board
WHERE contains(lower("group"), 'east') OR contains('east', lower("group"))""")
def company_metal_filter(spark: SparkSession, d: str) -> DataFrame:
    return filter_by_metal(_board(spark, d), "group", "East").select("group", "ticker")


@query("price_metal_filter", """SELECT name FROM metal_dim m JOIN metal_changes c ON c.symbol = m.ticker
WHERE contains(lower(name), 'africa/asia') OR contains('africa/asia', lower(name))""")
def price_metal_filter(spark: SparkSession, d: str) -> DataFrame:
    board = metals.price_board(t.metal_dim(spark, d), _recent(spark, d))
    return filter_by_metal(board, "name", "Africa/Asia").select("name")


_PRICE = ("name", "ticker", "unit", "symbol", "proxy", "ord", "spot", "ch1d", "ch7d", "ch1m", "ch2m")
_COMPANY = ("group", "name", "ticker", "country", "exchange", "price", "ch10d", "ch20d", "ch1m", "ch2m")
_LOOKUP = ("ticker", "name", "sector_etf", "sector_name", "rotating", "quad", "score", "alert")


@query("price_payload", f"SELECT {json_of(*_PRICE)} FROM metal_dim m JOIN metal_changes c ON c.symbol = m.ticker".replace('"symbol"', "m.symbol"))
def price_payload(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_rows(metals.price_board(t.metal_dim(spark, d), _recent(spark, d)), *_PRICE)


@query("company_payload", f"SELECT {json_of(*_COMPANY)} FROM company_board")
def company_payload(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_rows(_board(spark, d), *_COMPANY)


@query("lookup_payload", f"SELECT {json_of(*_LOOKUP)} FROM looked")
def lookup_payload(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_rows(lookup_table(spark, d, sector_table(spark, d)), *_LOOKUP)


# Refresh ----------------------------------------------------------------------

# Stored: bars up to May 2001, and the whole benchmark. Landed: the full history of the regions.
SINCE = "1996-01-01"
CTES["stored"] = """SELECT * FROM bars WHERE dt < TIMESTAMP '2001-06-01' OR symbol = 'ALL'"""
CTES["landing"] = """SELECT * FROM bars WHERE symbol IN (SELECT r_name FROM region)"""
CTES["freshness"] = """
SELECT w.symbol, max(dt) AS last_dt, coalesce(date_diff('day', max(dt), (SELECT max(dt) FROM bars)) > 1, true) AS stale
FROM (SELECT DISTINCT symbol FROM bars UNION SELECT s_name FROM supplier) w LEFT JOIN stored s USING (symbol)
GROUP BY w.symbol"""
CTES["landed"] = """SELECT * FROM landing WHERE dt >= TIMESTAMP '1996-01-01'
AND symbol IN (SELECT symbol FROM freshness WHERE stale)"""
CTES["refreshed"] = """SELECT * FROM stored WHERE symbol NOT IN (SELECT symbol FROM landed)
UNION ALL SELECT * FROM landed"""


def _refresh_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored bars, landed bars, freshness) with the suppliers as symbols that never land."""
    bars = stored_bars(spark, d)
    stored = bars.filter((F.col("dt") < F.lit("2001-06-01").cast("timestamp")) | (F.col("symbol") == BENCH))
    regions = t.table(spark, d, "region").select(F.col("r_name").alias("symbol"))
    landing = bars.join(regions, "symbol", "left_semi")
    wanted = bars.select("symbol").union(t.table(spark, d, "supplier").select("s_name")).distinct()
    as_of = bars.agg(F.to_date(F.max("dt"))).scalar()
    return stored, landing, b.freshness(stored, wanted, as_of)


@query("stale_symbols", "SELECT symbol, strftime(last_dt, '%Y-%m-%d') AS last_day, stale FROM freshness")
def stale_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _refresh_inputs(spark, d)[2].select("symbol", F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), "stale")


_REFRESHED = "SELECT symbol, strftime(dt, '%Y-%m-%d') AS dt, open, high, low, close, volume FROM refreshed"


def _bar_rows(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", F.date_format("dt", "yyyy-MM-dd").alias("dt"), *b.PRICES, "volume")


@query("refreshed_bars", _REFRESHED)
def refreshed_bars(spark: SparkSession, d: str) -> DataFrame:
    stored, landing, status = _refresh_inputs(spark, d)
    return _bar_rows(b.refreshed(stored, landing, status, SINCE))


@query("refresh_audit", """SELECT CASE WHEN NOT f.stale THEN 'up-to-date' WHEN l.symbol IS NOT NULL THEN 'updated'
  ELSE 'failed' END AS status, count(*) AS n
FROM freshness f LEFT JOIN (SELECT DISTINCT symbol FROM landed) l USING (symbol) GROUP BY 1""")
def refresh_audit(spark: SparkSession, d: str) -> DataFrame:
    stored, landing, status = _refresh_inputs(spark, d)
    return b.refresh_audit(landing, status, SINCE)


@query("streamed_refresh", _REFRESHED)
def streamed_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The refresh as a stream over a landing folder, replacing symbols of a stored table."""
    from tidewheel.session import new_path

    stored, landing, status = _refresh_inputs(spark, d)
    target, inbox = bars_by_symbol(spark, new_path(spark, "bars")), new_path(spark, "landing")
    target.commit(spread_by(stored.select(*b.BAR_COLUMNS), "symbol", "dt"))
    landing.select(*b.BAR_COLUMNS).write.parquet(inbox)
    wanted = status.select("symbol")
    as_of = t.order_bars(spark, d).agg(F.to_date(F.max("dt"))).first()[0]
    refresh_stream(spark, inbox, target, wanted, as_of, SINCE)
    return _bar_rows(target.read())
