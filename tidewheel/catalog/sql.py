"""Building blocks of the oracle queries: named CTEs for DuckDB, joined by dependency."""

from __future__ import annotations

import re

from tidewheel.functions.text import WHITESPACE
from tidewheel.operators.frames import HORIZONS


def rnd(value: str, digits: int) -> str:
    return f"floor(({value}) * 1e{digits} + 0.5e0) / 1e{digits}"


def day(column: str = "dt") -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(value: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
    return f"trim({value}, {chars})"


def json_of(*columns: str) -> str:
    """One JSON object of the columns, null fields kept."""
    return "CAST(to_json({" + ", ".join(f"'{c}': \"{c}\"" for c in columns) + "}) AS VARCHAR) AS json"


CTES: dict[str, str] = {}

CTES["cells"] = """
SELECT r.r_name, n.n_name, date_trunc('day', o.o_orderdate)::TIMESTAMP AS dt,
       arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
       arg_max(o_totalprice, o_orderkey) AS close, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS volume,
       min(o_orderkey) AS k0, max(o_orderkey) AS k1
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY ALL"""

CTES["bars"] = """
SELECT symbol, dt, arg_min(open, k0) AS open, max(high) AS high, min(low) AS low,
       arg_max(close, k1) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM (SELECT unnest(['ALL', r_name, n_name]) AS symbol, * FROM cells) GROUP BY symbol, dt"""

CTES["ebars"] = """
SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS dt, arg_min(value, event_id) AS open,
       max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS volume
FROM events GROUP BY ALL"""

_FWD = ", ".join(f"(lead(close, {h}) OVER w / close - 1) * 100 AS fwd_{h}" for h in HORIZONS)

CTES["own"] = f"""
SELECT *, symbol AS k FROM (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n,
         close / lag(close) OVER w - 1 AS ret, lag(close, 251) OVER w AS close_year_ago,
         CASE WHEN count(*) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20
              THEN avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol_mean20, {_FWD}
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt))"""

_ALIGNED = f"""
SELECT * FROM (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY k) AS n,
         CASE WHEN count(*) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20
              THEN avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol_mean20,
         (close / lag(close, 10) OVER w - 1) * 100 AS roc10,
         (lag(close, 2) OVER w / lag(close, 12) OVER w - 1) * 100 AS roc10_ago2, {_FWD}
  FROM %s WINDOW w AS (PARTITION BY k ORDER BY dt)) WHERE n >= %d"""

CTES["joined"] = """
SELECT b.*, b.symbol AS k, a.close AS bench_close
FROM bars b JOIN bars a ON a.symbol = 'ALL' AND a.dt = b.dt"""
CTES["aligned"] = _ALIGNED % ("joined", 1)

CTES["pair_joined"] = """
SELECT b.*, s.symbol || '|' || b.symbol AS k, s.close AS bench_close
FROM universe u JOIN bars b ON b.symbol = u.ticker JOIN bars s ON s.symbol = u.etf AND s.dt = b.dt"""
CTES["pair_aligned"] = _ALIGNED % ("pair_joined", 201)


def _rotation(source: str) -> tuple[str, str]:
    """Recursion over the rows of ``source`` and the readable series built on it."""
    fast, slow, base = "(2e0 / 11e0)", "(2e0 / 27e0)", "(2e0 / 51e0)"
    recursion = f"""
SELECT k, pos, 100 * close / bench_close AS e10, 100 * close / bench_close AS e26, 100e0 AS ratio,
       100e0 AS m10, 100e0 AS m26, close AS e50
FROM {source} WHERE pos = 0
UNION ALL
SELECT k, pos, e10, e26, ratio, {fast} * ratio + (1 - {fast}) * m10, {slow} * ratio + (1 - {slow}) * m26, e50 FROM (
  SELECT k, pos, e10, e26, 100 + (e10 - e26) / e26 * 100 AS ratio, m10, m26, e50 FROM (
    SELECT s.k, s.pos, {fast} * (100 * s.close / s.bench_close) + (1 - {fast}) * p.e10 AS e10,
           {slow} * (100 * s.close / s.bench_close) + (1 - {slow}) * p.e26 AS e26, p.m10, p.m26,
           {base} * s.close + (1 - {base}) * p.e50 AS e50
    FROM @ p JOIN {source} s ON s.k = p.k AND s.pos = p.pos + 1))"""
    series = f"""
SELECT *, lag(quad) OVER w AS quad_prev, lag(mom, 4) OVER w AS mom_lag4 FROM (
  SELECT *, CASE WHEN ratio >= 100 AND mom >= 100 THEN 'Leading' WHEN ratio >= 100 AND mom < 100 THEN 'Weakening'
                 WHEN ratio < 100 AND mom >= 100 THEN 'Improving' ELSE 'Lagging' END AS quad
  FROM (SELECT s.*, r.ratio, 100 + (r.m10 - r.m26) / r.m26 * 100 AS mom, r.e50 AS ema50
        FROM {source} s JOIN @ r USING (k, pos)))
WINDOW w AS (PARTITION BY k ORDER BY pos)"""
    return recursion, series


for _name, _source in (("rot", "aligned"), ("pair", "pair_aligned")):
    _recursion, _series = _rotation(_source)
    CTES[f"{_name}_rec"] = _recursion.replace("@", f"{_name}_rec")
    CTES[_name] = _series.replace("@", f"{_name}_rec")

CTES["smooth_rec"] = """
SELECT k, pos, close AS prev_close, NULL::DOUBLE AS gain, NULL::DOUBLE AS loss, high - low AS atr, close AS ema55
FROM own WHERE pos = 0
UNION ALL
SELECT s.k, s.pos, s.close,
       CASE WHEN p.gain IS NULL THEN greatest(s.close - p.prev_close, 0e0)
            ELSE (1e0 / 13e0) * greatest(s.close - p.prev_close, 0e0) + (1 - 1e0 / 13e0) * p.gain END,
       CASE WHEN p.loss IS NULL THEN greatest(p.prev_close - s.close, 0e0)
            ELSE (1e0 / 13e0) * greatest(p.prev_close - s.close, 0e0) + (1 - 1e0 / 13e0) * p.loss END,
       (2e0 / 14e0) * greatest(s.high - s.low, abs(s.high - p.prev_close), abs(s.low - p.prev_close))
         + (1 - 2e0 / 14e0) * p.atr,
       (2e0 / 56e0) * s.close + (1 - 2e0 / 56e0) * p.ema55
FROM smooth_rec p JOIN own s ON s.k = p.k AND s.pos = p.pos + 1"""

CTES["smoothed"] = """
SELECT s.*, r.atr, r.ema55, 100 - 100 / (1 + r.gain / (r.loss + 1e-9)) AS rsi
FROM own s JOIN smooth_rec r USING (k, pos)"""

CTES["banded"] = """
SELECT *, (high + low) / 2 - mult * atr AS raw_up, (high + low) / 2 + mult * atr AS raw_dn FROM (
  SELECT *, CASE WHEN pos >= 49 THEN least(greatest(1 + 4 * (rel - rel_min) / (rel_max - rel_min + 1e-9), 1e0), 5e0)
            END AS mult
  FROM (SELECT *, min(rel) OVER w AS rel_min, max(rel) OVER w AS rel_max
        FROM (SELECT *, coalesce(atr / nullif(ema55, 0), 0) AS rel FROM smoothed WHERE n >= 200)
        WINDOW w AS (PARTITION BY k ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)))"""

CTES["band_rec"] = """
SELECT k, pos, close, raw_up AS up, raw_dn AS dn, 1 AS trend FROM banded WHERE pos = 0
UNION ALL
SELECT s.k, s.pos, s.close,
       CASE WHEN p.close > p.up THEN greatest(s.raw_up, p.up) ELSE s.raw_up END,
       CASE WHEN p.close < p.dn THEN least(s.raw_dn, p.dn) ELSE s.raw_dn END,
       CASE WHEN s.close > p.dn THEN 1 WHEN s.close < p.up THEN -1 ELSE p.trend END
FROM band_rec p JOIN banded s ON s.k = p.k AND s.pos = p.pos + 1"""

CTES["trend"] = """
SELECT *, trend = 1 AND coalesce(trend_prev, 0) <> 1 AND coalesce(rsi > 45, false) AS entry FROM (
  SELECT b.*, r.up, r.dn, r.trend, lag(r.trend) OVER (PARTITION BY b.k ORDER BY b.pos) AS trend_prev
  FROM banded b JOIN band_rec r USING (k, pos))"""


def _stats(entry: str, ok: str) -> str:
    out = []
    for h in HORIZONS:
        f = f"FILTER (WHERE {entry} AND fwd_{h} IS NOT NULL)"
        hits = f"count(*) FILTER (WHERE {entry} AND fwd_{h} > 0)"
        out += [
            f"CASE WHEN {ok} THEN {rnd(f'{hits} * 100e0 / nullif(count(*) {f}, 0)', 1)} END AS hit_{h}d",
            f"CASE WHEN {ok} THEN {rnd(f'avg(fwd_{h}) FILTER (WHERE {entry})', 2)} END AS avg_{h}d",
            f"CASE WHEN {ok} THEN nullif(count(*) {f}, 0) END AS n_obs_{h}d",
        ]
    return ", ".join(out)


_SIG_OK = "count(*) FILTER (WHERE entry) >= 3"
CTES["trend_sum"] = f"""
SELECT symbol,
  CASE WHEN arg_max(trend, pos) = 1 AND arg_max(rsi, pos) > 45 THEN 'BUY' ELSE 'FLAT' END AS signal,
  coalesce(arg_max(volume, pos) > arg_max(vol_mean20, pos) * 1.5e0, false) AS vol_surge,
  {rnd("(arg_max(close, pos) / any_value(CASE WHEN pos = n - 1 THEN close_year_ago END) - 1) * 100", 1)} AS ret_1y,
  stddev_samp(ret) * sqrt(252e0) * 100 AS ann_vol_raw,
  CASE WHEN {_SIG_OK} THEN count(*) FILTER (WHERE entry) END AS n_signals, {_stats("entry", _SIG_OK)},
  CASE WHEN {_SIG_OK} AND arg_max(trend, pos) = 1
       THEN CAST(date_diff('day', max(dt) FILTER (WHERE entry), max(dt)) AS INTEGER) END AS days_active,
  CASE WHEN {_SIG_OK} AND arg_max(trend, pos) = 1
       THEN {rnd("(arg_max(close, pos) / arg_max(close, pos) FILTER (WHERE entry) - 1) * 100", 2)} END AS current_ret
FROM trend GROUP BY symbol"""

CTES["trend_last"] = f"""
SELECT *, CASE WHEN ann_vol_raw < 20 THEN 'Low' WHEN ann_vol_raw < 35 THEN 'Medium' ELSE 'High' END AS vol_bucket,
  {rnd("ann_vol_raw", 1)} AS ann_vol FROM trend_sum"""

_FLAGS = """coalesce(close > ema50, false) AS f_price, coalesce(volume > vol_mean20 * 1.3e0, false) AS f_volume,
  coalesce(roc10 > roc10_ago2, false) AS f_roc, coalesce(mom > 100 AND mom > mom_lag4, false) AS f_mom"""

CTES["rot_last"] = f"""
SELECT *, CASE WHEN n_sigs >= 4 THEN 'STRONG' WHEN n_sigs = 3 THEN 'ALERT' WHEN n_sigs = 2 THEN 'WATCH' ELSE 'NONE' END
  AS level FROM (
  SELECT *, f_price::INT + f_volume::INT + f_roc::INT + f_mom::INT AS n_sigs FROM (
    SELECT symbol, quad, {rnd("ratio", 3)} AS rs_ratio, {rnd("mom", 3)} AS rs_mom, {_FLAGS}
    FROM rot WHERE pos = n - 1 AND n >= 200))"""

_LEAD = "quad = 'Leading' AND coalesce(quad_prev, '') <> 'Leading'"
_LEAD_OK = f"(count(*) FILTER (WHERE {_LEAD}) >= 3 AND max(n) >= 300)"
CTES["transitions"] = f"""
SELECT symbol, CASE WHEN {_LEAD_OK} THEN count(*) FILTER (WHERE {_LEAD}) END AS n_entries, {_stats(_LEAD, _LEAD_OK)},
  CASE WHEN {_LEAD_OK} AND arg_max(quad, pos) = 'Leading'
       THEN CAST(date_diff('day', max(dt) FILTER (WHERE {_LEAD}), max(dt)) AS INTEGER) END AS days_in_leading
FROM rot WHERE n >= 200 GROUP BY symbol"""

CTES["trails"] = f"""
SELECT symbol, n - pos AS back, {rnd("ratio", 3)} AS ratio, {rnd("mom", 3)} AS mom
FROM rot WHERE n >= 200 AND n - pos IN (1, 5, 10, 15, 20, 25, 30, 35, 40)"""

CTES["sectors"] = """
SELECT r_name AS etf, array_to_string([x[1] || lower(x[2:]) FOR x IN string_split(r_name, ' ')], ' ') AS name, r_regionkey AS ord FROM region"""

CTES["universe"] = """
SELECT 'THEME' AS etf, n_name AS ticker, 0 AS etf_ord, n_nationkey AS ord FROM nation
UNION ALL SELECT r_name, n_name, r_regionkey + 1, n_nationkey
FROM nation JOIN region ON n_regionkey = r_regionkey"""

CTES["names"] = """
SELECT n_name AS ticker, 'Nation ' || string_split(n_name, '_')[2] AS name FROM nation
WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"""


def _reason(with_sector: bool) -> str:
    sector = """CASE WHEN quad_sec IN ('Leading', 'Improving') THEN 'Top within sector (' || quad_sec || ')'
      WHEN quad_sec IN ('Weakening', 'Lagging') THEN 'Lagging within sector (' || quad_sec || ')' END,"""
    return f"""concat_ws('; ',
      CASE WHEN quad IN ('Leading', 'Improving') THEN 'Outperforming ALL (' ELSE 'Underperforming ALL (' END
        || quad || ')',
      {sector if with_sector else ''}
      CASE WHEN signal = 'BUY' THEN 'StealthTrail active' ELSE 'No trend signal' END,
      CASE WHEN level IN ('STRONG', 'ALERT') THEN n_sigs || '/4 confirmation signals' END,
      CASE WHEN ret_1y > 20 THEN '+' || printf('%.1f', ret_1y) || '% 1Y momentum'
           WHEN ret_1y < 0 THEN printf('%.1f', ret_1y) || '% 1Y (negative)' END)"""


_LEVEL = "CASE level WHEN 'STRONG' THEN 4 WHEN 'ALERT' THEN 2 WHEN 'WATCH' THEN 1 ELSE 0 END"

CTES["rotation"] = f"""
SELECT *, CASE WHEN score >= 12 THEN 'ROTATING ★★★' WHEN score >= 9 THEN 'ROTATING ★★'
               WHEN score >= 6 THEN 'WATCH ★' ELSE 'AVOID' END AS alert, {_reason(False)} AS reason FROM (
  SELECT s.etf, s.name, s.ord, r.* EXCLUDE (symbol), t.signal, t.vol_surge, t.ret_1y, t.vol_bucket, t.ann_vol,
         q.* EXCLUDE (symbol),
         CASE r.quad WHEN 'Leading' THEN 4 WHEN 'Improving' THEN 3 WHEN 'Weakening' THEN 1 ELSE 0 END
           + CASE WHEN t.signal = 'BUY' THEN 3 ELSE 0 END + {_LEVEL} + r.n_sigs AS score
  FROM sectors s JOIN rot_last r ON r.symbol = s.etf JOIN trend_last t ON t.symbol = s.etf
  JOIN transitions q ON q.symbol = s.etf)"""

CTES["pair_last"] = """
SELECT string_split(k, '|')[1] AS etf, string_split(k, '|')[2] AS ticker, quad AS quad_sec FROM pair WHERE pos = n - 1"""

CTES["drill_all"] = f"""
SELECT *, CASE WHEN score >= 12 THEN '★★★ STRONG BUY' WHEN score >= 9 THEN '★★  BUY' WHEN score >= 6 THEN '★   WATCH'
               ELSE '    AVOID' END AS rec, {_reason(True)} AS reason FROM (
  SELECT u.etf, u.ticker, u.ord, coalesce(m.name, '') AS name, r.* EXCLUDE (symbol),
         coalesce(p.quad_sec, 'N/A') AS quad_sec, t.* EXCLUDE (symbol, ann_vol_raw),
         CASE r.quad WHEN 'Leading' THEN 3 WHEN 'Improving' THEN 2 WHEN 'Weakening' THEN 1 ELSE 0 END
           + CASE p.quad_sec WHEN 'Leading' THEN 2 WHEN 'Improving' THEN 2 WHEN 'Weakening' THEN 1 ELSE 0 END
           + CASE WHEN t.signal = 'BUY' THEN 3 ELSE 0 END + {_LEVEL} + r.n_sigs AS score
  FROM universe u JOIN (SELECT etf FROM rotation) s ON s.etf = u.etf
  JOIN rot_last r ON r.symbol = u.ticker JOIN trend_last t ON t.symbol = u.ticker
  LEFT JOIN pair_last p ON p.etf = u.etf AND p.ticker = u.ticker LEFT JOIN names m ON m.ticker = u.ticker)"""


CTES["drill"] = "SELECT d.* FROM drill_all d JOIN (SELECT etf FROM rotation WHERE score >= 6) s ON s.etf = d.etf"


def with_ctes(query: str) -> str:
    """Prefix ``query`` with every CTE it names, dependencies first."""
    done: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+[a-z0-9_]*)", text):
            if name in CTES and name not in done and f"{name}" not in visiting:
                visiting.add(name)
                visit(CTES[name])
                done[name] = CTES[name]

    visiting: set[str] = set()
    visit(query)
    if not done:
        return query
    parts = []
    for name, text in done.items():
        kind = "" if name.endswith("_rec") else "MATERIALIZED "
        parts.append(f"{name} AS {kind}({text})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + query
